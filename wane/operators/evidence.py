"""Grounding evidence for a target symbol, by priority of its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.operators.catalog import catalog_order
from wane.operators.matching import first_match


def _dims(spark):
    replacements = spark.createDataFrame(
        [(k, v, i) for i, (k, v) in enumerate(fixed.REPLACEMENTS.items())], "of string, replacement string, ord int")
    curated = spark.createDataFrame(
        fixed.GROUNDING, "target string, c_warning string, c_docstring string, c_location string")
    return replacements, curated


def entry_evidence(catalog: DataFrame) -> DataFrame:
    """First usable warning, docstring and location among the entries of each name, in catalog order."""
    order = catalog_order(catalog)
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    warned = F.coalesce(text("message"), F.when(F.col("origin") == "warning", text("raw_evidence")))
    described = F.when(
        (F.col("origin") == "docstring") | F.contains(F.lower("raw_evidence"), F.lit("deprecated")), text("raw_evidence"))
    place = F.regexp_replace(text("location"), r"^.*/benchmark_libs/", "")
    e = catalog.select(
        "qualified_name", F.struct(*order).alias("place"), warned.alias("w"), described.alias("d"), place.alias("p"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("place", c)))[c]
    return e.groupBy("qualified_name").agg(
        F.min("place").alias("first_at"), first("w").alias("e_warning"),
        first("d").alias("e_docstring"), first("p").alias("e_location"))


def add_evidence(rows: DataFrame, catalog: DataFrame | None = None, symbol: str = "target_api") -> DataFrame:
    """Add replacement, warning, docstring and location of ``symbol``.

    Curated text counts before catalog entries; within the catalog an exact name counts
    before a compatible one, and each field takes its first usable entry.
    """
    spark = rows.sparkSession
    replacements, curated = _dims(spark)
    symbols = rows.select(F.col(symbol).alias("_of")).where(F.col(symbol).isNotNull()).distinct()
    s = first_match(symbols, "_of", replacements, "of", ["ord"], "_rep")
    s = s.join(F.broadcast(replacements.select("of", "replacement")), s["_rep"] == replacements["of"], "left").drop("of", "ord")
    s = s.join(F.broadcast(curated), s["_of"] == curated["target"], "left").drop("target")
    if catalog is None:
        for c in ("e_warning", "e_docstring", "e_location"):
            s = s.withColumn(c, F.lit(None).cast("string"))
    else:
        entries = entry_evidence(catalog)
        s = first_match(s, "_of", entries, "qualified_name", ["first_at"], "_name", bare_methods=True)
        s = s.join(entries.drop("first_at"), s["_name"] == entries["qualified_name"], "left")
    s = s.select(
        "_of", F.col("replacement").alias("recommended_replacement"),
        F.coalesce("c_warning", "e_warning").alias("warning"),
        F.coalesce("c_docstring", "e_docstring").alias("docstring"),
        F.coalesce("c_location", "e_location").alias("source_location"))
    # one row for each symbol is hashed, so that rows of a frequent one stream by and are never sorted in one task
    return rows.join(s.hint("shuffle_hash"), rows[symbol].eqNullSafe(s["_of"]), "left").drop("_of")
