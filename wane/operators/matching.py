"""First-match joins of symbols against a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.names import build_keys, compatible, leaf, probe_keys
from wane.functions.text import strip
from wane.session import local_rows


def target_dim(spark) -> DataFrame:
    rows = [(lib, t) for lib, names in fixed.TARGETS.items() for t in names]
    return local_rows(spark, [(lib, t, i) for i, (lib, t) in enumerate(rows)], "library string, target_api string, ord int")


def pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str, how: str = "inner") -> DataFrame:
    """All compatible pairs, for reports that need them: equi-join on leaf and predicate.

    For a lookup use ``first_match``, which forms no pairs.
    """
    a = left.withColumn("leaf", leaf(F.col(left_name)))
    b = right.withColumn("leaf_r", leaf(F.col(right_name)))
    cond = (F.col("leaf") == F.col("leaf_r")) & compatible(F.col(left_name), F.col(right_name))
    return a.join(b, cond, how).drop("leaf", "leaf_r")


def first_keys(catalog: DataFrame, name: str, order: list[Column], bare_methods: bool = False) -> DataFrame:
    """One row per lookup key: the first catalog name filed under it."""
    keyed = catalog.select(
        F.col(name).alias("_match"), F.struct(*order).alias("_ord"), 
        F.explode(build_keys(F.col(name), bare_methods)).alias("_key"))
    return keyed.groupBy("_key").agg(
        F.min_by("_match", F.struct("_ord", "_match")).alias("_match"), F.min("_ord").alias("_ord"))


def first_match(rows: DataFrame, symbol: str, catalog: DataFrame, name: str, order: list[str],
                out: str = "matched", exact_first: bool = True, bare_methods: bool = False) -> DataFrame:
    """Add the first catalog name compatible with ``symbol`` (null when there is none).

    Distinct symbols are looked up once, so a symbol that fills a third of the rows
    costs one probe. Every key leads to at most one catalog row: the join is N:1.
    """
    order_cols = [F.col(c) for c in order]
    keys = first_keys(catalog.where(F.col(name).isNotNull()), name, order_cols, bare_methods)
    symbols = rows.select(F.col(symbol).alias("_symbol")).where(F.col(symbol).isNotNull()).distinct()
    probes = symbols.select(
        "_symbol", F.explode(F.array_distinct(probe_keys(F.col("_symbol"), bare_methods))).alias("_key"))
    rank = F.struct((F.col("_match") != F.col("_symbol")).alias("x") if exact_first else F.lit(0).alias("x"),
                    F.col("_ord"), F.col("_match"))
    found = probes.join(keys, "_key").groupBy("_symbol").agg(F.min_by("_match", rank).alias(out))
    joined = rows.join(found, rows[symbol] == found["_symbol"], "left")
    return joined.drop("_symbol")


def match_target(rows: DataFrame, symbol: str, out: str = "target_api") -> DataFrame:
    """The target API that a symbol denotes, if any."""
    clean = rows.withColumn("_clean", strip(F.col(symbol)))
    dim = target_dim(rows.sparkSession).withColumnRenamed("target_api", "_target")
    return first_match(clean, "_clean", dim, "_target", ["ord"], out).drop("_clean")


def leaf_lookup(calls: DataFrame, catalog: DataFrame, name: str, out: str = "leaf_match", only: list[str] | None = None) -> DataFrame:
    """The catalog name with the callee as its leaf; the receiver's spelling breaks ties.

    Per leaf only three names can ever be chosen, so the catalog side is reduced to
    one row per leaf before the join. With ``only``, calls without a match are dropped by the join
    itself, but for the callees listed there.
    """
    named = catalog.select(F.col(name).alias("_n"), leaf(F.col(name)).alias("_leaf"))
    low = F.lower("_n")
    dim = named.groupBy("_leaf").agg(
        F.min("_n").alias("_first"),
        F.min(F.when(F.contains(low, F.lit("dataframe")), F.col("_n"))).alias("_frame"),
        F.min(F.when(F.contains(low, F.lit("series")), F.col("_n"))).alias("_series"))
    receiver = F.lower(F.coalesce("receiver", F.lit("")))
    pick = (
        F.when(F.contains(receiver, F.lit("df")), F.coalesce("_frame", "_first"))
        .when(F.contains(receiver, F.lit("series")), F.coalesce("_series", "_first"))
        .otherwise(F.col("_first")))
    if only is not None:
        kept = local_rows(calls.sparkSession, [(c, None, None, None) for c in only], dim.schema)
        dim = dim.where(~F.col("_leaf").isin(only)).unionByName(kept)
    joined = calls.join(dim, calls["callee"] == dim["_leaf"], "left" if only is None else "inner")
    return joined.withColumn(out, pick).drop("_leaf", "_first", "_frame", "_series")
