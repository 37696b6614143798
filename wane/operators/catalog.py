"""The deprecation catalog: union, deduplication and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.text import canonical_path, strip
from wane.operators.agreement import half_even
from wane.operators.matching import first_match, target_dim


def catalog_order(df: DataFrame) -> list[str]:
    """Columns that put catalog rows in order: ``ord`` counts within a file, so rows of several snapshots need all three."""
    return ["snapshot", "file", "ord"] if "snapshot" in df.columns else ["ord"]


def with_defaults(candidates: DataFrame) -> DataFrame:
    """Fill origins from origin and function_name from the qualified name."""
    own = F.when(
        F.col("scope") == "parameter", F.element_at(F.split("qualified_name", "::"), 1)
    ).otherwise(F.col("qualified_name"))
    return candidates.withColumn(
        "origins", F.when(F.size(F.coalesce("origins", F.array().cast("array<string>"))) == 0,
                          F.array("origin")).otherwise(F.col("origins"))
    ).withColumn("function_name", F.coalesce(F.when(F.col("function_name") != "", F.col("function_name")), own))


def param_tuple(param: Column) -> Column:
    """Sorted parameter names of ``a+b``; empty when there is none."""
    return F.when(F.coalesce(param, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.array_sort(F.split(param, "[+]")))


def union_candidates(candidates: DataFrame, across_snapshots: bool = False) -> DataFrame:
    """One row per declaration.

    Parameter-scoped evidence never merges with evidence about the whole function, and
    ``a+b`` equals ``b+a``. Rows are first reduced per (declaration, evidence text) with
    map-side combining, so a declaration that holds a third of the rows reaches the
    second step as its few distinct texts.

    ``across_snapshots`` keys on the path below the snapshot folder, so that the same
    declaration in several library versions becomes one row. With a ``snapshot`` number, first and last
    go by (snapshot, file, ord), and the row keeps the snapshot it was first seen in.
    """
    place = F.struct(*catalog_order(candidates))
    seen_in = ["snapshot"] if "snapshot" in candidates.columns else []
    c = with_defaults(candidates)
    of_param = F.col("scope") == "parameter"
    path = canonical_path(F.col("file"))
    if across_snapshots:
        path = F.regexp_replace(path, r"^.*?[A-Za-z]+-\d[^/]*/", "")
    has_message = F.coalesce(F.col("message"), F.lit("")) != ""
    declared = F.array_contains("origins", "pep702") | F.contains("origin", F.lit("pep702"))
    keyed = c.select(
        F.when(of_param, F.col("function_name")).otherwise(F.col("qualified_name")).alias("_key"),
        path.alias("_file"), F.col("scope").alias("_scope"),
        F.when(of_param, param_tuple(F.col("param_name"))).otherwise(F.array().cast("array<string>")).alias("_params"),
        strip(F.coalesce("raw_evidence", F.lit(""))).alias("_evidence"),
        F.struct(place.alias("place"), "qualified_name", "origin", "file", "line", "scope", "param_name", "function_name", "ord", *seen_in).alias("_rep"),
        F.when(F.col("line") > 0, F.col("line")).alias("_line"),
        F.struct("origins", "origin").alias("_origins"),
        F.when(has_message, F.struct(place.alias("place"), "message")).alias("_last"),
        F.when(has_message & declared, F.struct(place.alias("place"), "message")).alias("_declared"))
    key = ["_key", "_file", "_scope", "_params"]
    texts = keyed.groupBy(*key, "_evidence").agg(
        F.min("_rep").alias("_rep"), F.min("_line").alias("_line"),
        F.collect_set("_origins").alias("_origins"),
        F.max("_last").alias("_last"), F.min("_declared").alias("_declared"), F.count("*").alias("_n"))
    merged = texts.groupBy(*key).agg(
        F.min("_rep").alias("_rep"), F.min("_line").alias("_line"),
        F.array_distinct(F.flatten(F.collect_list("_origins"))).alias("_origins"),
        F.max("_last").alias("_last"), F.min("_declared").alias("_declared"),
        F.array_sort(F.collect_list(
            F.when(F.col("_evidence") != "", F.struct(F.col("_rep.place").alias("place"), F.col("_evidence").alias("text")))
        )).alias("_texts"),
        F.sum("_n").alias("raw_hits"))
    merged = merged.withColumn("origins", F.array_sort(F.array_distinct(F.flatten("_origins.origins")))).withColumn(
        "_tags", F.array_union("origins", F.col("_origins.origin")))
    origin = F.coalesce(
        *[F.when(F.array_contains("_tags", p), F.lit(p)) for p in fixed.ORIGIN_PRIORITY], F.col("_rep.origin"))
    return merged.select(
        F.col("_rep.qualified_name").alias("qualified_name"), origin.alias("origin"),
        F.col("_rep.file").alias("file"), F.coalesce("_line", "_rep.line").alias("line"),
        F.array_join(F.transform("_texts", lambda t: t["text"]), " | ").alias("raw_evidence"),
        "origins", F.col("_rep.scope").alias("scope"), F.col("_rep.param_name").alias("param_name"),
        F.col("_rep.function_name").alias("function_name"),
        F.coalesce("_declared.message", "_last.message").alias("message"),
        F.col("_rep.ord").alias("ord"), *(F.col(f"_rep.{c}").alias(c) for c in seen_in), "raw_hits")


def catalog_records(catalog: DataFrame) -> DataFrame:
    """The published columns of a catalog row."""
    return catalog.select(
        "qualified_name", "origin", "origins",
        F.concat_ws(":", "file", F.col("line").cast("string")).alias("location"),
        "scope", "param_name", "message", "raw_evidence")


def active_origins() -> Column:
    """Origins without the generic declared tag."""
    return F.array_except("origins", F.array(F.lit("pep702")))


def origin_counts(catalog: DataFrame, by: list[str] = ()) -> DataFrame:
    """Declarations per origin; ``parameter`` counts the parameter-scoped ones."""
    tags = F.array_union(
        F.array_except(active_origins(), F.array(F.lit("parameter"))),
        F.when(F.col("scope") == "parameter", F.array(F.lit("parameter"))).otherwise(F.array().cast("array<string>")))
    return catalog.select(*by, F.explode(tags).alias("origin")).groupBy(*by, "origin").agg(F.count("*").alias("n"))


def origin_multiplicity(catalog: DataFrame, highest: int = 5) -> DataFrame:
    """How many declarations have 1, 2, ... origins; all buckets present."""
    k = F.least(F.size(active_origins()), F.lit(highest))
    seen = catalog.groupBy(k.alias("n_origins")).agg(F.count("*").alias("n"))
    buckets = catalog.sparkSession.range(1, highest + 1).select(F.col("id").cast("int").alias("n_origins"))
    return buckets.join(seen, "n_origins", "full").select("n_origins", F.coalesce("n", F.lit(0)).alias("n"))


def scope_counts(catalog: DataFrame, by: list[str] = ()) -> DataFrame:
    return catalog.groupBy(*by).agg(
        F.count("*").alias("n_unique"),
        F.count_if(F.col("scope") == "parameter").alias("n_parameter"),
        F.count_if(F.col("scope") == "function").alias("n_function"))


def detector_counts(candidates: DataFrame, by: list[str] = ()) -> DataFrame:
    """Raw hits per detector label, before deduplication."""
    label = F.when(F.col("detector") == 2, F.lit("parameter")).otherwise(F.col("origin"))
    return candidates.groupBy(*by, label.alias("detector")).agg(F.count("*").alias("n"))


def target_coverage(catalog: DataFrame, targets: DataFrame | None = None, suffix_only: bool = False,
                    snippet: int = 150) -> DataFrame:
    """For each target the first compatible catalog name and the last entry under that name."""
    targets = target_dim(catalog.sparkSession) if targets is None else targets
    place = F.struct("snapshot", "file", "ord") if "snapshot" in catalog.columns else F.struct("file", "ord")
    names = catalog.groupBy("qualified_name").agg(
        F.min(place).alias("first_at"),
        F.max_by(F.struct("origins", "file", "line", "raw_evidence"), place).alias("entry"))
    names = names.withColumnRenamed("qualified_name", "name")
    if suffix_only:
        a, b = F.col("target_api"), F.col("name")
        near = (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))
        hits = targets.withColumn("_l", F.element_at(F.split("target_api", "[.]"), -1)).join(
            names.withColumn("_r", F.element_at(F.split("name", "[.]"), -1)),
            (F.col("_l") == F.col("_r")) & near)
        best = hits.groupBy("target_api").agg(F.min_by("name", "first_at").alias("matched_symbol"))
        found = targets.join(best, "target_api", "left")
    else:
        found = first_match(targets, "target_api", names, "name", ["first_at"], "matched_symbol", exact_first=False)
    joined = found.join(names, found["matched_symbol"] == names["name"], "left")
    hit = F.col("matched_symbol").isNotNull()
    return joined.select(
        "library", "target_api", "matched_symbol",
        F.when(hit, F.lit("DETECTED")).otherwise(F.lit("NOT_FOUND")).alias("status"),
        F.coalesce("entry.origins", F.array().cast("array<string>")).alias("origins"),
        F.coalesce(F.size("entry.origins") > 1, F.lit(False)).alias("multi_origin"),
        F.concat_ws(":", "entry.file", F.col("entry.line").cast("string")).alias("location"),
        F.substring(F.coalesce("entry.raw_evidence", F.lit("")), 1, snippet).alias("evidence_snippet"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Detected and total targets per library and overall."""
    detected = F.count_if(F.col("status") == "DETECTED")
    return coverage.rollup("library").agg(
        F.count("*").alias("n_targets"), detected.alias("n_detected"),
        F.coalesce(half_even(F.try_divide(detected * 100.0, F.count("*")), 1), F.lit(0.0)).alias("coverage_pct"))


def origin_label(coverage: DataFrame) -> DataFrame:
    """Target -> label of the channels that found it."""
    label = (
        F.when(F.col("multi_origin"),
               F.concat(F.lit("multi_origin ("), F.array_join(F.array_sort("origins"), " + "), F.lit(")")))
        .when(F.size("origins") > 0, F.get("origins", F.lit(0)))
        .otherwise(F.lit("unscanned_miss")))
    return coverage.select("target_api", label.alias("origin_tag"))


def compare_with_published(catalog: DataFrame) -> DataFrame:
    """Own counts of single snapshots next to the counts of an earlier study."""
    published = catalog.sparkSession.createDataFrame(
        fixed.PUBLISHED_COUNTS,
        "library string, published_detected int, published_manual int, published_bundled int")
    own = catalog.groupBy("library", "version").agg(
        F.sum("raw_hits").alias("raw_candidates"), F.count("*").alias("unique_candidates"),
        F.count_if(F.col("scope") == "function").alias("function_scoped"),
        F.count_if(F.col("scope") == "parameter").alias("parameter_scoped"))
    return own.join(published, "library", "left")
