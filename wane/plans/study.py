"""The whole study, stage by stage. Every stage ends in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.operators import agreement as agr
from wane.operators import catalog as cat
from wane.operators import reexports as rex
from wane.operators import resolution as res
from wane.operators import significance as sig
from wane.operators import verification as ver
from wane.operators.declarations import find_candidates
from wane.operators.matching import target_dim
from wane.sources.trees import scan_snapshots


def stored(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """Write a table and read it back: the next stage starts from files, not from lineage."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def build_catalog(spark: SparkSession, base: str, out: str, snapshots: dict[str, list[str]] | None = None,
                  across_snapshots: bool = False) -> DataFrame:
    """Catalog of all snapshots below ``base``, partitioned by library."""
    files = scan_snapshots(spark, base, snapshots or fixed.SNAPSHOTS)
    catalog = cat.union_candidates(find_candidates(files.where("error is null").drop("error")), across_snapshots)
    library = F.element_at(F.split("qualified_name", "[.]"), 1)
    return stored(catalog.withColumn("library", library), out, "library")


def catalog_report(catalog: DataFrame) -> dict[str, DataFrame]:
    coverage = cat.target_coverage(catalog)
    return {
        "scopes": cat.scope_counts(catalog, ["library"]), "origins": cat.origin_counts(catalog, ["library"]),
        "multiplicity": cat.origin_multiplicity(catalog), "coverage": coverage,
        "coverage_summary": cat.coverage_summary(coverage)}


def trace_libraries(spark: SparkSession, base: str, out: str, snapshots: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(re-exports, annotated returns) of all snapshots, each followed within its own tree."""
    files = scan_snapshots(spark, base, snapshots or fixed.SNAPSHOTS)
    names = stored(rex.library_names(files.where("error is null"), ["library", "version"]), f"{out}/names")
    exports = stored(rex.re_exports(names), f"{out}/exports")
    return exports, stored(rex.returned(names, exports), f"{out}/returns")


def resolve_corpus(spark: SparkSession, samples: DataFrame, catalog: DataFrame, out: str, reconstructed: bool = True,
                   traced: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Statuses of all calls that may use a catalog entry, kept by sample; the targets are always part of the catalog.

    ``traced`` is what ``trace_libraries`` found; without it the few re-exports of the targets are taken as given.
    """
    pilot = target_dim(spark).where(F.col("target_api").isin(fixed.PILOT_TARGETS)).select(F.col("target_api").alias("qualified_name"))
    names = catalog.select("qualified_name").unionByName(pilot).distinct()
    preamble = res.reconstructed_preamble(F.col("alias_dict")) if reconstructed else res.baseline_preamble()
    exports, returns = traced or (spark.createDataFrame(fixed.RE_EXPORTS, "from_symbol string, to_symbol string"), None)
    s = res.call_statuses(samples, names, preamble, carry=["sample_id", "library", "sample_idx", "category", "deprecated_api"],
                          aliases=exports, returns=returns)
    return res.by_sample(s, out)


def make_manifest(statuses: DataFrame, samples: DataFrame, catalog: DataFrame, out: str) -> DataFrame:
    entries = catalog.withColumn("location", F.concat_ws(":", "file", F.col("line").cast("string")))
    return stored(res.build_manifest(statuses, samples, entries), out)


def verify_manifest(manifest: DataFrame, cache: DataFrame, out: str, verifier=ver.rule_verifier, model: str = "primary"):
    """(predictions, cache) with the responses and the predictions written below ``out``."""
    predictions, known = ver.verify(manifest, cache, verifier, model, store=f"{out}/responses")
    return stored(predictions, f"{out}/predictions"), known


def evaluate(rows: DataFrame, by: list[str] = ()) -> dict[str, DataFrame]:
    """Metrics, intervals and tests for rows with a label and the predictions a, b and c."""
    truth = "is_deprecated_call"
    missed = F.col("stratum") == "pipeline_miss"
    out = {}
    for name in ("pred_a", "pred_b", "pred_c"):
        out[name] = agr.conditional_and_end_to_end(rows, truth, name, missed, by)
        out[f"{name}_intervals"] = sig.with_intervals(agr.binary_metrics(rows, truth, name, by), by)
    out["discordance"] = sig.discordance(rows, truth, "pred_b", "pred_a", by)
    out["delta_f1"] = sig.paired_bootstrap(sig.paired_counts(rows, truth, "pred_b", "pred_a", by), by)
    out["ablation"] = agr.ablation(rows, truth)
    return out
