"""Reproducible samples: rank by a digest of the id, then keep by quota.

The digest makes every draw independent of partitioning. Bounds are literals wherever
possible, so map tasks drop what cannot be drawn before any shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wane import fixed_values as fixed
from wane.functions.keys import draw
from wane.functions.syntax import marked_calls
from wane.functions.text import contains_any, strip
from wane.operators.ranking import numbered, top_per_key
from wane.operators.reports import expectations
from wane.session import cut_lineage


def quota_sample(rows: DataFrame, key: str, quotas: DataFrame, ids: list[str], seed: int = 42, strict: bool = True) -> DataFrame:
    """``quota`` rows of each key; with ``strict`` a key with too few rows is an error."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    wanted = quotas.where("quota > 0")
    keyed = rows.join(wanted, key).withColumn("_draw", draw(seed, *[F.col(i) for i in ids]))
    kept = top_per_key(keyed, [key], [F.col("_draw"), *[F.col(i) for i in ids]], int(most), "_rank").where(
        F.col("_rank") <= F.col("quota"))
    if strict:
        have = kept.groupBy(key).agg(F.count("*").alias("_n"))
        short = wanted.join(have, key, "left").where(F.coalesce("_n", F.lit(0)) < F.col("quota"))
        lacking = short.agg(F.array_sort(F.collect_list(key)).alias("_short"))
        kept = kept.crossJoin(F.broadcast(lacking)).where(
            F.when(F.size("_short") == 0, True).otherwise(
                F.raise_error(F.concat(F.lit("too few rows for the quota of "), F.array_join("_short", ", "))).cast("boolean"))
        ).drop("_short")
    return kept.drop("_draw", "_rank", "quota")


def bottom_rows(rows: DataFrame, strata: list[str], order: list[str], k: int) -> DataFrame:
    """In one scan, what every task knows of each stratum: its ``k`` first rows by ``order``, and on one of them the task's row count ``_n``.

    Partial answers of tasks can be put together: the first ``k`` rows of a stratum are among them, and its size is the sum of ``_n``.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("_n", T.LongType())])
    names = rows.columns

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, counts = None, Counter()
        for batch in batches:
            for key, n in batch.groupby(strata, dropna=False, sort=False).size().items():
                # missing values are not equal to themselves
                counts[tuple(None if pd.isna(v) else v for v in (key if isinstance(key, tuple) else (key,)))] += n
            kept = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            kept = kept.sort_values(order).groupby(strata, dropna=False, sort=False).head(k)
        if kept is None or not len(kept):
            return
        first = ~kept.duplicated(strata)
        keys = [tuple(None if pd.isna(v) else v for v in t) for t in kept[strata].itertuples(index=False, name=None)]
        kept["_n"] = [counts[key] if one else 0 for key, one in zip(keys, first, strict=True)]
        yield kept[[*names, "_n"]]

    return rows.mapInPandas(reduce, schema)


def proportional_sample(rows: DataFrame, strata: list[str], size: int, ids: list[str], seed: int = 42) -> DataFrame:
    """Proportional allocation over sorted strata, then a top-up to exactly ``size``.

    Each stratum gets ``max(1, round(share * size))`` rows, no more than it has and no
    more than is left; rounding is half-even. Strata after the quota is used up get none. The rows are scanned once: the first ``size`` of each
    stratum answer the allocation and the top-up, which draws the first of all unused rows.
    """
    drawn = rows.withColumn("_draw", draw(seed, *[F.col(i) for i in ids]))
    order = ["_draw", *ids]
    # read below more than once: a few rows of each task and stratum are kept, not the scan
    small = cut_lineage(bottom_rows(drawn, strata, order, size)).withColumn("_key", F.struct(*strata))
    of_stratum = W.partitionBy("_key")
    ranked = small.withColumn("_rank", F.row_number().over(of_stratum.orderBy(*order))).withColumn("_have", F.sum("_n").over(of_stratum)).where(F.col("_rank") <= size)
    # every kept stratum takes at least one row, so no more than the first ``size`` strata can get any
    counts = ranked.where("_rank = 1").select("_key", "_have")
    total = counts.agg(F.sum("_have").alias("_all"))
    first = counts.orderBy("_key").limit(size).crossJoin(F.broadcast(total))
    ask = F.least(F.greatest(F.lit(1), F.rint(F.col("_have") / F.col("_all") * size).cast("bigint")), F.col("_have"))
    before = W.partitionBy(F.lit(0)).orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    alloc = first.withColumn("_ask", ask).withColumn("_left", F.lit(size) - F.coalesce(F.sum("_ask").over(before), F.lit(0)))
    alloc = alloc.select("_key", F.greatest(F.least("_ask", "_left"), F.lit(0)).alias("_take"))
    # within reach of the top-up are no more rows of a stratum than it has left
    marked = ranked.join(alloc, "_key", "left").withColumn("_taken", F.col("_rank") <= F.coalesce("_take", F.lit(0)))
    # taken rows first, then the unused ones in order of their draw: the first ``size`` rows are the sample
    return marked.orderBy(F.desc("_taken"), *order).limit(size).select(*rows.columns)


def fixed_allocation(rows: DataFrame, keys: list[str], allocation: DataFrame, existing: DataFrame, ids: list[str],
                     seed: int = 42) -> DataFrame:
    """``n`` rows per key; rows that are in ``existing`` come first."""
    most = allocation.agg(F.max("n")).first()[0] or 0
    flagged = rows.join(existing.select(*ids).distinct().withColumn("_old", F.lit(1)), ids, "left")
    drawn = flagged.join(allocation, keys).withColumn("_draw", draw(seed, *[F.col(i) for i in ids]))
    order = [F.coalesce("_old", F.lit(0)).desc(), F.col("_draw"), *[F.col(i) for i in ids]]
    kept = top_per_key(drawn, keys, order, int(most), "_rank").where(F.col("_rank") <= F.col("n"))
    return kept.withColumn("reused", F.col("_old").isNotNull()).drop("_old", "_draw", "_rank", "n")


def candidate_positives(manifest: DataFrame, seed: int = 42) -> DataFrame:
    quotas = manifest.sparkSession.createDataFrame(list(fixed.QUOTAS.items()), "target_api string, quota int")
    kept = quota_sample(manifest, "target_api", quotas, ["candidate_id"], seed)
    return kept.select(
        "candidate_id", "sample_id", "sample_idx", F.element_at(F.split("target_api", "[.]"), 1).alias("library"),
        F.col("library").alias("sample_library"), "cohort", F.lit("candidate_positive").alias("stratum"),
        F.lit("manifest_candidate").alias("sub_stratum"), "target_api", "client_line", "column", "call_site_snippet",
        "enclosing_code", F.lit(True).alias("stage3_preview_decision"),
        F.lit("Directly invokes target deprecated API symbol.").alias("stage3_preview_rationale"),
        F.lit(True).alias("expected_ground_truth"), F.lit("unannotated").alias("annotation_status"),
        F.lit(None).cast("boolean").alias("is_deprecated_call"))


def _pool_calls(samples: DataFrame, pools: list[tuple], first_only: bool) -> DataFrame:
    """Calls of the pools' callees in the samples that pass the pools' text filter.

    Pools are (pool, tag, libraries, category or None, words, callees, number, first index, last index). A sample is read once: its words are
    found by one automaton for all pools, and it is parsed if any pool may use it. Nothing is joined.
    """
    texts = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    dims = F.array(*[
        F.struct(
            F.lit(pool).alias("pool"), F.lit(tag).alias("tag"), texts(libraries).alias("libraries"), F.lit(only).cast("string").alias("only"),
            texts(words).alias("words"), F.create_map(*[F.lit(x) for kv in callees.items() for x in kv]).alias("callees"),
            F.lit(n).alias("quota"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        for pool, tag, libraries, only, words, callees, n, lo, hi in pools])
    open_ = F.filter(dims, lambda p: F.array_contains(p["libraries"], F.col("library")) & (p["only"].isNull() | (p["only"] == F.col("category")))
                     & F.col("sample_idx").between(p["lo"], p["hi"]))
    rows = samples.withColumn("_open", open_).where(F.size("_open") > 0)
    words = sorted({w for p in pools for w in p[4]})
    rows = rows.withColumn("_m", marked_calls(F.col("function"), F.exists("_open", lambda p: F.size(p["words"]) == 0), words))
    serves = F.filter("_open", lambda p: (F.size(p["words"]) == 0) | F.arrays_overlap(p["words"], F.col("_m.found")))
    # explode_outer keeps the optimizer from parsing twice
    j = rows.select("*", F.explode_outer(serves).alias("p")).where(F.col("p").isNotNull())
    hits = F.filter("_m.calls", lambda c: c["kind"].isin("name", "attribute") & F.map_contains_key(F.col("p.callees"), c["callee"]))
    hits = F.slice(hits, 1, 1) if first_only else hits
    j = j.select("*", F.explode_outer(hits).alias("c")).where(F.col("c").isNotNull())
    line = F.try_element_at(F.split("function", "\r?\n"), F.col("c.line"))
    return j.select(
        F.concat_ws("_", "sample_id", "p.tag", F.col("c.line").cast("string"), F.col("c.node_col").cast("string")).alias("candidate_id"),
        "sample_id", "sample_idx", "library", F.col("category").alias("cohort"), F.col("p.pool").alias("sub_stratum"),
        F.element_at("p.callees", F.col("c.callee")).alias("target_api"), F.col("c.line").alias("client_line"),
        F.col("c.node_col").alias("column"), strip(line).alias("call_site_snippet"),
        F.col("function").alias("enclosing_code"), F.col("c.callee").alias("callee"), F.col("p.pool").alias("pool"), F.col("p.quota").alias("quota"))


def pipeline_misses(samples: DataFrame, seed: int = 42) -> DataFrame:
    pools = [(kind, tag, ["scipy"], None, [], {callee: target}, n, lo, hi) for callee, tag, kind, target, lo, hi, n in fixed.MISS_POOLS]
    calls = _pool_calls(samples, pools, first_only=False)
    kept = _draw_pools(calls, seed, ["sample_id", "client_line", "column"])
    return kept.select("*", F.lit("pipeline_miss").alias("stratum"), F.lit(True).alias("expected_ground_truth"),
                       F.lit("pre_labeled").alias("annotation_status"), F.lit(True).alias("is_deprecated_call"))


def hard_negatives(samples: DataFrame, used: DataFrame, seed: int = 42) -> DataFrame:
    """Lookalike calls of seven pools, from samples that are neither used nor blocked."""
    spark = samples.sparkSession
    blocked = spark.createDataFrame([(s,) for s in fixed.CALIBRATION_SAMPLES], "sample_id string").unionByName(
        used.select("sample_id")).distinct()
    fresh = samples.join(blocked, "sample_id", "left_anti")
    top = 2**31 - 1
    pools = [(*pool, 0, top) for pool in fixed.NEGATIVE_POOLS]
    calls = _pool_calls(fresh, pools, first_only=True)
    kept = _draw_pools(calls, seed, ["candidate_id"])
    return kept.select("*", F.lit("hard_negative").alias("stratum"), F.lit(False).alias("expected_ground_truth"),
                       F.lit("unannotated").alias("annotation_status"), F.lit(None).cast("boolean").alias("is_deprecated_call"))


def _draw_pools(calls: DataFrame, seed: int, ids: list[str]) -> DataFrame:
    most = max(p[-1] for p in [*fixed.NEGATIVE_POOLS, *fixed.MISS_POOLS])
    drawn = calls.withColumn("_draw", draw(seed, *[F.col(i) for i in ids]))
    kept = top_per_key(drawn, ["pool"], [F.col("_draw"), *[F.col(i) for i in ids]], most, "_rank")
    return kept.where(F.col("_rank") <= F.col("quota")).drop("_draw", "_rank", "pool", "quota", "callee")


def label_anomalies(samples: DataFrame) -> DataFrame:
    dim = samples.sparkSession.createDataFrame(
        fixed.ANOMALIES, "sample_id string, sample_idx int, sub_stratum string, target_api string, client_line int, "
        "column int, call_site_snippet string")
    return F.broadcast(dim).join(samples.select("sample_id", F.col("function").alias("enclosing_code")), "sample_id").select(
        F.concat_ws("_", "sample_id", F.lit("label_anomaly"), F.col("client_line").cast("string"),
                    F.col("column").cast("string")).alias("candidate_id"),
        "sample_id", "sample_idx", F.lit("scipy").alias("library"), F.lit("outdated").alias("cohort"),
        F.lit("label_anomaly").alias("stratum"), "sub_stratum", "target_api", "client_line", "column",
        "call_site_snippet", "enclosing_code", F.lit(False).alias("expected_ground_truth"),
        F.lit("pre_labeled").alias("annotation_status"), F.lit(False).alias("is_deprecated_call"))


def assemble_benchmark(manifest: DataFrame, samples: DataFrame, seed: int = 42) -> DataFrame:
    """Positives, misses, anomalies and hard negatives, shuffled and numbered."""
    pos, miss, odd = candidate_positives(manifest, seed), pipeline_misses(samples, seed), label_anomalies(samples)
    used = pos.select("sample_id").unionByName(miss.select("sample_id")).unionByName(odd.select("sample_id"))
    neg = hard_negatives(samples, used, seed)
    rows = pos
    for part in (miss, odd, neg):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return numbered(rows, draw(seed, F.col("candidate_id")))


def benchmark_checks(benchmark: DataFrame) -> DataFrame:
    """One row per expectation about the assembled benchmark."""
    calibration = F.col("sample_id").isin(fixed.CALIBRATION_SAMPLES)
    return expectations(
        {"total": F.count("*"), "positive": F.count_if("expected_ground_truth"),
         "negative": F.count_if(~F.col("expected_ground_truth")),
         "contaminated": F.count_if((F.col("stratum") == "hard_negative") & calibration)},
        {"total": 150, "positive": 108, "negative": 42, "contaminated": 0}, benchmark)


def fresh_wrapper_rows(manifest: DataFrame, benchmark: DataFrame, in_call: list[str] = fixed.WRAPPER_WORDS,
                       in_code: list[str] = fixed.WRAPPER_WORDS) -> DataFrame:
    """Wrapper-related candidates of samples that the benchmark does not use: those with a word in their call or in the code around it."""
    related = contains_any(F.lower("call_site_snippet"), in_call) | contains_any(F.lower("enclosing_code"), in_code)
    pandas_only = F.contains("target_api", F.lit("pandas")) | (F.col("library") == "pandas")
    return manifest.join(benchmark.select("sample_id").distinct(), "sample_id", "left_anti").where(related & pandas_only)
