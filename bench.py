"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Each query is run once
to warm up and then timed into a sink that keeps every column.
"""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "candidate_union", "scope_isolation", "find_candidates", "build_catalog", "symbol_first_match", "target_coverage",
    "evidence_fill", "call_statuses", "outcome_report", "build_manifest", "stage_predictions", "reconcile_channels",
    "mypy_diagnostics", "cache_keys", "cache_hit_miss", "cache_upsert", "stage_report", "conditional_metrics", "contingency",
    "mcnemar_exact", "bootstrap_ci", "quota_sample", "proportional_sample", "sequence_ids", "annotation_status",
    "api_profile", "line_numbers",
]


def installed_tree(spark) -> dict[str, float]:
    """Seconds from the files of an installed package to its catalog, cold and warm (median of three)."""
    from wane.operators.catalog import union_candidates
    from wane.operators.declarations import find_candidates
    from wane.sources.trees import scan_tree

    root = importlib.util.find_spec("pandas").submodule_search_locations[0]
    took = []
    for _ in range(4):
        start = time.perf_counter()
        files = scan_tree(spark, f"file://{root}", "pandas", "installed").where("error is null").drop("error")
        union_candidates(find_candidates(files)).write.format("noop").mode("overwrite").save()
        took.append(round(time.perf_counter() - start, 3))
    return {"installed_tree_cold": took[0], "installed_tree": sorted(took[1:])[1]}


def main() -> None:
    from wane.plans.queries import QUERIES
    from wane.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores))
    times = {}
    for name in only:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    if not sys.argv[1:]:
        times |= installed_tree(spark)
    files = spark.read.parquet(f"{folder}/part.parquet").count()
    snippets = spark.read.parquet(f"{folder}/customer.parquet").count()
    rates = {}
    if "find_candidates" in times:
        rates["files_per_sec"] = round(files / times["find_candidates"], 1)
    if "call_statuses" in times:
        rates["snippets_per_sec"] = round(snippets / times["call_statuses"], 1)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cores": cores, "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
