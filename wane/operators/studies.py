"""Whole verification runs: sample, ask, compare, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.operators.agreement import agreement
from wane.operators.sampling import fixed_allocation, proportional_sample, quota_sample
from wane.operators.verification import add_zero_shot_key, code_verifier, compare_models, rule_verifier, verify


def second_opinion(chosen: DataFrame, requests: DataFrame, cache: DataFrame, verifier=rule_verifier, model: str = "second",
                   store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions of both models on the chosen predictions, cache with the new responses)."""
    asked = requests.join(chosen.select("candidate_id"), "candidate_id", "left_semi")
    verdicts, known = verify(asked, cache, verifier, model, store=store)
    return compare_models(verdicts, chosen), known


def stratified_validation(primary: DataFrame, requests: DataFrame, cache: DataFrame, size: int, verifier=rule_verifier, model: str = "second",
                          strata: tuple[str, ...] = ("library", "is_deprecated_usage"), seed: int = 42, store: str | None = None):
    """A proportional sample of the primary predictions, verified by a second model: (pairs, agreement, cache)."""
    chosen = proportional_sample(primary, list(strata), size, ["candidate_id"], seed)
    pairs, known = second_opinion(chosen, requests, cache, verifier, model, store)
    return pairs, agreement(pairs, "primary_decision", "validation_decision"), known


def low_confidence_validation(primary: DataFrame, requests: DataFrame, cache: DataFrame, before: DataFrame, verifier=rule_verifier,
                              model: str = "second", allocation: list[tuple] = fixed.VALIDATION_ALLOCATION, seed: int = 42, store: str | None = None):
    """A fixed number of low-confidence predictions per (library, verdict), those of an earlier run first.

    Returns (pairs, their agreement, agreement of these and the earlier pairs together, cache); a candidate of both counts once.
    """
    low = primary.where((F.col("mode") == "inference") | (F.col("stage2_status") == "low_confidence"))
    wanted = primary.sparkSession.createDataFrame(allocation, "library string, is_deprecated_usage boolean, n int")
    chosen = fixed_allocation(low, ["library", "is_deprecated_usage"], wanted, before, ["candidate_id"], seed)
    pairs, known = second_opinion(chosen, requests, cache, verifier, model, store)
    other = before.join(pairs.select("candidate_id"), "candidate_id", "left_anti")
    columns = ["candidate_id", "primary_decision", "validation_decision"]
    both = pairs.select(columns).unionByName(other.select(columns))
    measure = lambda rows: agreement(rows, "primary_decision", "validation_decision", edge="zero")
    return pairs, measure(pairs), measure(both), known


def zero_shot_run(requests: DataFrame, cache: DataFrame, verifier=code_verifier, model: str = "zero_shot", store: str | None = None):
    """(predictions, cache) of a model that sees only the line and its code; its cache has keys of its own."""
    return verify(requests, cache, verifier, model, store=store, key=lambda rows: add_zero_shot_key(rows, model))


def second_pass_sample(annotated: DataFrame, quotas: dict[str, int] = fixed.SECOND_PASS_QUOTAS, seed: int = 42) -> DataFrame:
    """Rows for the blinded second pass: so many of each stratum among those a person has labelled."""
    own = annotated.where(~F.col("annotation_status").eqNullSafe(F.lit("pre_labeled")))
    wanted = annotated.sparkSession.createDataFrame(list(quotas.items()), "stratum string, quota int")
    return quota_sample(own, "stratum", wanted, ["benchmark_id"], seed)
