"""Receiver audits and the second label set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.keys import cache_key
from wane.functions.names import leaf
from wane.functions.syntax import snippet_calls
from wane.functions.text import contains_any, strip

DIRECT = "<direct_call>"


def receiver_of_call(items: DataFrame, code: str = "enclosing_code", line: str = "client_line",
                     target: str = "target_api") -> DataFrame:
    """Source text of the receiver of the marked call; null when the line does not call the target."""
    s = items.withColumn("_s", snippet_calls(F.col(code)))
    hits = F.filter("_s.calls", lambda c: (c["line"] == F.col(line)) & c["kind"].isin("name", "attribute")
                    & (c["callee"] == leaf(F.col(target))))
    last = F.try_element_at(hits, F.lit(-1))
    expr = F.when(last["kind"] == "name", F.lit(DIRECT)).otherwise(last["receiver_expr"])
    return s.withColumn("receiver_expr", expr).drop("_s")


def receiver_category(receiver: Column, snippet: Column) -> Column:
    """Kind of receiver; the order of the rules decides."""
    low = F.lower(receiver)
    rule = F.when(receiver == DIRECT, F.lit("module_import"))
    for name, words in fixed.RECEIVER_WORDS:
        rule = rule.when(contains_any(low, words), F.lit(name))
    unknown = F.when(F.contains(snippet, F.lit("itertools.product")), F.lit("standard_library")).otherwise(F.lit("native_library"))
    return F.when(receiver.isNull(), unknown).otherwise(rule.otherwise(F.lit("native_inferred")))


def audit_receivers(items: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Receiver, its category and whether the target is called; hand-made findings win."""
    r = receiver_of_call(items)
    snippet = F.col("call_site_snippet")
    collision = F.col("receiver_expr").isNull() & F.contains(snippet, F.lit("itertools.product"))
    r = r.withColumn("receiver_category", receiver_category(F.col("receiver_expr"), snippet))
    r = r.withColumn("invokes_target_api", ~collision).withColumn("receiver_expr", F.coalesce(
        "receiver_expr", F.when(collision, F.lit("itertools")).otherwise(F.lit("<native_call>"))))
    if overrides is None:
        return r
    o = overrides.select(
        "benchmark_id", F.col("receiver_expr").alias("_e"), F.col("receiver_category").alias("_c"),
        F.col("invokes_target_api").alias("_i"))
    j = r.join(o, "benchmark_id", "left")
    return j.withColumn("receiver_expr", F.coalesce("_e", "receiver_expr")).withColumn(
        "receiver_category", F.coalesce("_c", "receiver_category")).withColumn(
        "invokes_target_api", F.coalesce("_i", "invokes_target_api")).drop("_e", "_c", "_i")


def second_labels(items: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Second label set: the first one with adjudicated rows replaced."""
    if overrides is None:
        overrides = items.sparkSession.createDataFrame(
            fixed.LABEL_OVERRIDES, "benchmark_id string, label boolean, reason string")
    j = items.join(overrides, "benchmark_id", "left")
    changed = F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("is_deprecated_call"))
    return j.withColumn("v1_label", F.col("is_deprecated_call")).withColumn("label_changed", changed).withColumn(
        "is_deprecated_call", F.coalesce("label", "is_deprecated_call")).withColumn(
        "adjudication_notes", F.when(changed, F.col("reason"))).withColumn(
        "label_set_version", F.lit("v2_adjudicated")).drop("label", "reason")


def low_confidence_rule(snippet: Column, code: Column, target: Column, sample: Column) -> Column:
    """Receiver category of a low-confidence candidate; anything but native is benign."""
    texts = {"snippet": snippet, "code": code}
    result = F.lit(fixed.LOW_CONFIDENCE_DEFAULT)
    for category, only, targets, alternatives in reversed(fixed.LOW_CONFIDENCE_RULES):
        holds = F.lit(False)
        for tests in alternatives:
            all_hold = F.lit(True)
            for text, words, any_case in tests:
                all_hold = all_hold & contains_any(F.lower(texts[text]) if any_case else texts[text], words)
            holds = holds | all_hold
        if targets:
            holds = holds & contains_any(target, targets)
        if only:
            holds = holds & sample.eqNullSafe(F.lit(only))
        result = F.when(holds, F.lit(category)).otherwise(result)
    return result


def audit_low_confidence(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    low = predictions.where((F.col("mode") == "inference") | (F.col("stage2_status") == "low_confidence"))
    j = low.join(manifest.select("candidate_id", "enclosing_code"), "candidate_id", "left")
    rule = low_confidence_rule(F.col("call_site_snippet"), F.coalesce("enclosing_code", F.lit("")),
                               F.col("target_api"), F.col("sample_id"))
    j = j.withColumn("receiver_category", rule).withColumn(
        "ground_truth", F.col("receiver_category").isin("native_scipy", "native_library"))
    return j.withColumn("correct", F.col("is_deprecated_usage") == F.col("ground_truth")).drop("enclosing_code")


def call_receiver_label(snippet: Column) -> Column:
    """True for a native receiver in the call, false for anything else; wrappers decide before stylers."""
    s = strip(snippet)
    return (
        F.when(contains_any(s, fixed.NATIVE_CALL_WORDS), True)
        .when(contains_any(s, fixed.WRAPPER_CALL_WORDS), False)
        .otherwise(F.contains(s, F.lit("styler."))))


def wrapper_evaluation(rows: DataFrame, model: str = "primary") -> DataFrame:
    """Receiver rule on fresh wrapper rows, and that the two prompt versions never share a key."""
    grounds = F.coalesce(
        F.when(F.col("recommended_replacement") != "", F.col("recommended_replacement")),
        F.when(F.col("evidence_warning") != "", F.col("evidence_warning")),
        F.lit("Deprecation verified in historical API catalog."))
    key = lambda version: cache_key(F.lit(model), F.lit(version), F.col("call_site_snippet"), F.col("target_api"), grounds)
    native = call_receiver_label(F.col("call_site_snippet"))
    return rows.select(
        "candidate_id", "sample_id", "target_api", F.col("call_site_snippet").alias("call_site"),
        F.when(native, F.lit("native_pandas")).otherwise(F.lit("wrapper_lookalike")).alias("receiver_type"),
        native.alias("ground_truth_under_receiver_rule"),
        key(fixed.PROMPT_VERSION).alias("cache_key_v1"), key(fixed.PROMPT_VERSION_RECEIVER).alias("cache_key_v2"))
