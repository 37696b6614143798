"""Verify candidates through a keyed response cache and a pluggable verifier."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.keys import cache_key, draw, evidence_text, zero_shot_key
from wane.functions.text import contains_any
from wane.operators.agreement import half_even
from wane.sinks.store import COLUMNS as STORED
from wane.sinks.store import ResponseStore

DECISION = "struct<is_deprecated_usage:boolean,confidence:double,rationale:string>"
RESPONSE = "cache_key string, response_json string, prompt_tokens int, candidate_tokens int, total_tokens int"


def prompt(version: str = fixed.PROMPT_VERSION) -> Column:
    """Question put to a verifier; two modes, and a receiver rule in the later version."""
    by_receiver = version == fixed.PROMPT_VERSION_RECEIVER
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"- {label}: "), c))
    evidence = F.concat_ws(
        "\n", part("Replacement", "recommended_replacement"), part("Warning", "evidence_warning"),
        part("Docstring", "evidence_docstring"))
    head = F.concat(
        F.lit(f"Prompt {version}\nTarget: "), "target_api", F.lit(" of "), "library",
        F.lit("\nLine "), F.coalesce(F.col("client_line").cast("string"), F.lit("?")), F.lit(": "), "call_site_snippet",
        F.lit("\nEvidence:\n"), F.when(evidence == "", F.lit("- listed in the catalog")).otherwise(evidence),
        F.lit("\nCode:\n"), "enclosing_code", F.lit("\n"))
    confirm = F.lit(
        "Static analysis resolved this call to the target. Say whether it is an active use: not a guarded "
        "fallback, not another call on the same line, not a lookalike of another package.\n")
    infer = F.concat(
        F.lit("The receiver could not be resolved ("), F.coalesce("failure_reason", F.lit("unresolved_receiver")),
        F.lit("). Infer its type from the code; lower the confidence where the type stays open.\n"))
    receiver = F.lit(
        "A native receiver makes it a deprecated use, a third-party wrapper receiver does not; judge the "
        "flagged call by its own receiver even if the line also calls the other kind.\n"
        if by_receiver else
        "A call on a third-party wrapper is not a use of the library.\n")
    ask = F.lit('Answer with JSON: {"is_deprecated_usage": bool, "confidence": 0..1, "rationale": text}')
    return F.concat(head, F.when(F.col("mode") == "confirmation", confirm).otherwise(infer), receiver, ask)


def zero_shot_prompt() -> Column:
    return F.concat(
        F.lit("Does line "), F.col("client_line").cast("string"), F.lit(" call a deprecated Python API, for example of "),
        "library", F.lit("?\n"), "call_site_snippet", F.lit("\nCode:\n"), "enclosing_code",
        F.lit("\nBenign calls, replacements and inactive fallbacks are not. Answer as JSON."))


def add_key(requests: DataFrame, model: str, version: str = fixed.PROMPT_VERSION, with_context: bool = True) -> DataFrame:
    """Add the cache key; ``with_context=False`` gives the key without mode and code."""
    context = [F.col("mode"), F.col("enclosing_code")] if with_context else []
    return requests.withColumn("cache_key", cache_key(
        F.lit(model), F.lit(version), F.col("call_site_snippet"), F.col("target_api"),
        evidence_text(F.col("evidence_docstring"), F.col("evidence_warning"), F.col("recommended_replacement")),
        *context))


def add_zero_shot_key(requests: DataFrame, model: str) -> DataFrame:
    return requests.withColumn("cache_key", zero_shot_key(F.lit(model), F.col("client_line"), zero_shot_prompt()))


def rule_response() -> Column:
    """Offline verdict as JSON text: the receiver in the call decides."""
    call = F.col("call_site_snippet")
    native = contains_any(call, fixed.NATIVE_CALL_WORDS)
    wrapper = contains_any(call, fixed.WRAPPER_CALL_WORDS)
    stdlib = F.contains(call, F.lit("itertools."))
    verdict = F.when(native, True).when(wrapper | stdlib, False).otherwise(True)
    sure = F.when(native | wrapper | stdlib, 0.95).otherwise(
        F.when(F.col("mode") == "confirmation", 0.9).otherwise(0.75))
    why = (
        F.when(native, F.lit("native receiver")).when(wrapper, F.lit("wrapper receiver"))
        .when(stdlib, F.lit("standard library")).otherwise(F.lit("no sign of another receiver")))
    return F.to_json(F.struct(
        verdict.alias("is_deprecated_usage"), sure.alias("confidence"), why.alias("rationale")))


def rule_verifier(misses: DataFrame) -> DataFrame:
    """Deterministic verifier without a model; sizes stand in for token counts."""
    used = F.ceil(F.length(prompt()) / 4).cast("int")
    said = F.ceil(F.length("response_json") / 4).cast("int")
    r = misses.withColumn("response_json", rule_response())
    return r.select("cache_key", "response_json", used.alias("prompt_tokens"), said.alias("candidate_tokens"),
                    (used + said).alias("total_tokens"))


rule_verifier.repeatable = True  # the same answers each time, at no cost


def code_verifier(misses: DataFrame) -> DataFrame:
    """The rule applied to the whole code of a request instead of its call."""
    return rule_verifier(misses.withColumn("call_site_snippet", F.col("enclosing_code")))


code_verifier.repeatable = True


def remote_verifier(send: Callable[[str], tuple[str, int, int]], parallel: int = 5, interval: float = 0.2,
                    attempts: int = 5, version: str = fixed.PROMPT_VERSION, text: Column | None = None):
    """Verifier that asks a service: paced per task, with exponential back-off.

    ``send`` takes a prompt and returns (text, prompt tokens, answer tokens). Whatever it raises is tried
    again up to the limit; then the request stays without an answer, and the others keep theirs. ``text`` is another prompt, such as the zero-shot one. The number of tasks bounds the load on the service, not on Spark.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["cache_key"], batch["prompt"]):
                for attempt in range(attempts):
                    time.sleep(interval)
                    try:
                        answer, used, said = send(text)
                        rows.append((key, answer.strip(), used, said, used + said))
                        break
                    except Exception:
                        if attempt < attempts - 1:
                            time.sleep(2 ** attempt + random.uniform(0.5, 1.5))
            yield pd.DataFrame(rows, columns=["cache_key", "response_json", "prompt_tokens", "candidate_tokens", "total_tokens"])

    def verify(misses: DataFrame) -> DataFrame:
        asked = misses.select("cache_key", (prompt(version) if text is None else text).alias("prompt")).repartition(parallel, "cache_key")
        return asked.mapInPandas(ask, RESPONSE)

    return verify


def decode(response: Column) -> Column:
    """Typed decision from JSON text; anything invalid becomes a safe negative."""
    d = F.from_json(response, DECISION)
    # a number in quotes or a missing field must not pass
    valid = (
        d["is_deprecated_usage"].isNotNull() & d["confidence"].between(0.0, 1.0) & d["rationale"].isNotNull())
    bad = F.struct(
        F.lit(False).alias("is_deprecated_usage"), F.lit(0.0).alias("confidence"),
        F.concat(F.lit("Failed to parse JSON response: "), F.substring(F.coalesce(response, F.lit("")), 1, 100)).alias("rationale"))
    return F.when(F.coalesce(valid, F.lit(False)), d).otherwise(bad)


ANSWER = ("response_json", "prompt_tokens", "candidate_tokens", "total_tokens")


def split_by_cache(keyed: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests to be asked, keys): one request per key that the cache does not hold; every key with its first candidate and stored answer.

    Keys are matched on their own; the request text joins afterwards.
    """
    keys = keyed.groupBy("cache_key").agg(F.min("candidate_id").alias("_first")).join(
        cache.select("cache_key", *ANSWER), "cache_key", "left")
    missing = keys.where("response_json is null").select("cache_key", F.col("_first").alias("candidate_id"))
    return keyed.join(missing, ["cache_key", "candidate_id"], "left_semi"), keys


def responses_of(misses: DataFrame, verifier, model: str, version: str) -> DataFrame:
    """What a verifier says about the requests, as rows of the cache."""
    fresh = verifier(misses).withColumn("created_at", F.current_timestamp())
    about = misses.select("cache_key", "target_api", "call_site_snippet", evidence_text(
        F.col("evidence_docstring"), F.col("evidence_warning"), F.col("recommended_replacement")).alias("evidence_snippet"))
    return fresh.join(about, "cache_key").select(
        "cache_key", F.lit(model).alias("model_name"), F.lit(version).alias("prompt_version"),
        F.col("target_api").alias("api_name"), F.col("call_site_snippet").alias("call_site_text"), "evidence_snippet",
        F.to_json(decode(F.col("response_json"))).alias("response_json"),
        "prompt_tokens", "candidate_tokens", "total_tokens", "created_at")


def predictions_of(keyed: DataFrame, keys: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """Every request with its answer, stored or fresh; one without an answer stays, as a negative that says so."""
    said = fresh.select("cache_key", *[F.col(c).alias(f"_{c}") for c in ANSWER])
    answers = keys.join(said, "cache_key", "left").select(
        "cache_key", "_first", F.col("response_json").isNull().alias("_asked"), *[F.coalesce(c, f"_{c}").alias(c) for c in ANSWER])
    out = keyed.join(answers, "cache_key", "left")
    unanswered = F.struct(F.lit(False).alias("is_deprecated_usage"), F.lit(0.0).alias("confidence"), F.lit(fixed.NO_ANSWER).alias("rationale"))
    d = F.when(F.col("response_json").isNull(), unanswered).otherwise(decode(F.col("response_json")))
    kept = [c for c in ("candidate_id", "sample_id", "sample_idx", "library", "cohort", "stage2_status", "mode",
                        "target_api", "client_line", "column", "call_site_snippet", "failure_reason") if c in out.columns]
    asked = F.col("_asked") & (F.col("candidate_id") == F.col("_first"))
    return out.select(
        *kept, F.array().cast("array<string>").alias("origin_channels"), F.lit(model).alias("model"),
        (F.col("response_json").isNotNull() & ~F.coalesce(asked, F.lit(False))).alias("cached"), "cache_key",
        d["is_deprecated_usage"].alias("is_deprecated_usage"), d["confidence"].alias("confidence"),
        d["rationale"].alias("rationale"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.coalesce("candidate_tokens", F.lit(0)).alias("candidate_tokens"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))


def verify(requests: DataFrame, cache: DataFrame, verifier=rule_verifier, model: str = "primary",
           version: str = fixed.PROMPT_VERSION, with_context: bool = True, store: str | None = None, key=None):
    """Return (predictions, cache with the new responses). The cache has one row for each key.

    ``store`` is a folder in shared storage for the responses of this run. Only a verifier that is
    marked ``repeatable`` may go without: all other responses are written there once and read back, so
    that lost executors or reuse of the result do not repeat calls. ``key`` adds another cache key than that of the evidence prompt.
    """
    if store is None and not getattr(verifier, "repeatable", False):
        raise ValueError("store must name a shared folder for the responses of this verifier")
    keyed = key(requests) if key else add_key(requests, model, version, with_context)
    misses, keys = split_by_cache(keyed, cache)
    fresh = responses_of(misses, verifier, model, version)
    if store is not None:
        fresh.write.mode("overwrite").parquet(store)
        fresh = requests.sparkSession.read.parquet(store)
    return predictions_of(keyed, keys, fresh, model), cache.unionByName(fresh, allowMissingColumns=True)


def verify_with_store(requests: DataFrame, store: ResponseStore, verifier=rule_verifier, model: str = "primary",
                      version: str = fixed.PROMPT_VERSION, with_context: bool = True, run: int | None = None, key=None) -> DataFrame:
    """Predictions from a log of responses; new ones are appended to it as one part, before any is used.

    Only the partitions of the batch's keys are read. With ``run``, parts of later runs are left out, so a batch that is repeated after a
    failure asks and answers the same as before.
    """
    keyed = key(requests) if key else add_key(requests, model, version, with_context)
    run = store.next_run() if run is None else run
    hits = store.lookup(keyed, before=run)
    misses, keys = split_by_cache(keyed, hits)
    store.append(responses_of(misses, verifier, model, version), run)
    part = store.spark.read.schema(STORED).parquet(f"{store.root}/part=run-{run:09d}")
    return predictions_of(keyed, keys, part, model)


def telemetry(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    """Calls, hits, hit rate, tokens of the calls, and their estimated cost."""
    miss = ~F.col("cached")
    used = F.coalesce(F.sum(F.when(miss, F.col("prompt_tokens"))), F.lit(0))
    said = F.coalesce(F.sum(F.when(miss, F.col("candidate_tokens"))), F.lit(0))
    price_in, price_out = fixed.PRIMARY_PRICE
    return predictions.groupBy(*by).agg(
        F.count("*").alias("total_requests"), F.count_if(miss).alias("api_calls"),
        F.count_if("cached").alias("cache_hits"),
        F.coalesce(half_even(F.try_divide(F.count_if("cached") * 100.0, F.count("*")), 2), F.lit(0.0)).alias("cache_hit_rate_pct"),
        used.alias("prompt_tokens"), said.alias("candidate_tokens"), (used + said).alias("total_tokens"),
        half_even(used / 1e6 * price_in + said / 1e6 * price_out, 4).alias("estimated_cost_usd"))


def validation_cost(n: Column) -> Column:
    (price_in, price_out), (t_in, t_out) = fixed.VALIDATION_PRICE, fixed.VALIDATION_TOKENS
    return n * t_in / 1e6 * price_in + n * t_out / 1e6 * price_out


def compare_models(validation: DataFrame, primary: DataFrame) -> DataFrame:
    """Validation verdicts next to the primary ones; a missing primary stays null."""
    p = primary.select(
        "candidate_id", F.col("model").alias("primary_model"), F.col("is_deprecated_usage").alias("primary_decision"),
        F.col("confidence").alias("primary_confidence"), F.col("rationale").alias("primary_rationale"))
    j = validation.join(p, "candidate_id", "left")
    return j.select(
        "candidate_id", "sample_id", "target_api", "primary_model", "primary_decision", "primary_confidence",
        "primary_rationale", F.col("model").alias("validation_model"),
        F.col("is_deprecated_usage").alias("validation_decision"), F.col("confidence").alias("validation_confidence"),
        F.col("rationale").alias("validation_rationale"),
        F.col("primary_decision").eqNullSafe(F.col("is_deprecated_usage")).alias("agreement"), "cached")


def spot_check(samples: DataFrame, cache: DataFrame, size: int = 40, seed: int = 42, verifier=rule_verifier):
    """Ask about whole up-to-date snippets; (verdicts, clean rate)."""
    pool = samples.where(F.col("category").isin("up-to-dated", "up-to-date")).withColumn("_d", draw(seed, F.col("sample_id")))
    chosen = pool.orderBy("_d").limit(size)
    null = F.lit(None).cast("string")
    requests = chosen.select(
        F.col("sample_id").alias("candidate_id"), "sample_id", "library",
        F.concat("library", F.lit(".general_audit")).alias("target_api"),
        F.lit("general_snippet_audit").alias("call_site_snippet"), F.lit(1).alias("client_line"),
        F.col("function").alias("enclosing_code"), F.lit("benign_audit").alias("failure_reason"),
        F.lit("inference").alias("mode"), null.alias("recommended_replacement"), null.alias("evidence_warning"),
        null.alias("evidence_docstring"))
    verdicts, _ = verify(requests, cache, verifier)
    flagged = F.count_if("is_deprecated_usage")
    report = verdicts.agg(
        F.count("*").alias("total_spot_checked"), (F.count("*") - flagged).alias("clean_count"),
        flagged.alias("latent_deprecated_flagged"),
        F.coalesce(half_even(F.try_divide((F.count("*") - flagged) * 100.0, F.count("*")), 2), F.lit(0.0)).alias("clean_rate_pct"))
    return verdicts, report


def empty_cache(spark) -> DataFrame:
    return spark.createDataFrame([], STORED)
