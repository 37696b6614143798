"""Resolve the calls of client snippets and match them to the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.keys import candidate_id
from wane.functions.names import compatible, leaf
from wane.functions.syntax import snippet_calls
from wane.operators.bindings import symbols
from wane.operators.evidence import add_evidence
from wane.operators.matching import first_match, leaf_lookup, match_target
from wane.operators.reexports import traced
from wane.session import cut_lineage, local_rows

def baseline_preamble() -> Column:
    return F.lit("\n".join(fixed.BASELINE_IMPORTS) + "\n")


def reconstructed_preamble(alias_dict: Column) -> Column:
    """Fixed imports plus those that the aliases of a sample imply, without repeats."""
    module = lambda v: F.regexp_extract(v, r"^(.*)\.[^.]*$", 1)

    def line(e):
        k, v = e["key"], e["value"]
        return (
            F.when(~F.contains(k, F.lit(".")) & (module(v) != ""),
                   F.concat(F.lit("from "), module(v), F.lit(" import "), k))
            .when(k.startswith("DataFrame."), F.lit("from pandas import DataFrame"))
            .when(k.startswith("Series."), F.lit("from pandas import Series"))
            .when(k.startswith("Styler."), F.lit("from pandas.io.formats.style import Styler")))

    entries = F.array_sort(F.map_entries(F.coalesce(alias_dict, F.create_map().cast("map<string,string>"))))
    extra = F.filter(F.transform(entries, line), lambda x: x.isNotNull())
    lines = F.array_distinct(F.concat(F.array(*map(F.lit, fixed.RECONSTRUCTED_IMPORTS)), extra))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def parsed_calls(samples: DataFrame, catalog: DataFrame, name: str, code: str, carry: list[str], *preambles: Column) -> DataFrame:
    """Calls whose leaf name is in the catalog, with the symbols each may denote under every preamble: ``symbols_1`` and so on.

    One parse per snippet. A snippet that cannot be parsed is a row of its own. The result is checkpointed: it is small, is read
    more than once, and must not be parsed again.
    """
    parsed = samples.select(*carry, snippet_calls(F.col(code), *preambles).alias("s"))
    error = F.col("s.error")
    none = F.array().cast("array<string>")
    failed = F.struct(
        F.lit(0).alias("idx"), error["kind"].alias("kind"), F.concat(F.lit("<"), error["kind"], F.lit(">")).alias("callee"),
        F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("receiver_expr"), F.lit("").alias("scope"),
        none.alias("names"), F.lit(0).cast("bigint").alias("place"), F.array().cast("array<int>").alias("branch"),
        none.alias("wildcards"), error["line"].alias("line"), error["offset"].alias("col"), F.lit(0).alias("node_col"),
        error["text"].alias("text"))
    # explode_outer keeps the optimizer from parsing twice (see find_candidates)
    calls = parsed.select(
        *carry, F.col("s.bindings").alias("bindings"), error["message"].alias("message"),
        F.explode_outer(F.when(F.col("s.ok"), F.col("s.calls")).otherwise(F.array(failed))).alias("c")
    ).where(F.col("c").isNotNull()).select(*carry, "bindings", "message", "c.*", F.col("c").alias("call"))
    known = leaf_lookup(calls, catalog, name, only=list(ERRORS.values()))
    # names are followed after the leaf filter: most calls never get here
    found = [symbols(F.col("call"), F.col("bindings"), k).alias(f"symbols_{k}") for k in range(1, max(1, len(preambles)) + 1)]
    return cut_lineage(known.select(*[c for c in known.columns if c not in ("bindings", "call", "names", "scope", "place", "branch")], *found))


#: Kinds of rows that stand for snippets without calls.
ERRORS = {"syntax_error": "<syntax_error>", "resolver_error": "<resolver_error>"}


def call_statuses(samples: DataFrame, catalog: DataFrame, preamble: Column, name: str = "qualified_name",
                  order: list[str] | None = None, code: str = "function", carry: list[str] = ("sample_id", "library"),
                  aliases: DataFrame | None = None, returns: DataFrame | None = None) -> DataFrame:
    """One row per call whose leaf name is in the catalog, with its status.

    ``resolved_deprecated`` and ``resolved_benign`` calls resolve to an imported path that is, or is not, in the catalog; all others are
    ``low_confidence`` with a reason. Where several definitions reach a call, it is resolved if all of them are in the catalog or if all
    stand in one module; else it is ambiguous. ``aliases`` (from_symbol, to_symbol) and ``returns`` (function, made) are what
    ``operators.reexports`` finds in the libraries: they lead from the names that snippets use to those of the catalog.
    """
    known = parsed_calls(samples, catalog, name, code, carry, preamble)
    return statuses_of(known, catalog, name, order or [name], carry, 1, aliases, returns)


def compared_statuses(samples: DataFrame, catalog: DataFrame, preambles: dict[str, Column], name: str = "qualified_name",
                      order: list[str] | None = None, code: str = "function", carry: list[str] = ("sample_id", "library"),
                      aliases: DataFrame | None = None, returns: DataFrame | None = None) -> dict[str, DataFrame]:
    """The statuses under each of several preambles, from one parse."""
    known = parsed_calls(samples, catalog, name, code, carry, *preambles.values())
    return {p: statuses_of(known, catalog, name, order or [name], carry, k, aliases, returns) for k, p in enumerate(preambles, 1)}


def module_of(symbol: Column) -> Column:
    """The part of a symbol before its first capitalised part, or before its last part."""
    of_class = F.regexp_extract(symbol, r"^((?:[^.\p{Lu}][^.]*\.)*)\p{Lu}", 1)
    return F.when(of_class != "", of_class).otherwise(F.regexp_replace(symbol, r"[^.]*$", ""))


def statuses_of(known: DataFrame, catalog: DataFrame, name: str, order: list[str], carry: list[str], layer: int = 1,
                aliases: DataFrame | None = None, returns: DataFrame | None = None) -> DataFrame:
    """Statuses of parsed calls under one preamble.

    Each different set of symbols is looked up once, so neither a frequent call nor its code is moved by the matching.
    """
    usable = ~F.col("kind").isin("getattr", *ERRORS)
    mine = F.col(f"symbols_{layer}")
    if returns is None:
        mine = F.filter(mine, lambda x: ~F.contains(x, F.lit("()")))
    # the last wildcard import can supply a bare name that the catalog knows
    guess = F.when(F.size("wildcards") > 0, F.array(F.concat_ws(".", F.element_at("wildcards", -1), "callee")))
    firm = usable & (F.size(mine) > 0)
    known = known.withColumn("firm", firm).withColumn(
        "symbols", F.when(firm, mine).when(usable, guess))
    sets = known.where("symbols is not null").select("symbols").distinct()
    each = sets.select("symbols", F.posexplode("symbols").alias("k", "symbol"))
    if aliases is not None or returns is not None:
        each = traced(each, aliases, returns)
    found = first_match(each, "symbol", catalog, name, order, "matched")
    if "variant" in found.columns:
        best = F.struct(F.col("matched").isNull(), "variant", "symbol")
        found = found.groupBy("symbols", "k").agg(F.min_by("symbol", best).alias("symbol"), F.min_by("matched", best).alias("matched"))
    # one row for each different set of symbols
    lookup = found.groupBy("symbols").agg(
        F.min_by("symbol", F.struct(F.col("matched").isNull(), "k")).alias("symbol"), F.min_by("matched", F.struct(F.col("matched").isNull(), "k")).alias("matched"),
        F.count_distinct(module_of(F.col("symbol"))).alias("modules"), F.bool_and(F.col("matched").isNotNull()).alias("every"))
    # hashed on the lookup's side: calls of a frequent set, or of none, stream by and are never sorted in one task
    found = known.join(lookup.withColumnRenamed("symbols", "_set").hint("shuffle_hash"), F.col("symbols") == F.col("_set"), "left")
    several = F.coalesce(F.col("firm") & (F.col("modules") > 1) & ~F.col("every"), F.lit(False))
    hit = F.col("matched").isNotNull() & ~several
    error = F.col("kind").isin(*ERRORS)
    reason = (
        F.when(F.col("kind") == "syntax_error", F.lit("syntax_error"))
        .when(error, F.lit("jedi_exception"))
        .when(F.col("kind") == "getattr", F.lit("dynamic_dispatch"))
        .when(several, F.lit("ambiguous_definitions"))
        .when(F.col("receiver").isNotNull(), F.lit("unresolved_receiver"))
        .otherwise(F.lit("empty_goto")))
    details = (
        F.when(error, F.col("message"))
        .when(F.col("kind") == "getattr", F.lit("Dynamic invocation via getattr"))
        .when(several, F.concat(F.lit("Definitions in several modules: "), F.array_join(F.array_sort("symbols"), ", ")))
        .when(F.col("receiver").isNotNull(),
              F.concat(F.lit("Receiver '"), "receiver", F.lit("' could not be statically resolved")))
        .otherwise(F.lit("The name has no definition in the snippet or its imports")))
    status = (
        F.when(hit, F.lit("resolved_deprecated")).when(F.col("firm") & ~several & F.col("_set").isNotNull(), F.lit("resolved_benign"))
        .otherwise(F.lit("low_confidence")))
    low = F.col("status") == "low_confidence"
    return found.withColumn("status", status).select(
        *carry, "status", "idx", "callee", "receiver", "receiver_expr",
        F.col("line").alias("client_line"), F.col("col").alias("client_col"), "node_col",
        F.when(~low, F.col("symbol")).alias("qualified_name"),
        F.when(low & ~error, F.col("leaf_match")).when(~low, F.col("matched")).alias("matched"),
        F.when(low, reason).alias("reason"), F.when(low, details).alias("details"),
        F.col("text").alias("snippet"))


def call_counts(statuses: DataFrame, by: list[str] = ("library",)) -> DataFrame:
    """Calls per status, for each group and overall."""
    return statuses.rollup(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("resolved_deprecated", "resolved_benign", "low_confidence")])


def reason_counts(statuses: DataFrame) -> DataFrame:
    """Low-confidence calls per reason; reasons without calls count zero."""
    spark = statuses.sparkSession
    dim = local_rows(spark, [(r, i) for i, r in enumerate(fixed.FAILURE_REASONS)], "reason string, ord int")
    n = statuses.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return dim.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def sample_outcomes(samples: DataFrame, statuses: DataFrame, apis: str = "deprecated_api") -> DataFrame:
    """Whether the known deprecated APIs of each sample were found; six outcomes by cohort.

    ``statuses`` must carry the ``apis`` array of its sample.
    """
    fits = lambda c: F.exists(apis, lambda g: compatible(g, F.coalesce(c, F.lit(""))))
    resolved = (F.col("status") == "resolved_deprecated") & (fits(F.col("matched")) | fits(F.col("qualified_name")))
    low = (F.col("status") == "low_confidence") & (
        F.exists(apis, lambda g: leaf(g) == F.col("callee")) | fits(F.col("matched")))
    per = statuses.groupBy("sample_id").agg(
        F.bool_or(F.coalesce(resolved, F.lit(False))).alias("target_resolved"),
        F.bool_or(F.coalesce(low, F.lit(False))).alias("target_low"))
    all_samples = samples.select("sample_id", "library", "category").join(per, "sample_id", "left")
    r, l = F.coalesce("target_resolved", F.lit(False)), F.coalesce("target_low", F.lit(False))
    old = F.col("category") == "outdated"
    outcome = (
        F.when(old & r, F.lit("target_resolved_deprecated")).when(old & l, F.lit("target_in_low_confidence"))
        .when(old, F.lit("target_missed")).when(r, F.lit("spurious_deprecated_flagged"))
        .when(l, F.lit("clean_in_low_confidence")).otherwise(F.lit("clean_resolved_benign")))
    return all_samples.select(
        "sample_id", "library", F.when(old, F.lit("outdated")).otherwise(F.lit("up_to_dated")).alias("cohort"),
        outcome.alias("outcome"))


def outcome_transitions(before: DataFrame, after: DataFrame, by: list[str] = ("library", "cohort")) -> DataFrame:
    """Samples of each group by their outcome under one preamble and under another."""
    later = after.select("sample_id", F.col("outcome").alias("outcome_after"))
    return before.withColumnRenamed("outcome", "outcome_before").join(later, "sample_id").groupBy(
        *by, "outcome_before", "outcome_after").agg(F.count("*").alias("n"))


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """Samples per library, per cohort and outcome, and both."""
    return outcomes.groupingSets(
        [["library"], [], ["library", "cohort", "outcome"], ["cohort", "outcome"]],
        "library", "cohort", "outcome",
    ).agg(F.count("*").alias("n"))


def by_sample(df: DataFrame, folder: str, buckets: int | None = None) -> DataFrame:
    """Write a table in buckets of ``sample_id`` and read it back: whatever joins or groups by the sample leaves its rows in place.

    ``folder`` is in shared storage and must not exist.
    """
    spark = df.sparkSession
    name = "by_sample_" + uuid.uuid4().hex
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt as the buckets are, so that each is one file
    dealt = df.repartition(buckets, "sample_id")
    dealt.write.bucketBy(buckets, "sample_id").sortBy("sample_id").option("path", folder).saveAsTable(name)
    return spark.table(name)


def candidates(statuses: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Calls to verify: resolved calls of target APIs, and low-confidence calls of outdated samples that look like one.

    ``statuses`` carries ``category``. Targets and their evidence are looked up per distinct name. Neither the code of the samples
    nor its place is needed to count them: what is not used is not moved.
    """
    spark = statuses.sparkSession
    low = F.col("status") == "low_confidence"
    wanted = statuses.where(F.col("status").isin("resolved_deprecated", "low_confidence"))
    # index of a call among the calls of its sample and status
    nth = F.row_number().over(W.partitionBy("sample_id", "status").orderBy("idx")) - 1
    wanted = wanted.withColumn("nth", nth).withColumn("symbol", F.coalesce("matched", "qualified_name"))
    pilot_leaves = sorted({t.rsplit(".", 1)[-1] for t in fixed.PILOT_TARGETS})
    wanted = wanted.where(~low | ((F.col("category") == "outdated") & F.col("callee").isin(pilot_leaves)))
    of_leaf: dict[str, tuple[str, dict[str, str]]] = {}
    for t in fixed.PILOT_TARGETS:
        _, of_lib = of_leaf.setdefault(t.rsplit(".", 1)[-1], (t, {}))
        of_lib.setdefault(t.split(".")[0], t)
    by_lib = spark.createDataFrame(
        [(k, *v) for k, v in of_leaf.items()], "leaf string, _any string, _of_lib map<string,string>")
    names = match_target(wanted.select("symbol").distinct(), "symbol", "_target")
    m = wanted.join(names, wanted["symbol"].eqNullSafe(names["symbol"]), "left").drop(names["symbol"])
    m = m.join(F.broadcast(by_lib), m["callee"] == by_lib["leaf"], "left")
    target = F.when(low, F.coalesce("_target", F.try_element_at("_of_lib", "library"), "_any")).otherwise(F.col("_target"))
    m = m.withColumn("target_api", target).where(F.col("target_api").isNotNull())
    # at most one row per target API
    return m.join(F.broadcast(add_evidence(match_dim(spark), catalog)), "target_api").withColumn("stage2_status", F.col("status"))


def build_manifest(statuses: DataFrame, samples: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """The candidates with the code they stand in.

    ``statuses`` carries ``sample_idx`` and ``category``; the snippet text joins last. With ``samples`` kept by ``by_sample`` only the
    candidates are dealt to it, and the text is read in place.
    """
    low = F.col("status") == "low_confidence"
    m = candidates(statuses, catalog).join(samples.select("sample_id", "function"), "sample_id")
    return m.select(
        candidate_id(F.col("sample_id"), F.when(low, F.lit("lc")).otherwise(F.lit("res")), F.col("nth"),
                     F.col("client_line"), F.col("client_col")).alias("candidate_id"),
        "sample_id", "sample_idx", "library", F.col("category").alias("cohort"),
        F.col("status").alias("stage2_status"),
        F.when(low, F.lit("inference")).otherwise(F.lit("confirmation")).alias("mode"),
        "target_api", F.col("symbol").alias("resolved_symbol"), "client_line", F.col("client_col").alias("column"),
        F.coalesce("snippet", F.lit("")).alias("call_site_snippet"), F.col("reason").alias("failure_reason"),
        F.col("details").alias("failure_details"), "recommended_replacement",
        F.col("warning").alias("evidence_warning"), F.col("docstring").alias("evidence_docstring"),
        F.col("function").alias("enclosing_code"))


def match_dim(spark) -> DataFrame:
    return spark.createDataFrame([(t,) for t in fixed.TARGET_LIST], "target_api string")


def census(manifest: DataFrame) -> DataFrame:
    """Candidate call sites per library and overall, from a manifest or from bare candidates."""
    low = F.col("stage2_status") == "low_confidence"
    return manifest.rollup("library").agg(
        F.count_if(~low).alias("resolved_deprecated_calls"), F.count_if(low).alias("target_low_confidence_calls"),
        F.count("*").alias("total_candidate_calls"))


def leaf_on_line(items: DataFrame, targets: list[str], code: str = "enclosing_code", line: str = "client_line") -> DataFrame:
    """Plain leaf-name prediction: does the marked line call something named like a target?

    For leaves shared by several targets the first one in target order is reported.
    """
    by_leaf = {}
    for t in targets:
        by_leaf.setdefault(t.rsplit(".", 1)[-1], t)
    lookup = F.create_map(*[F.lit(x) for kv in by_leaf.items() for x in kv])
    s = items.withColumn("_s", snippet_calls(F.col(code)))
    hits = F.filter("_s.calls", lambda c: (c["line"] == F.col(line)) & c["kind"].isin("name", "attribute")
                    & F.coalesce(F.map_contains_key(lookup, c["callee"]), F.lit(False)))
    return s.withColumn("_hit", F.get(hits, F.lit(0))["callee"]).withColumn(
        "pred_a", F.col("_hit").isNotNull()).withColumn(
        "matched_target_a", F.try_element_at(lookup, F.col("_hit"))).drop("_s", "_hit")


def pipeline_prediction(items: DataFrame, verdicts: DataFrame, line_statuses: DataFrame) -> DataFrame:
    """Verdict of the candidate when there is one, else what its line resolves to."""
    v = verdicts.select(
        "candidate_id", F.col("is_deprecated_usage").alias("_v"), F.col("target_api").alias("_vt"),
        F.col("stage2_status").alias("_vs"))
    per = line_statuses.groupBy("candidate_id").agg(
        F.min_by(F.struct("status", "qualified_name", "target_api"), "idx").alias("_first"),
        F.count("*").alias("_calls"))
    j = items.join(v, "candidate_id", "left").join(per, "candidate_id", "left")
    known = F.col("_vs").isNotNull()
    hit = (F.col("_first.status") == "resolved_deprecated") & F.col("_first.target_api").isNotNull()
    benign = F.col("_first.status") == "resolved_benign"
    return j.select(
        items["*"],
        F.when(known, F.coalesce("_v", F.lit(False))).otherwise(F.coalesce(hit, F.lit(False))).alias("pred_b"),
        F.when(known, F.col("_vt")).when(hit, F.col("_first.target_api")).when(benign, F.col("_first.qualified_name"))
        .alias("matched_target_b"),
        F.when(known & F.coalesce("_v", F.lit(False)), F.concat("_vs", F.lit("_verified_by_llm")))
        .when(known, F.concat("_vs", F.lit("_rejected_by_llm")))
        .when(F.col("_calls").isNull(), F.lit("unmanifested_no_call_on_target_line"))
        .when(hit, F.lit("unmanifested_resolved_deprecated"))
        .when(benign, F.concat(F.lit("resolved_benign_by_jedi_"), "_first.qualified_name"))
        .otherwise(F.lit("unmanifested_upstream_filtered")).alias("reason_b"))
