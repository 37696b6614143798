"""Queries over client snippets, candidates and verdicts, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions import keys
from wane.functions.text import as_array
from wane.operators import audit, reconcile as rec, resolution as res, verification as ver
from wane.operators.matching import target_dim
from wane.operators.ranking import upsert
from wane.plans import derived
from wane.plans.catalog_queries import TARGETS_SQL, flat
from wane.plans.derived import load, sql
from wane.session import shared_folder
from wane.sinks import store
from wane.sources.diagnostics import from_mypy, from_pyright
from wane.sources.records import last_by_key, table

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return keep


def samples(spark, d) -> DataFrame:
    """Snippets with the APIs each sample is known for."""
    apis = F.when(F.col("kind") == "BUILDING", F.array(F.lit("pandas.DataFrame.iteritems"), F.lit("pandas.Series.iteritems"))).otherwise(
        F.array(F.concat(F.lit("numpy."), "leaf")))
    return load(spark, d, derived.SNIPPETS).withColumn("deprecated_api", apis)


def statuses(spark, d, carry=("sample_id", "library"), preamble=None) -> DataFrame:
    return res.call_statuses(
        samples(spark, d), target_dim(spark), res.baseline_preamble() if preamble is None else preamble,
        name="target_api", order=["ord"], carry=list(carry))


# what each kind of snippet must give
STATUS_SQL = f"""
    with s as ({sql(derived.SNIPPETS)})
    select sample_id, library, sample_idx, category, kind, leaf, 'resolved_deprecated' as status, leaf as callee, 'np' as receiver, 3 as client_line, 14 as client_col,
      'numpy.' || leaf as qualified_name, 'numpy.' || leaf as matched, cast(null as varchar) as reason, 'return np.' || leaf || '(x)' as snippet from s where kind = 'AUTOMOBILE'
    union all select sample_id, library, sample_idx, category, kind, leaf, 'low_confidence', 'iteritems', 'pdf', 3, 15, null, 'pandas.DataFrame.iteritems', 'unresolved_receiver', 'return pdf.iteritems()' from s where kind = 'BUILDING'
    union all select sample_id, library, sample_idx, category, kind, leaf, 'low_confidence', 'alltrue', null, 2, 11, null, 'numpy.alltrue', 'empty_goto', 'return alltrue(x) + np.zeros(3)' from s where kind = 'FURNITURE'
    union all select sample_id, library, sample_idx, category, kind, leaf, 'resolved_benign', 'product', null, 3, 11, 'itertools.product', null, null, 'return product(x, x) + len(x)' from s where kind = 'HOUSEHOLD'
    union all select sample_id, library, sample_idx, category, kind, leaf, 'low_confidence', 'comb', null, 3, 11, null, 'scipy.misc.comb', 'dynamic_dispatch', 'return getattr(sm, "comb")(n)' from s where kind = 'MACHINERY' and nation % 2 = 0
    union all select sample_id, library, sample_idx, category, kind, leaf, 'low_confidence', '<syntax_error>', null, 1, 12, null, null, 'syntax_error', 'def broken(:' from s where kind = 'MACHINERY' and nation % 2 = 1
"""
_STATUS = ["sample_id", "library", "status", "callee", "receiver", "client_line", "client_col", "qualified_name", "matched", "reason", "snippet"]


@query("call_statuses", f"select {', '.join(_STATUS)} from ({STATUS_SQL})")
def call_statuses(spark, d):
    return statuses(spark, d).select(*_STATUS)


@query("call_counts", f"""
    select library, count(*) filter (where status = 'resolved_deprecated') as resolved_deprecated, count(*) filter (where status = 'resolved_benign') as resolved_benign,
      count(*) filter (where status = 'low_confidence') as low_confidence from ({STATUS_SQL}) group by rollup (library)""")
def call_counts(spark, d):
    return res.call_counts(statuses(spark, d))


@query("reason_counts", f"""
    select r.reason, count(s.reason) as n from (values {', '.join(f"('{r}')" for r in fixed.FAILURE_REASONS)}) as r(reason)
    left join ({STATUS_SQL}) s on s.reason = r.reason group by 1""")
def reason_counts(spark, d):
    return res.reason_counts(statuses(spark, d))


OUTCOME_SQL = f"""
    select sample_id, library, case when category = 'outdated' then 'outdated' else 'up_to_dated' end as cohort,
      case when category = 'outdated' then case when kind = 'AUTOMOBILE' then 'target_resolved_deprecated'
          when kind = 'BUILDING' or (kind = 'FURNITURE' and leaf = 'alltrue') then 'target_in_low_confidence' else 'target_missed' end
        when kind = 'AUTOMOBILE' then 'spurious_deprecated_flagged'
        when kind = 'BUILDING' or (kind = 'FURNITURE' and leaf = 'alltrue') then 'clean_in_low_confidence' else 'clean_resolved_benign' end as outcome
    from ({sql(derived.SNIPPETS)})"""


@query("sample_outcomes", OUTCOME_SQL)
def sample_outcomes(spark, d):
    return res.sample_outcomes(samples(spark, d), statuses(spark, d, ("sample_id", "deprecated_api")))


@query("outcome_report", f"""
    select library, cohort, outcome, count(*) as n from ({OUTCOME_SQL})
    group by grouping sets ((library), (), (library, cohort, outcome), (cohort, outcome))""")
def outcome_report(spark, d):
    return res.outcome_report(sample_outcomes(spark, d))


def _varied(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(samples, their statuses under both preambles), from one parse."""
    s = load(spark, d, derived.VARIED).withColumn("deprecated_api", F.array("api"))
    alias = F.when(F.col("kind") == 2, F.create_map(F.lit("comb"), F.lit("scipy.misc.comb"))).when(
        F.col("kind") == 3, F.create_map(F.lit("DataFrame.applymap"), F.lit("pandas.DataFrame.applymap")))
    preambles = {"baseline": res.baseline_preamble(), "reconstructed": res.reconstructed_preamble(alias)}
    return s, res.compared_statuses(s, target_dim(spark), preambles, "target_api", ["ord"], carry=["sample_id", "library", "deprecated_api"])


@query("every_reason", f"""
    with v as ({sql(derived.VARIED)}), r as (select case kind when 5 then 'ambiguous_definitions' when 6 then 'jedi_exception' when 7 then 'syntax_error'
      when 8 then 'dynamic_dispatch' when 9 then 'unresolved_receiver' else 'empty_goto' end as reason from v where kind not in (0, 4))
    select reason, count(*) as n from r group by 1""")
def every_reason(spark, d):
    """All six reasons for doubt under the baseline preamble."""
    return res.reason_counts(_varied(spark, d)[1]["baseline"])


def _outcome_case(resolved: str, low: str) -> str:
    return f"""case when category = 'outdated' then case when kind in ({resolved}) then 'target_resolved_deprecated' when kind in ({low}) then 'target_in_low_confidence' else 'target_missed' end
      else case when kind in ({resolved}) then 'spurious_deprecated_flagged' when kind in ({low}) then 'clean_in_low_confidence' else 'clean_resolved_benign' end end"""


@query("preamble_transitions", f"""
    select library, case when category = 'outdated' then 'outdated' else 'up_to_dated' end as cohort, {_outcome_case('0', '1, 2, 3, 5, 8, 9')} as outcome_before,
      {_outcome_case('0, 1, 2, 3', '5, 8, 9')} as outcome_after, count(*) as n from ({sql(derived.VARIED)}) group by all""")
def preamble_transitions(spark, d):
    """What the reconstructed preamble changes for each sample."""
    s, by = _varied(spark, d)
    return res.outcome_transitions(*(res.sample_outcomes(s, by[p]) for p in ("baseline", "reconstructed")))


@query("reconstructed_preamble", """
    select c_custkey, 'import numpy' || chr(10) || 'import numpy as np' || chr(10) || 'import scipy' || chr(10) || 'import scipy.misc' || chr(10) || 'import scipy.special'
      || chr(10) || 'import pandas' || chr(10) || 'import pandas as pd' || chr(10) || 'from pandas.io.formats.style import Styler' || chr(10) ||
      case c_mktsegment when 'AUTOMOBILE' then 'from numpy import a' || c_nationkey || chr(10) when 'BUILDING' then 'from pandas import DataFrame' || chr(10)
        when 'FURNITURE' then '' when 'HOUSEHOLD' then '' else 'from pandas import Series' || chr(10) || 'from scipy.misc import comb' || chr(10) end as preamble
    from customer""")
def reconstructed_preamble(spark, d):
    c = table(spark, d, "customer")
    aliases = F.expr("""case c_mktsegment when 'AUTOMOBILE' then map('a' || c_nationkey, 'numpy.a' || c_nationkey)
        when 'BUILDING' then map('DataFrame.pad', 'pandas.DataFrame.pad', 'DataFrame.first', 'pandas.DataFrame.first')
        when 'FURNITURE' then map('x', 'x') when 'HOUSEHOLD' then map('Styler.render', 'pandas.io.formats.style.Styler.render')
        else map('comb', 'scipy.misc.comb', 'Series.pad', 'pandas.Series.pad') end""")
    return c.select("c_custkey", res.reconstructed_preamble(aliases).alias("preamble"))


def manifest(spark, d) -> DataFrame:
    s = statuses(spark, d, ("sample_id", "library", "sample_idx", "category"))
    # the corpus is kept by sample once; statuses follow its buckets
    kept = res.by_sample(samples(spark, d), shared_folder(spark, "samples"))
    return res.build_manifest(res.by_sample(s, shared_folder(spark, "statuses")), kept)


_NUMPY = {t: (w, doc) for t, w, doc, _ in fixed.GROUNDING}


def _case(values: dict[str, str], column: str = "target_api") -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return f"case {column} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in values.items()) + " end"


MANIFEST_SQL = f"""
    with s as (select * from ({STATUS_SQL}) where (status = 'resolved_deprecated') or (status = 'low_confidence' and category = 'outdated'
      and callee in ({', '.join(sorted({repr(t.rsplit('.', 1)[-1]) for t in fixed.PILOT_TARGETS}))}))),
    t as (select *, matched as target_api from s)
    select sample_id || case when status = 'low_confidence' then '_lc_' else '_res_' end || '0_' || client_line || '_' || client_col as candidate_id,
      sample_id, library, category as cohort, status as stage2_status, case when status = 'low_confidence' then 'inference' else 'confirmation' end as mode,
      target_api, client_line, snippet as call_site_snippet, reason as failure_reason, {_case(fixed.REPLACEMENTS)} as recommended_replacement,
      {_case({k: v[0] for k, v in _NUMPY.items()})} as evidence_warning, {_case({k: v[1] for k, v in _NUMPY.items()})} as evidence_docstring
    from t"""
_MANIFEST = ["candidate_id", "sample_id", "library", "cohort", "stage2_status", "mode", "target_api", "client_line",
             "call_site_snippet", "failure_reason", "recommended_replacement", "evidence_warning", "evidence_docstring"]


@query("build_manifest", MANIFEST_SQL)
def build_manifest(spark, d):
    return manifest(spark, d).select(*_MANIFEST)


@query("call_site_census", f"""
    select library, count(*) filter (where stage2_status = 'resolved_deprecated') as resolved_deprecated_calls,
      count(*) filter (where stage2_status = 'low_confidence') as target_low_confidence_calls, count(*) as total_candidate_calls
    from ({MANIFEST_SQL}) group by rollup (library)""")
def call_site_census(spark, d):
    return res.census(res.candidates(statuses(spark, d, ("sample_id", "library", "category"))))


def _items(spark, d) -> DataFrame:
    s = samples(spark, d)
    return s.select(
        F.col("sample_id").alias("candidate_id"), "sample_id", "library", "kind", "leaf", F.col("function").alias("enclosing_code"),
        F.when(F.col("kind") == "FURNITURE", 2).otherwise(3).alias("client_line"),
        F.when(F.col("kind") == "BUILDING", F.lit("pandas.DataFrame.iteritems")).otherwise(F.lit("numpy.product")).alias("target_api"),
        F.when(F.col("kind") == "HOUSEHOLD", F.lit("return itertools.product(x)")).otherwise(F.lit("call")).alias("call_site_snippet"))


@query("leaf_on_line", f"""
    select sample_id as candidate_id, kind in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') as pred_a,
      case kind when 'AUTOMOBILE' then 'numpy.' || leaf when 'BUILDING' then 'pandas.Series.iteritems' when 'FURNITURE' then 'numpy.alltrue'
        when 'HOUSEHOLD' then 'numpy.product' end as matched_target_a from ({sql(derived.SNIPPETS)})""")
def leaf_on_line(spark, d):
    return res.leaf_on_line(_items(spark, d), fixed.TARGET_LIST).select("candidate_id", "pred_a", "matched_target_a")


@query("stage_predictions", f"""
    with s as ({sql(derived.SNIPPETS)})
    select sample_id as candidate_id,
      case when leaf = 'product' then kind <> 'HOUSEHOLD' else kind = 'AUTOMOBILE' end as pred_b,
      case when leaf = 'product' then case when kind = 'HOUSEHOLD' then 'resolved_deprecated_rejected_by_llm' else 'resolved_deprecated_verified_by_llm' end
        when kind = 'AUTOMOBILE' then 'unmanifested_resolved_deprecated' when kind = 'HOUSEHOLD' then 'resolved_benign_by_jedi_itertools.product'
        when kind in ('BUILDING', 'FURNITURE') then 'unmanifested_upstream_filtered' when nation % 2 = 0 then 'unmanifested_upstream_filtered'
        else 'unmanifested_no_call_on_target_line' end as reason_b
    from s""")
def stage_predictions(spark, d):
    items = _items(spark, d)
    verdicts = items.where("leaf = 'product'").select(
        "candidate_id", (F.col("kind") != "HOUSEHOLD").alias("is_deprecated_usage"), "target_api",
        F.lit("resolved_deprecated").alias("stage2_status"))
    st = statuses(spark, d).join(items.select("sample_id", F.col("client_line").alias("_l")), "sample_id").where(
        (F.col("client_line") == F.col("_l")) & (F.col("callee") != "<syntax_error>"))
    lines = st.select(F.col("sample_id").alias("candidate_id"), "idx", "status", "qualified_name", F.col("matched").alias("target_api"))
    return res.pipeline_prediction(items, verdicts, lines).select("candidate_id", "pred_b", "reason_b")


@query("receiver_audit", f"""
    select sample_id as candidate_id, case when kind = 'BUILDING' then 'pdf' when kind = 'HOUSEHOLD' then '<direct_call>'
        when kind = 'AUTOMOBILE' and leaf = 'product' then 'np' else '<native_call>' end as receiver_expr,
      case when kind = 'BUILDING' then 'native_pandas' when kind = 'HOUSEHOLD' then 'module_import'
        when kind = 'AUTOMOBILE' and leaf = 'product' then 'native_numpy' else 'native_library' end as receiver_category, true as invokes_target_api
    from ({sql(derived.SNIPPETS)})""")
def receiver_audit(spark, d):
    return audit.audit_receivers(_items(spark, d)).select("candidate_id", "receiver_expr", "receiver_category", "invokes_target_api")


# ---- channels --------------------------------------------------------------------
_LEFT = """select 'd' || day(o_orderdate) as file, 1 as line, case when o_orderpriority < '3' then 'numpy.product' else 'pandas.DataFrame.pad' end as sym,
    o_orderkey as ord, o_orderstatus as ev from orders"""
_RIGHT = """select 'd' || day(ts) as file, 1 as line, case event_type when 'click' then 'numpy.core.fromnumeric.product'
    when 'view' then 'pandas.core.generic.NDFrame.pad' else 'pandas.Series.pad' end as sym, event_id as ord, case when value > 20 then 'F' else event_type end as ev from events"""


@query("reconcile_channels", f"""
    with l as (select *, case when sym = 'numpy.product' then 'p' else 'd' end as cls from ({_LEFT})),
    r as (select *, case when sym = 'numpy.core.fromnumeric.product' then 'p' when sym = 'pandas.core.generic.NDFrame.pad' then 'd' else 's' end as cls from ({_RIGHT})),
    lk as (select *, row_number() over (partition by file, line, cls order by ord) as k from l),
    rk as (select *, row_number() over (partition by file, line, cls order by ord) as k from r),
    j as (select coalesce(lk.file, rk.file) as client_file, coalesce(lk.sym, rk.sym) as target_symbol,
        case when lk.k is not null and rk.k is not null then 'both' when lk.k is not null then 'catalog_only' else 'checker_only' end as "case",
        case when lk.k is null then rk.ev when rk.k is null or contains(lk.ev, rk.ev) then lk.ev else lk.ev || ' | ' || rk.ev end as raw_evidence
      from lk full join rk on lk.file = rk.file and lk.line = rk.line and lk.cls = rk.cls and lk.k = rk.k)
    select client_file, target_symbol, "case", count(*) as n, min(raw_evidence) as first_evidence, sum(length(raw_evidence)) as evidence_chars from j group by all""")
def reconcile_channels(spark, d):
    null = F.lit(None).cast("string")
    left = table(spark, d, "orders").select(
        F.concat(F.lit("d"), F.day("o_orderdate").cast("string")).alias("client_file"), F.lit(1).alias("line"),
        F.when(F.col("o_orderpriority") < "3", F.lit("numpy.product")).otherwise(F.lit("pandas.DataFrame.pad")).alias("target_symbol"),
        F.array(F.lit("warning")).alias("origins"), F.col("o_orderstatus").alias("raw_evidence"), null.alias("message"),
        null.alias("param_name"), F.lit("function").alias("scope"), F.col("o_orderkey").alias("ord"))
    kind = F.col("event_type")
    right = table(spark, d, "events").select(
        F.concat(F.lit("d"), F.day("ts").cast("string")).alias("file"), F.lit(1).alias("line"),
        F.when(kind == "click", F.lit("numpy.core.fromnumeric.product")).when(
            kind == "view", F.lit("pandas.core.generic.NDFrame.pad")).otherwise(F.lit("pandas.Series.pad")).alias("qualified_name"),
        F.lit("pep702:mypy").alias("origin"), F.array(F.lit("pep702"), F.lit("pep702:mypy")).alias("origins"),
        F.when(F.col("value") > 20, F.lit("F")).otherwise(kind).alias("raw_evidence"), null.alias("message"),
        null.alias("param_name"), F.lit("function").alias("scope"), F.col("event_id").alias("ord"))
    got = rec.reconcile(left, right)
    return got.groupBy("client_file", "target_symbol", "case").agg(
        F.count("*").alias("n"), F.min("raw_evidence").alias("first_evidence"), F.sum(F.length("raw_evidence")).alias("evidence_chars"))


# names that fit several others, on many sites and on one that a third of all rows share
_L4 = ["pandas.DataFrame.pad", "pandas.Series.pad", "pandas.core.generic.NDFrame.pad", "numpy.pad"]
_R4 = ["pandas.core.frame.DataFrame.pad", "pandas.core.series.Series.pad", "pandas.core.generic.NDFrame.pad", "numpy.lib.arraypad.pad"]


@query("reconcile_overlapping", """
    with recursive l as (select *, row_number() over (partition by file, c = 3 order by ord) as k from (
        select o_orderkey as ord, o_orderkey % 4 as c, case when o_orderkey % 3 = 0 then 'hot' else 'd' || day(o_orderdate) end as file from orders)),
    r as (select *, row_number() over (partition by file, c order by ord) - 1 as j from (
        select event_id as ord, event_id % 4 as c, case when event_id % 3 = 0 then 'hot' else 'd' || day(ts) end as file from events)),
    w(file, k, c0, c1, c2, lo, ro) as (
      select distinct file, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(null as bigint), cast(null as bigint) from l
      union all
      select file, k, c0 + case when m = o0 then 1 else 0 end, c1 + case when m = o1 then 1 else 0 end, c2 + case when m = o2 then 1 else 0 end, ord, m
      from (select *, least(o0, o1, o2) as m from (
        select w.file, l.k, w.c0, w.c1, w.c2, l.ord, case when l.c in (0, 2) then r0.ord end as o0, case when l.c in (1, 2) then r1.ord end as o1, r2.ord as o2
        from w join l on l.file = w.file and l.c < 3 and l.k = w.k + 1 left join r r0 on r0.file = w.file and r0.c = 0 and r0.j = w.c0
          left join r r1 on r1.file = w.file and r1.c = 1 and r1.j = w.c1 left join r r2 on r2.file = w.file and r2.c = 2 and r2.j = w.c2))),
    p as (select lo, ro from w where ro is not null union all select l.ord, r.ord from l join r on l.c = 3 and r.c = 3 and l.file = r.file and l.k = r.j + 1)
    select 'L' || lo || ' | R' || ro as raw_evidence, 'both' as "case" from p
    union all select 'L' || ord, 'catalog_only' from l where ord not in (select lo from p) union all select 'R' || ord, 'checker_only' from r where ord not in (select ro from p)""")
def reconcile_overlapping(spark, d):
    null = F.lit(None).cast("string")
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % 4 + 1).cast("int"))
    place = lambda key, ts: F.when(F.col(key) % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.day(ts).cast("string")))
    left = table(spark, d, "orders").select(
        place("o_orderkey", "o_orderdate").alias("client_file"), F.lit(1).alias("line"), pick(_L4, "o_orderkey").alias("target_symbol"),
        F.array(F.lit("warning")).alias("origins"), F.concat(F.lit("L"), "o_orderkey").alias("raw_evidence"), null.alias("message"),
        null.alias("param_name"), F.lit("function").alias("scope"), F.col("o_orderkey").alias("ord"))
    right = table(spark, d, "events").select(
        place("event_id", "ts").alias("file"), F.lit(1).alias("line"), pick(_R4, "event_id").alias("qualified_name"), F.lit("pep702:mypy").alias("origin"),
        F.array(F.lit("pep702")).alias("origins"), F.concat(F.lit("R"), "event_id").alias("raw_evidence"), null.alias("message"),
        null.alias("param_name"), F.lit("function").alias("scope"), F.col("event_id").alias("ord"))
    return rec.reconcile(left, right).select("raw_evidence", "case")


@query("semi_scope_filter", """
    select c_mktsegment as target_api, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey where c_acctbal > 0 group by 1""")
def semi_scope_filter(spark, d):
    preds = table(spark, d, "orders").selectExpr("o_custkey as candidate_id", "'old' as target_api", "o_totalprice")
    man = table(spark, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey as candidate_id", "c_mktsegment as target_api")
    return rec.in_scope(preds, man).groupBy("target_api").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_MYPY_SQL = """
    select source, file, line, symbol, message from (select cast(user_id as varchar) as source, 'm' || user_id || '.py' as file, hour(ts) + 1 as line,
      'pkg.C.' || event_type as symbol, case when value > 20 then 'use v' || props end as message,
      row_number() over (partition by user_id, event_type, hour(ts) order by event_id) as rn from events where event_type <> 'click') where rn = 1"""


@query("mypy_diagnostics", f"""
    select source, file, line, symbol as qualified_name, message, 'mypy [deprecated]: ' || symbol || ' is deprecated' || coalesce(' (' || message || ')', '') as raw_evidence
    from ({_MYPY_SQL})""")
def mypy_diagnostics(spark, d):
    e = table(spark, d, "events")
    lines = e.selectExpr(
        "cast(user_id as string) as source", "event_id as ord", "'m' || user_id as module",
        "'  m' || user_id || '.py:' || (hour(ts) + 1) || ': error: function m' || user_id || '.C.' || event_type || "
        "case when event_type = 'click' then ' is fine' else ' is deprecated' end || case when value > 20 then ': use v' || props else '' end || '  [deprecated] ' as value")
    got = from_mypy(lines, F.lit("pkg"))
    return got.select(F.regexp_extract("file", r"m(\d+)\.py", 1).alias("source"), "file", "line", "qualified_name", "message", "raw_evidence")


@query("pyright_diagnostics", """
    with e as (select *, 'f' || user_id || '.py' as file, hour(ts) as h, row_number() over (partition by user_id, event_type, hour(ts) order by event_id) as rn from events)
    select file, h + 1 as line, case when event_type = 'error' then 'deprecated_symbol' else 'K.' || event_type end as qualified_name,
      case when event_type = 'error' then 'odd text' when event_type = 'view' then null else 'use ' || event_id end as message from e where event_type <> 'click' and rn = 1""")
def pyright_diagnostics(spark, d):
    e = table(spark, d, "events")
    diag = e.selectExpr("user_id", "event_id", """named_struct(
        'rule', case when event_type = 'click' then 'other' else 'reportDeprecated' end,
        'message', case when event_type = 'error' then 'odd text' when event_type = 'view' then 'The method "view" in class "K" is deprecated'
          else 'The method "' || event_type || '" in class "K" is deprecated' || chr(10) || chr(160) || chr(160) || 'use ' || event_id end,
        'range', named_struct('start', named_struct('line', hour(ts)))) as diag""")
    # every event is one saved checker output about the user's file
    out = diag.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".py")).alias("source"), F.lit("").alias("module"),
        F.col("event_id").alias("ord"), F.to_json(F.struct(F.array("diag").alias("generalDiagnostics"))).alias("value"))
    return from_pyright(out).select("file", "line", "qualified_name", "message")


# ---- cache, verdicts -------------------------------------------------------------
_EV = "coalesce(evidence_docstring, '') || '|' || coalesce(evidence_warning, '') || '|' || coalesce(recommended_replacement, '')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_KEY5 = f"'primary:v1.1:' || {_STRIP.format('call_site_snippet')} || ':' || target_api || ':' || {_EV}"
REQ = sql(derived.REQUESTS)


@query("cache_keys", f"select candidate_id, sha256({_KEY5}) as legacy_key, sha256({_KEY5} || ':' || sha256(mode) || ':' || sha256(enclosing_code)) as cache_key from ({REQ})")
def cache_keys(spark, d):
    r = load(spark, d, derived.REQUESTS)
    k = ver.add_key(r, "primary", with_context=False).withColumnRenamed("cache_key", "legacy_key")
    return ver.add_key(k, "primary").select("candidate_id", "legacy_key", "cache_key")


@query("zero_shot_keys", """
    with r as (select 'c' || doc_id as candidate_id, n_chars % 97 as line, text, source, lang from documents)
    select candidate_id, sha256('m:' || line || ':' || sha256(text)) as cache_key from r""")
def zero_shot_keys(spark, d):
    r = load(spark, d, derived.REQUESTS)
    return r.select("candidate_id", keys.zero_shot_key(F.lit("m"), F.col("client_line"), F.col("enclosing_code")).alias("cache_key"))


@query("prompts", f"""
    select candidate_id, length(p) as n, sha256(p) as digest from (select candidate_id,
      'Prompt v2.0' || chr(10) || 'Target: ' || target_api || ' of ' || library || chr(10) || 'Line ' || client_line || ': ' || call_site_snippet || chr(10) || 'Evidence:' || chr(10)
      || case when recommended_replacement is null and evidence_docstring is null then '- listed in the catalog' else
        concat_ws(chr(10), '- Replacement: ' || recommended_replacement, '- Docstring: ' || evidence_docstring) end
      || chr(10) || 'Code:' || chr(10) || enclosing_code || chr(10) || case when mode = 'confirmation' then
        'Static analysis resolved this call to the target. Say whether it is an active use: not a guarded fallback, not another call on the same line, not a lookalike of another package.' || chr(10)
        else 'The receiver could not be resolved (unresolved_receiver). Infer its type from the code; lower the confidence where the type stays open.' || chr(10) end
      || 'A native receiver makes it a deprecated use, a third-party wrapper receiver does not; judge the flagged call by its own receiver even if the line also calls the other kind.' || chr(10)
      || 'Answer with JSON: {{"is_deprecated_usage": bool, "confidence": 0..1, "rationale": text}}' as p from ({REQ}))""")
def prompts(spark, d):
    r = load(spark, d, derived.REQUESTS).select("candidate_id", ver.prompt(fixed.PROMPT_VERSION_RECEIVER).alias("p"))
    return r.select("candidate_id", F.length("p").cast("bigint").alias("n"), F.sha2("p", 256).alias("digest"))


def cached_responses(spark, d) -> DataFrame:
    """Responses stored for the English and German requests, by their keys without context."""
    r = load(spark, d, derived.REQUESTS).where("cohort in ('en', 'de')")
    k = ver.add_key(r, "primary", with_context=False).groupBy("cache_key").agg(F.min("target_api").alias("api_name"))
    return k.select(
        "cache_key", F.lit("primary").alias("model_name"), F.lit("v1.1").alias("prompt_version"), "api_name",
        F.lit("").alias("call_site_text"), F.lit("").alias("evidence_snippet"),
        F.lit('{"is_deprecated_usage": false, "confidence": 0.5, "rationale": "stored"}').alias("response_json"),
        F.lit(10).alias("prompt_tokens"), F.lit(2).alias("candidate_tokens"), F.lit(12).alias("total_tokens"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"))


_VERDICT = f"""
    with r as (select *, sha256({_KEY5}) as cache_key from ({REQ})),
    c as (select distinct cache_key as k, true as hit from r where cohort in ('en', 'de')),
    f as (select min(candidate_id) as first_id, cache_key as fk from r group by cache_key)
    select r.*, coalesce(hit, false) as stored, coalesce(hit, false) or candidate_id <> first_id as cached,
      case when coalesce(hit, false) then false when contains(call_site_snippet, 'pdf.') then true when contains(call_site_snippet, 'itertools.') then false else true end as is_deprecated_usage,
      case when coalesce(hit, false) then 0.5::double else 0.95::double end as confidence
    from r left join c on cache_key = k join f on cache_key = fk"""


@query("unanswered_requests", f"""
    select candidate_id, cache_key, stored or (cached and cache_key < '8') as cached, is_deprecated_usage and (stored or cache_key < '8') as is_deprecated_usage,
      stored or cache_key < '8' as answered from ({_VERDICT})""")
def unanswered_requests(spark, d):
    """A verifier that leaves half of its requests without an answer: they stay, marked."""
    half = lambda misses: ver.rule_verifier(misses).where("cache_key < '8'")
    half.repeatable = True
    p, _ = ver.verify(load(spark, d, derived.REQUESTS), cached_responses(spark, d), half, with_context=False)
    return p.select("candidate_id", "cache_key", "cached", "is_deprecated_usage", (F.col("rationale") != fixed.NO_ANSWER).alias("answered"))


@query("cache_hit_miss", f"select candidate_id, cache_key, cached, is_deprecated_usage, confidence from ({_VERDICT})")
def cache_hit_miss(spark, d):
    p, _ = ver.verify(load(spark, d, derived.REQUESTS), cached_responses(spark, d), with_context=False)
    return p.select("candidate_id", "cache_key", "cached", "is_deprecated_usage", "confidence")


@query("run_telemetry", f"""
    select library, count(*) as total_requests, count(*) filter (where not cached) as api_calls, count(*) filter (where cached) as cache_hits,
      round_even(count(*) filter (where cached) * 100.0 / count(*), 2) as cache_hit_rate_pct from ({_VERDICT}) group by 1""")
def run_telemetry(spark, d):
    p, _ = ver.verify(load(spark, d, derived.REQUESTS), cached_responses(spark, d), with_context=False)
    return ver.telemetry(p, ["library"]).select("library", "total_requests", "api_calls", "cache_hits", "cache_hit_rate_pct")


@query("cache_repeat_run", f"select count(*) as total_requests, cast(0 as bigint) as api_calls, count(*) as cache_hits from ({REQ})")
def cache_repeat_run(spark, d):
    """A second run over the same requests finds everything in the cache."""
    r = load(spark, d, derived.REQUESTS)
    _, cache = ver.verify(r, cached_responses(spark, d))
    p, _ = ver.verify(r, cache)
    return ver.telemetry(p).select("total_requests", "api_calls", "cache_hits")


_FULL_KEY = f"sha256({_KEY5} || ':' || sha256(mode) || ':' || sha256(enclosing_code))"


@query("stored_responses", f"""
    with k as (select cohort, {_FULL_KEY} as key from ({REQ})), a as (select * from k where cohort in ('en', 'de')),
    r as (select 1 as run, count(*) as total_requests, count(distinct key) as api_calls from a
      union all select 2, count(*), count(distinct key) filter (where key not in (select key from a)) from k
      union all select 3, count(*), 0 from k)
    select run, total_requests, api_calls, total_requests - api_calls as cache_hits from r""")
def stored_responses(spark, d):
    """Three runs over a log of responses: part of the requests, all of them, and all again after the log was compacted."""
    r = load(spark, d, derived.REQUESTS)
    log = store.ResponseStore(spark, shared_folder(spark, "responses"), digits=1)
    some = ver.verify_with_store(r.where("cohort in ('en', 'de')"), log)
    every = ver.verify_with_store(r, log)
    log.compact()
    again = ver.verify_with_store(r, log)
    out = None
    for run, p in enumerate((some, every, again), 1):
        t = ver.telemetry(p).select(F.lit(run).alias("run"), "total_requests", "api_calls", "cache_hits")
        out = t if out is None else out.unionByName(t)
    return out


@query("cost_estimate", """
    select event_type, sum(cast(json_extract(props, '$.k') as bigint)) as prompt_tokens, cast(sum(hour(ts)) as bigint) as candidate_tokens,
      round_even(sum(cast(json_extract(props, '$.k') as bigint)) / 1e6 * 0.10 + sum(hour(ts)) / 1e6 * 0.40, 4) as estimated_cost_usd from events group by 1""")
def cost_estimate(spark, d):
    e = table(spark, d, "events").select(
        "event_type", F.lit(False).alias("cached"), F.from_json("props", "k int")["k"].alias("prompt_tokens"), F.hour("ts").alias("candidate_tokens"))
    return ver.telemetry(e, ["event_type"]).select("event_type", "prompt_tokens", "candidate_tokens", "estimated_cost_usd")


@query("decode_responses", """
    select event_id, case when ok then event_type in ('click', 'view') else false end as is_deprecated_usage, case when ok then k / 100.0 else 0.0 end as confidence,
      case when ok then event_type else 'Failed to parse JSON response: ' || substring(txt, 1, 100) end as rationale from (
      select *, event_type <> 'error' and k <= 100 as ok, case event_type when 'error' then 'not json ' || event_id else '' end as txt0,
        case event_type when 'error' then 'not json ' || event_id else '{"is_deprecated_usage":' || case when event_type in ('click', 'view') then 'true' else 'false' end
          || ',"confidence":' || (k / 100.0) || ',"rationale":"' || event_type || '"}' end as txt
      from (select *, cast(json_extract(props, '$.k') as integer) as k from events))""")
def decode_responses(spark, d):
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    txt = F.expr("""case event_type when 'error' then 'not json ' || event_id else '{"is_deprecated_usage":' || case when event_type in ('click', 'view') then 'true' else 'false' end
        || ',"confidence":' || cast(k / 100.0 as double) || ',"rationale":"' || event_type || '"}' end""")
    return e.select("event_id", ver.decode(txt).alias("v")).select("event_id", "v.*")


@query("cache_upsert", """
    select conv_id, arg_max(role, turn) as role, max(turn) as turn, arg_max(length(text), turn) as n_chars from conversations group by 1""")
def cache_upsert(spark, d):
    c = table(spark, d, "conversations")
    early, late = c.where("turn <= 1"), c.where("turn > 1")
    return upsert(early, late, ["conv_id"], "turn").select("conv_id", "role", "turn", F.length("text").cast("bigint").alias("n_chars"))


@query("records_last_wins", "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def records_last_wins(spark, d):
    return last_by_key(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("compare_models", """
    select 'c' || d.doc_id as candidate_id, quality = 1 as validation_decision, case when n_chars > 500 then toxic = 1 end as primary_decision,
      case when n_chars > 500 then quality = toxic else false end as agreement from documents d join labels l on d.doc_id = l.doc_id""")
def compare_models(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    one = lambda c: j.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("candidate_id"), F.lit("s").alias("sample_id"), "n_chars",
                             F.lit("t").alias("target_api"), F.lit(c).alias("model"), (F.col(c) == 1).alias("is_deprecated_usage"),
                             F.lit(0.9).alias("confidence"), F.lit("r").alias("rationale"), F.lit(True).alias("cached"))
    got = ver.compare_models(one("quality"), one("toxic").where("n_chars > 500"))
    return got.select("candidate_id", "validation_decision", "primary_decision", "agreement")


@query("wrapper_evaluation", f"""
    select candidate_id, case when contains(s, 'pdf.') then 'native_pandas' else 'wrapper_lookalike' end as receiver_type, contains(s, 'pdf.') as truth,
      sha256('primary:v1.1:' || {_STRIP.format('s')} || ':' || target_api || ':' || g) as cache_key_v1, sha256('primary:v2.0:' || {_STRIP.format('s')} || ':' || target_api || ':' || g) as cache_key_v2
    from (select *, call_site_snippet as s, coalesce(recommended_replacement, 'Deprecation verified in historical API catalog.') as g from ({REQ}))""")
def wrapper_evaluation(spark, d):
    w = audit.wrapper_evaluation(load(spark, d, derived.REQUESTS))
    return w.select("candidate_id", "receiver_type", F.col("ground_truth_under_receiver_rule").alias("truth"), "cache_key_v1", "cache_key_v2")


@query("low_confidence_audit", f"""
    select candidate_id, case when contains(s, 'itertools.product') then 'standard_library' when contains(s, 'psdf.') then 'wrapper_receiver' else 'native_library' end as receiver_category,
      not (contains(s, 'itertools.product') or contains(s, 'psdf.')) as ground_truth, (cohort <> 'en') = (not (contains(s, 'itertools.product') or contains(s, 'psdf.'))) as correct
    from (select *, call_site_snippet as s from ({REQ})) where mode = 'inference'""")
def low_confidence_audit(spark, d):
    r = load(spark, d, derived.REQUESTS)
    preds = r.select("candidate_id", "sample_id", "mode", "stage2_status", "call_site_snippet", "target_api", (F.col("cohort") != "en").alias("is_deprecated_usage"))
    return audit.audit_low_confidence(preds, r).select("candidate_id", "receiver_category", "ground_truth", "correct")


@query("override_labels", """
    select doc_id, case when toxic = 1 then false else quality = 1 end as label, quality = 1 as v1_label, toxic = 1 and quality = 1 as label_changed from labels""")
def override_labels(spark, d):
    l = table(spark, d, "labels").select(F.col("doc_id").alias("benchmark_id"), (F.col("quality") == 1).alias("is_deprecated_call"), "toxic")
    o = l.where("toxic = 1").select("benchmark_id", F.lit(False).alias("label"), F.lit("toxic").alias("reason"))
    got = audit.second_labels(l, o)
    return got.select(F.col("benchmark_id").alias("doc_id"), F.col("is_deprecated_call").alias("label"), "v1_label", "label_changed")


@query("scalar_or_list", """
    select doc_id, case when lang in ('en', 'fr') then 2 else 1 end as n_apis, case when lang in ('en', 'fr') then 'a.' || lang || ',b' else 'c.' || lang end as apis from documents""")
def scalar_or_list(spark, d):
    x = F.expr("""case when lang in ('en', 'fr') then '["a.' || lang || '", "b"]' else 'c.' || lang end""")
    r = table(spark, d, "documents").select("doc_id", as_array(x).alias("a"))
    return r.select("doc_id", F.size("a").cast("bigint").alias("n_apis"), F.array_join("a", ",").alias("apis"))
