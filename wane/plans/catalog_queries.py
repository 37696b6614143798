"""Queries over declarations, the catalog and symbol matching, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.names import leaf
from wane.functions.text import canonical_path, location_file, module_path
from wane.operators import catalog as cat
from wane.operators import declarations as dec
from wane.operators import ranking as rank
from wane.operators.evidence import add_evidence, entry_evidence
from wane.operators.matching import first_match, leaf_lookup, match_target, pairs, target_dim
from wane.plans import derived
from wane.plans.derived import load, sql
from wane.sources.records import table

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return keep


def flat(df: DataFrame, *arrays: str) -> DataFrame:
    for a in arrays:
        df = df.withColumn(a, F.array_join(F.array_sort(a), ","))
    return df


def event_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, derived.CANDIDATES)
    return c.withColumn("origins", F.when(F.col("origin") == "pep702:griffe", F.array(F.lit("pep702"), F.col("origin"))).otherwise(
        F.array("origin")))


# ---- the same union in SQL; ``src`` is a SELECT of candidates --------------------
def union_sql(src: str) -> str:
    priority = ", ".join(f"('{o}', {i})" for i, o in enumerate(fixed.ORIGIN_PRIORITY))
    return f"""
    with src as ({src}),
    c as (
      select *, case when scope = 'parameter' then coalesce(function_name, string_split(qualified_name, '::')[1]) else qualified_name end as key_name,
        coalesce(function_name, string_split(qualified_name, '::')[1]) as fn,
        replace(file, '/./', '/') as key_file,
        case when scope = 'parameter' then array_to_string(list_sort(string_split(param_name, '+')), '+') else '' end as key_params,
        trim(raw_evidence) as ev
      from src),
    k as (
      select key_name, key_file, scope as key_scope, key_params, count(*) as raw_hits, min(ord) as first_ord,
        min(case when line > 0 then line end) as pos_line,
        arg_max(message, ord) filter (where message is not null) as last_message,
        arg_min(message, ord) filter (where message is not null and origin = 'pep702:griffe') as declared_message
      from c group by all),
    e as (
      select key_name, key_file, key_scope, key_params, string_agg(ev, ' | ' order by o) as raw_evidence from (
        select key_name, key_file, scope as key_scope, key_params, ev, min(ord) as o from c where ev <> '' group by all) group by all),
    o as (
      select key_name, key_file, key_scope, key_params, string_agg(tag, ',' order by tag) as origins from (
        select distinct key_name, key_file, scope as key_scope, key_params, unnest(case when origin = 'pep702:griffe' then ['pep702', origin] else [origin] end) as tag
        from c) group by all),
    p as (
      select key_name, key_file, scope as key_scope, key_params, arg_min(origin, rank) as origin
      from c join (values {priority}) as r(name, rank) on origin = name group by all)
    select r.qualified_name, p.origin, r.file, coalesce(k.pos_line, r.line) as line, e.raw_evidence, o.origins, r.scope,
      r.param_name, r.fn as function_name, coalesce(k.declared_message, k.last_message) as message, r.ord, k.raw_hits
    from k join e using (key_name, key_file, key_scope, key_params) join o using (key_name, key_file, key_scope, key_params)
    join p using (key_name, key_file, key_scope, key_params) join c r on r.ord = k.first_ord
    """


EVENT_CANDIDATES_SQL = f"select * replace (split_part(qualified_name, '::', 1) || case when scope = 'parameter' then '::p' else '' end as qualified_name) from ({sql(derived.CANDIDATES)})"


@query("candidate_union", union_sql(EVENT_CANDIDATES_SQL))
def candidate_union(spark, d):
    return flat(cat.union_candidates(event_candidates(spark, d)), "origins")


@query("catalog_records", f"""
    select qualified_name, origin, origins, file || ':' || line as location, scope, param_name, message, raw_evidence from ({union_sql(EVENT_CANDIDATES_SQL)})""")
def catalog_records(spark, d):
    return flat(cat.catalog_records(cat.union_candidates(event_candidates(spark, d))), "origins")


@query("scope_isolation", f"""
    select key_name as function_name, params, origins, raw_evidence, raw_hits, line from (
      select function_name as key_name, array_to_string(list_sort(string_split(param_name, '+')), '+') as params,
        array_to_string(list_sort(list_distinct(list(origin))), ',') as origins,
        count(*) as raw_hits, min(line) as line, min(raw_evidence) as raw_evidence
      from ({sql(derived.HOT_CANDIDATES)}) group by all)""")
def scope_isolation(spark, d):
    u = cat.union_candidates(load(spark, d, derived.HOT_CANDIDATES).withColumn("origins", F.array("origin")))
    return flat(u, "origins").select(
        "function_name", F.array_join(cat.param_tuple(F.col("param_name")), "+").alias("params"), "origins",
        "raw_evidence", "raw_hits", "line")


@query("union_across_snapshots", f"""
    select qualified_name, count(distinct file) as n_files, count(*) as raw_hits from (
      select case p_type when 'ECONOMY' then 'pkg.a' when 'SMALL' then 'pkg.b' else 'pkg.' || replace(p_name, ' ', '.') end as qualified_name,
        'lib/m.py' as file from part) group by all""")
def union_across_snapshots(spark, d):
    c = table(spark, d, "part").selectExpr(
        "case p_type when 'ECONOMY' then 'pkg.a' when 'SMALL' then 'pkg.b' else 'pkg.' || replace(p_name, ' ', '.') end as qualified_name",
        "'warning' as origin", "'/data/lib-' || p_size || '.0/lib/m.py' as file", "p_size as line", "p_brand as raw_evidence",
        "array('warning') as origins", "'function' as scope", "cast(null as string) as param_name",
        "cast(null as string) as function_name", "cast(null as string) as message", "p_partkey as ord")
    u = cat.union_candidates(c, across_snapshots=True)
    return u.groupBy("qualified_name").agg(F.count("*").alias("n_files"), F.sum("raw_hits").alias("raw_hits"))


@query("origin_histogram", f"""
    with u as ({union_sql(EVENT_CANDIDATES_SQL)}),
    k as (select least(len(list_filter(string_split(origins, ','), lambda x: x <> 'pep702')), 5) as n_origins, count(*) as n from u group by all)
    select cast(i as integer) as n_origins, coalesce(n, 0) as n from generate_series(1, 5) as g(i) left join k on n_origins = i""")
def origin_histogram(spark, d):
    return cat.origin_multiplicity(cat.union_candidates(event_candidates(spark, d)))


@query("origin_counts", f"""
    with u as ({union_sql(EVENT_CANDIDATES_SQL)})
    select origin, count(*) as n from (
      select unnest(string_split(origins, ',')) as origin from u union all select 'parameter' from u where scope = 'parameter')
    where origin <> 'pep702' group by all""")
def origin_counts(spark, d):
    return cat.origin_counts(cat.union_candidates(event_candidates(spark, d)))


@query("scope_counts", f"""
    with u as ({union_sql(EVENT_CANDIDATES_SQL)})
    select count(*) as n_unique, count(*) filter (where scope = 'parameter') as n_parameter,
      count(*) filter (where scope = 'function') as n_function from u""")
def scope_counts(spark, d):
    return cat.scope_counts(cat.union_candidates(event_candidates(spark, d)))


# ---- detectors on derived sources ------------------------------------------------
SOURCE_CANDIDATES_SQL = """
    with p as (select *, 'lib.m' || cast(p_partkey as varchar) as m, cast(p_size as varchar) as s from part)
    select m || '.f' as qualified_name, 'decorator' as origin, 'function' as scope, '@deprecated(''use n' || cast(p_partkey as varchar) || ''')' as raw_evidence,
      3 as line, cast(null as varchar) as message, p_brand, 0 as detector from p where p_type = 'ECONOMY'
    union all select m || '.f', 'docstring', 'function', 'Deprecated since ' || s || '.', 3, null, p_brand, 0 from p where p_type = 'ECONOMY'
    union all select m || '.f::b', 'warning', 'parameter', 'warnings.warn(''b is old'', category=W' || s || ') conditioned on param ''b'' (if b is not None)', 6, null, p_brand, 0 from p where p_type = 'SMALL'
    union all select m || '.C' || cast(p_partkey as varchar), 'comment', 'function', '# Deprecated: ' || p_brand, 2, null, p_brand, 1 from p where p_type = 'MEDIUM'
    union all select m || '.f', 'decorator', 'function', '@deprecated(''use ' || p_name || ''')', 3, null, p_brand, 0 from p where p_type = 'PROMO'
    union all select m || '.f', 'pep702:griffe', 'function', '@warnings.deprecated(''use ' || p_name || ''')', 2, 'use ' || p_name, p_brand, 3 from p where p_type = 'PROMO'
    union all select m || '.f::a+b', 'warning', 'parameter', 'warnings.warn(''x'', category=FutureWarning) conditioned on param ''a+b'' (if else: not (b and a))', 5, null, p_brand, 0 from p where p_type = 'STANDARD'
"""
_FOUND = ["qualified_name", "origin", "scope", "raw_evidence", "line", "message"]


def source_candidates(spark, d, **kw):
    files = load(spark, d, derived.SOURCES).drop("kind")
    return dec.find_candidates(files, **kw)


@query("find_candidates", f"select {', '.join(_FOUND)} from ({SOURCE_CANDIDATES_SQL})")
def find_candidates(spark, d):
    return source_candidates(spark, d).select(*_FOUND)


@query("find_parameters", f"select {', '.join(_FOUND)} from ({SOURCE_CANDIDATES_SQL}) where scope = 'parameter'")
def find_parameters(spark, d):
    return dec.find_parameters(load(spark, d, derived.SOURCES).drop("kind")).select(*_FOUND)


@query("find_comments", f"select {', '.join(_FOUND)} from ({SOURCE_CANDIDATES_SQL}) where origin = 'comment'")
def find_comments(spark, d):
    return dec.find_comments(load(spark, d, derived.SOURCES).drop("kind")).select(*_FOUND)


@query("find_declared", f"select {', '.join(_FOUND)} from ({SOURCE_CANDIDATES_SQL}) where origin = 'pep702:griffe'")
def find_declared(spark, d):
    return dec.find_declared(load(spark, d, derived.SOURCES).drop("kind")).select(*_FOUND)


@query("detector_counts", f"""
    select case when origin = 'comment' then 'comment' else origin end as detector, count(*) as n from ({SOURCE_CANDIDATES_SQL}) group by all
    union all select 'parameter', count(*) from ({SOURCE_CANDIDATES_SQL}) where scope = 'parameter'""")
def detector_counts(spark, d):
    return cat.detector_counts(source_candidates(spark, d, recount_parameters=True))


@query("build_catalog", f"""
    with c as ({SOURCE_CANDIDATES_SQL})
    select qualified_name, any_value(scope) as scope, min(line) as line, string_agg(raw_evidence, ' | ' order by detector, origin) as raw_evidence,
      string_agg(case when origin = 'pep702:griffe' then 'pep702,pep702:griffe' else origin end, ',' order by origin) as origins,
      max(message) as message,
      case when bool_or(origin = 'pep702:griffe') then 'pep702:griffe' else min(origin) end as origin
    from c group by qualified_name""")
def build_catalog(spark, d):
    return flat(cat.union_candidates(source_candidates(spark, d)), "origins").select(
        "qualified_name", "scope", "line", "raw_evidence", "origins", "message", "origin")


@query("published_comparison", f"""
    select case when p_brand < 'Brand#15' then 'numpy' when p_brand < 'Brand#20' then 'pandas' else 'other' end as library,
      count(*) as raw_candidates, count(distinct qualified_name) as unique_candidates,
      count(distinct qualified_name) filter (where scope = 'function') as function_scoped,
      count(distinct qualified_name) filter (where scope = 'parameter') as parameter_scoped,
      case library when 'numpy' then 39 when 'pandas' then 66 end as published_detected,
      case library when 'numpy' then 36 when 'pandas' then 59 end as published_manual,
      case library when 'numpy' then 40 when 'pandas' then 67 end as published_bundled
    from ({SOURCE_CANDIDATES_SQL}) group by 1""")
def published_comparison(spark, d):
    u = cat.union_candidates(source_candidates(spark, d))
    brand = F.regexp_extract("file", "^src/(.*?)/", 1)
    lib = F.when(brand < "Brand#15", F.lit("numpy")).when(brand < "Brand#20", F.lit("pandas")).otherwise(F.lit("other"))
    u = u.withColumn("library", lib).withColumn("version", F.lit("1"))
    return cat.compare_with_published(u).drop("version")


# ---- symbol matching -------------------------------------------------------------
def compat_sql(l: str, c: str) -> str:
    """Compatibility of names given as rows with name, p (parts), n and cls."""
    return f"""case
      when {l}.name = {c}.name then true
      when ends_with({l}.name, '.' || {c}.name) then not ({c}.n = 1 and {l}.cls)
      when ends_with({c}.name, '.' || {l}.name) then not ({l}.n = 1 and {c}.cls)
      when {l}.p[1] <> {c}.p[1] or {l}.p[-1] <> {c}.p[-1] then false
      when {l}.cls and {c}.cls then {l}.p[-2] = {c}.p[-2] or ({l}.p[1] = 'pandas' and
        (({l}.p[-2] in ('DataFrame', 'Series') and {c}.p[-2] = 'NDFrame') or ({c}.p[-2] in ('DataFrame', 'Series') and {l}.p[-2] = 'NDFrame')))
      else ({l}.n >= 3 and {c}.n >= 3 and {l}.p[2] = {c}.p[2]) or (({l}.n = 2 or {c}.n = 2) and not {l}.cls and not {c}.cls) end"""


def named_sql(source: str, column: str) -> str:
    return (f"select distinct {column} as name, string_split({column}, '.') as p, len(p) as n, "
            f"coalesce(regexp_matches(p[-2], '^[A-Z]'), false) as cls from ({source}) where {column} is not null")


TARGETS_SQL = "select * from (values " + ", ".join(
    f"('{t.split('.')[0]}', '{t}', {i})" for i, t in enumerate(fixed.TARGET_LIST)) + ") as t(library, target_api, ord)"


def matched_sql(symbols: str, symbol: str, catalog: str, name: str, order: str, exact: bool = True, extra: str = "false") -> str:
    """symbol -> first compatible catalog name, by brute force over distinct names."""
    rank = f"(l.name <> c.name, c.o, c.name)" if exact else "(false, c.o, c.name)"
    return f"""
      select l.name as symbol, arg_min(c.name, {rank}) as matched from ({named_sql(symbols, symbol)}) l
      join (select x.*, y.o from ({named_sql(catalog, name)}) x join (select {name} as nm, min({order}) as o from ({catalog}) group by 1) y on x.name = y.nm) c
      on ({compat_sql('l', 'c')}) or {extra} group by 1"""


@query("symbol_first_match", f"""
    with s as ({sql(derived.SYMBOLS)}), m as ({matched_sql(sql(derived.SYMBOLS), 'symbol', sql(derived.PART_CATALOG), 'qualified_name', 'ord')})
    select s.symbol, m.matched, count(*) as n, sum(quantity) as quantity from s left join m using (symbol) group by all""")
def symbol_first_match(spark, d):
    rows = load(spark, d, derived.SYMBOLS)
    got = first_match(rows, "symbol", load(spark, d, derived.PART_CATALOG), "qualified_name", ["ord"])
    return got.groupBy("symbol", "matched").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("symbol_equi_join", f"""
    select l.name as symbol, count(*) as n_compatible, min(c.name) as first_name from ({named_sql(sql(derived.SYMBOLS), 'symbol')}) l
    join ({named_sql(sql(derived.PART_CATALOG), 'qualified_name')}) c on {compat_sql('l', 'c')} group by 1""")
def symbol_equi_join(spark, d):
    a = load(spark, d, derived.SYMBOLS).select("symbol").distinct()
    b = load(spark, d, derived.PART_CATALOG).select("qualified_name").distinct()
    return pairs(a, b, "symbol", "qualified_name").groupBy("symbol").agg(
        F.count("*").alias("n_compatible"), F.min("qualified_name").alias("first_name"))


@query("first_match_target", f"""
    with m as ({matched_sql(sql(derived.TARGET_NAMES), 'symbol', TARGETS_SQL, 'target_api', 'ord')})
    select id, symbol, matched as target_api from ({sql(derived.TARGET_NAMES)}) left join m using (symbol)""")
def first_match_target(spark, d):
    return match_target(load(spark, d, derived.TARGET_NAMES), "symbol")


@query("leaf_lookup", f"""
    with t as (select target_api as n, string_split(target_api, '.')[-1] as leaf from ({TARGETS_SQL})),
    g as (select leaf, min(n) as a, min(n) filter (where contains(lower(n), 'dataframe')) as f, min(n) filter (where contains(lower(n), 'series')) as s from t group by 1)
    select c_custkey, case when contains(lower(r), 'df') then coalesce(f, a) when contains(lower(r), 'series') then coalesce(s, a) else a end as leaf_match
    from (select c_custkey, case c_mktsegment when 'BUILDING' then 'my_df' when 'FURNITURE' then 'a_Series' when 'MACHINERY' then null else 'x' end as r,
      case c_nationkey % 5 when 0 then 'pad' when 1 then 'iteritems' when 2 then 'comb' when 3 then 'first' else 'zip' end as callee from customer)
    left join g on callee = leaf""")
def leaf_lookup_query(spark, d):
    calls = table(spark, d, "customer").selectExpr(
        "c_custkey", "case c_mktsegment when 'BUILDING' then 'my_df' when 'FURNITURE' then 'a_Series' when 'MACHINERY' then null else 'x' end as receiver",
        "case c_nationkey % 5 when 0 then 'pad' when 1 then 'iteritems' when 2 then 'comb' when 3 then 'first' else 'zip' end as callee")
    return leaf_lookup(calls, target_dim(spark), "target_api").select("c_custkey", "leaf_match")


NAMES_AS_CATALOG = f"select symbol as qualified_name, id as ord, 'w' || id as ev from ({sql(derived.TARGET_NAMES)})"


def names_catalog(spark, d):
    n = load(spark, d, derived.TARGET_NAMES)
    return n.select(
        F.col("symbol").alias("qualified_name"), F.array(F.lit("warning")).alias("origins"), F.lit("m.py").alias("file"),
        F.col("id").cast("int").alias("line"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("raw_evidence"),
        F.col("id").alias("ord"))


COVERAGE_SQL = f"""
    with m as ({matched_sql(TARGETS_SQL, 'target_api', NAMES_AS_CATALOG, 'qualified_name', 'ord', exact=False)}),
    last as (select qualified_name, max(ord) as o from ({NAMES_AS_CATALOG}) group by 1)
    select library, target_api, matched as matched_symbol, case when matched is null then 'NOT_FOUND' else 'DETECTED' end as status,
      case when matched is null then '' else 'warning' end as origins, false as multi_origin,
      case when matched is null then '' else 'm.py:' || o end as location, case when matched is null then '' else 'w' || o end as evidence_snippet
    from ({TARGETS_SQL}) t left join m on m.symbol = t.target_api left join last on last.qualified_name = m.matched"""


@query("target_coverage", COVERAGE_SQL)
def target_coverage(spark, d):
    return flat(cat.target_coverage(names_catalog(spark, d)), "origins")


@query("target_coverage_suffix", f"""
    with h as (select target_api, arg_min(qualified_name, o) as m from ({TARGETS_SQL}) t join (select qualified_name, min(ord) as o from ({NAMES_AS_CATALOG}) group by 1) c
      on target_api = qualified_name or ends_with(target_api, '.' || qualified_name) or ends_with(qualified_name, '.' || target_api) group by 1)
    select target_api, m as matched_symbol, case when m is null then 'NOT_FOUND' else 'DETECTED' end as status from ({TARGETS_SQL}) left join h using (target_api)""")
def target_coverage_suffix(spark, d):
    return cat.target_coverage(names_catalog(spark, d), suffix_only=True).select("target_api", "matched_symbol", "status")


@query("coverage_rollup", f"""
    with c as ({COVERAGE_SQL})
    select library, count(*) as n_targets, count(*) filter (where status = 'DETECTED') as n_detected,
      round_even(count(*) filter (where status = 'DETECTED') * 100.0 / count(*), 1) as coverage_pct from c group by rollup (library)""")
def coverage_rollup(spark, d):
    return cat.coverage_summary(cat.target_coverage(names_catalog(spark, d)))


@query("origin_label", f"""
    with c as ({COVERAGE_SQL}) select target_api, case when status = 'DETECTED' then 'warning' else 'unscanned_miss' end as origin_tag from c""")
def origin_label(spark, d):
    return cat.origin_label(cat.target_coverage(names_catalog(spark, d)))


@query("dim_lookup_default", """
    select n_nationkey, n_name, coalesce(case when r_name like 'A%' then lower(r_name) end, 'unassigned') as tag
    from nation left join region on n_regionkey = r_regionkey""")
def dim_lookup_default(spark, d):
    tags = table(spark, d, "region").where("r_name like 'A%'").selectExpr("r_regionkey as n_regionkey", "lower(r_name) as tag")
    return table(spark, d, "nation").join(tags, "n_regionkey", "left").select(
        "n_nationkey", "n_name", F.coalesce("tag", F.lit("unassigned")).alias("tag"))


_EV_CAT = sql(derived.PART_CATALOG)
_EV_EXTRA = "(ends_with(l.name, '.' || c.name) or ends_with(c.name, '.' || l.name))"
_REPL = "select * from (values " + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(fixed.REPLACEMENTS.items())) + ") as r(of_name, replacement, ord)"
_SYM2 = f"select symbol from ({sql(derived.SYMBOLS)}) union all select symbol from ({sql(derived.TARGET_NAMES)})"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CUR = "select * from (values " + ", ".join("(" + ", ".join(map(_quote, g)) + ")" for g in fixed.GROUNDING) + ") as g(tgt, w, dcs, loc)"


@query("evidence_fill", f"""
    with syms as ({_SYM2}), e as (
      select qualified_name,
        arg_min(coalesce(message, raw_evidence), ord) filter (where origin = 'warning' or message is not null) as ew,
        arg_min(raw_evidence, ord) filter (where origin = 'docstring' or contains(lower(raw_evidence), 'deprecated')) as ed,
        arg_min(regexp_replace(location, '^.*/benchmark_libs/', ''), ord) as el from ({_EV_CAT}) group by 1),
    m as ({matched_sql('select * from syms', 'symbol', _EV_CAT, 'qualified_name', 'ord', extra=_EV_EXTRA)}),
    r as ({matched_sql('select * from syms', 'symbol', _REPL, 'of_name', 'ord')})
    select s.symbol, count(*) as n, any_value(replacement) as recommended_replacement, any_value(coalesce(w, ew)) as warning,
      any_value(coalesce(dcs, ed)) as docstring, any_value(coalesce(loc, el)) as source_location
    from syms s left join m on m.symbol = s.symbol left join e on e.qualified_name = m.matched
    left join r on r.symbol = s.symbol left join ({_REPL}) rr on rr.of_name = r.matched left join ({_CUR}) g on g.tgt = s.symbol group by s.symbol""")
def evidence_fill(spark, d):
    rows = load(spark, d, derived.SYMBOLS).select("symbol").unionByName(load(spark, d, derived.TARGET_NAMES).select("symbol"))
    got = add_evidence(rows, load(spark, d, derived.PART_CATALOG), "symbol")
    # a symbol has one evidence; counted by hash, as the first of several texts would sort all rows
    evidence = ["recommended_replacement", "warning", "docstring", "source_location"]
    return got.groupBy("symbol", *evidence).agg(F.count("*").alias("n")).select("symbol", "n", *evidence)


# ---- catalogs of several snapshots: names recur in files whose ords clash --------
SNAPSHOT_ENTRIES = ("part", [
    "'lib.' || replace(p_brand, '#', '_') as qualified_name",
    "cast(p_size % 3 as int) as snapshot",
    "'/b/lib-' || case p_size % 3 when 0 then '1.2.3' when 1 then '1.12.0' else '0.9' end || '/m' || cast(p_partkey % 4 as varchar(9)) || '.py' as file",
    "cast(p_partkey % 5 as bigint) as ord",
    "cast(p_partkey as int) as line",
    "case when p_partkey % 3 = 0 then 'warning' else 'docstring' end as origin",
    "case when p_partkey % 7 = 0 then 'message ' || cast(p_partkey as varchar(9)) else null end as message",
    "'text ' || cast(p_partkey as varchar(9)) as raw_evidence",
])


def snapshot_entries(spark, d):
    rows = load(spark, d, SNAPSHOT_ENTRIES).withColumn("origins", F.array("origin"))
    return rows.withColumn("location", F.concat_ws(":", "file", F.col("line").cast("string")))


def _first_sql(value: str, where: str = "true") -> str:
    return f"min(struct_pack(s := snapshot, f := file, o := ord, v := {value})) filter (where {where}).v"


@query("evidence_snapshots", f"""
    select qualified_name, {_first_sql("coalesce(message, raw_evidence)", "message is not null or origin = 'warning'")} as e_warning,
      {_first_sql("raw_evidence", "origin = 'docstring'")} as e_docstring, {_first_sql("file || ':' || line")} as e_location
    from ({sql(SNAPSHOT_ENTRIES)}) group by 1""")
def evidence_snapshots(spark, d):
    return entry_evidence(snapshot_entries(spark, d)).select("qualified_name", "e_warning", "e_docstring", "e_location")


@query("coverage_snapshots", f"""
    with c as (select * from ({sql(SNAPSHOT_ENTRIES)}) qualify row_number() over (partition by qualified_name, snapshot, file, ord order by line) = 1),
    last as (select qualified_name, max(struct_pack(s := snapshot, f := file, o := ord, l := line, e := raw_evidence)) as m from c group by 1),
    t as (select distinct qualified_name from c)
    select qualified_name as target_api, qualified_name as matched_symbol, m.f || ':' || m.l as location, m.e as evidence_snippet from t join last using (qualified_name)""")
def coverage_snapshots(spark, d):
    once = rank.first_per_key(snapshot_entries(spark, d), ["qualified_name", "snapshot", "file", "ord"], [F.col("line")])
    targets = once.select(F.lit("lib").alias("library"), F.col("qualified_name").alias("target_api")).distinct()
    return cat.target_coverage(once, targets).select("target_api", "matched_symbol", "location", "evidence_snippet")


@query("union_snapshots", f"""
    with c as (select *, regexp_replace(file, '^.*?[A-Za-z]+-[0-9][^/]*/', '') as key_file from ({sql(SNAPSHOT_ENTRIES)}))
    select qualified_name, count(*) as raw_hits, {_first_sql("file")} as file, {_first_sql("snapshot")} as snapshot,
      max(struct_pack(s := snapshot, f := file, o := ord, v := message)) filter (where message is not null).v as message from c group by qualified_name, key_file""")
def union_snapshots(spark, d):
    null = F.lit(None).cast("string")
    rows = snapshot_entries(spark, d).withColumns({"scope": F.lit("function"), "param_name": null, "function_name": null})
    return cat.union_candidates(rows, across_snapshots=True).select("qualified_name", "raw_hits", "file", "snapshot", "message")


# ---- small text operators --------------------------------------------------------
@query("dotted_prefix", r"""
    select page_id, case when s = '' then 'site' else 'site.' || replace(s, '/', '.') end as module from (
      select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '\.py$', ''), '(^|/)__init__$', '') as s from pages)""")
def dotted_prefix(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", module_path(F.regexp_replace("url", "^https?://", ""), F.lit("site")).alias("module"))


@query("location_split", r"""
    select page_id, regexp_replace(l, ':[^:]*$', '') as file, regexp_replace(regexp_replace(l, '/(\./)+', '/', 'g'), '/{2,}', '/', 'g') as path,
      string_split(replace(l, '/', '.'), '.')[-1] as leaf from (select page_id, url || ':' || page_id as l from pages)""")
def location_split(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat("url", F.lit(":"), F.col("page_id").cast("string")).alias("l"))
    return p.select("page_id", location_file(F.col("l")).alias("file"), canonical_path(F.col("l")).alias("path"),
                    leaf(F.replace("l", F.lit("/"), F.lit("."))).alias("leaf"))
