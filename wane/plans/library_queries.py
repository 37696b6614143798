"""Queries over library trees that import their names from one another, with their checks.

Every supplier is one library: a package whose names lead through 1 to 5 modules to their definitions, or, for some nations, in a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wane.operators import reexports as rex, resolution as res
from wane.operators.declarations import find_candidates
from wane.plans.derived import _text, combined_source
from wane.sources.records import table

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str):
    def keep(fn):
        QUERIES[name], CHECKS[name] = fn, check
        return fn
    return keep


_N, _K, _CIRCLE = "s_suppkey % 5 + 1", "s_suppkey", "s_nationkey % 4 = 0"


def suppliers(spark, d) -> DataFrame:
    """Parsing costs far more than reading: the rows are dealt by their key."""
    return table(spark, d, "supplier").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")


def files(spark, d) -> DataFrame:
    """file, prefix, source: module 0 is the package, the last one defines the names."""
    s = suppliers(spark, d).selectExpr(
        "s_suppkey", "s_nationkey", f"{_N} as n", "concat('lib', s_suppkey) as lib", f"explode(sequence(0, cast({_N} as int))) as j")
    code = (
        "case when j = 0 and s_suppkey % 3 = 0 then " + _text("from .m1 import *")
        + " when j = 0 and s_suppkey % 3 = 1 then " + _text("from lib{s_suppkey}.m1 import f, make")
        + " when j = 0 then " + _text("from . import m1", "f = m1.f", "make = m1.make")
        + f" when j = n and {_CIRCLE} then " + _text("from .m1 import f, make")
        + " when j = n then " + _text(
            "class C:", "    def old(self):", "        pass", "def f():", "    pass", 'def make(x) -> "C | None":', "    return C()")
        + " when j % 2 = 0 then " + _text("from .m{j + 1} import f, make")
        + " else " + _text("try:", "    from lib{s_suppkey}.m{j + 1} import f, make", "except ImportError:", "    f = None") + " end")
    return s.selectExpr(
        "concat(lib, case when j = 0 then '/__init__.py' else concat('/m', j, '.py') end) as file",
        "concat(lib, case when j = 0 then '' else concat('.m', j) end) as prefix", f"{code} as source")


def traced_names(spark, d) -> tuple[DataFrame, DataFrame]:
    names = rex.library_names(files(spark, d))
    exports = rex.re_exports(names)
    return exports, rex.returned(names, exports)


_LIBS = f"select s_suppkey as k, {_N} as n, {_CIRCLE} as circle, 'lib' || s_suppkey as lib, case when s_suppkey % 3 = 2 then 1 else 0 end as more from supplier"


@query("re_exports", f"""
    with l as ({_LIBS}), names as (select unnest(['f', 'make']) as name)
    select lib || '.' || name as from_symbol, case when not circle then lib || '.m' || n || '.' || name end as to_symbol,
      case when circle then 'cycle' else 'defined' end as kind, cast(n + more + case when circle and n > 1 then 1 else 0 end as integer) as hops from l, names
    union all
    select lib || '.m' || j || '.' || name, case when not circle then lib || '.m' || n || '.' || name end, case when circle then 'cycle' else 'defined' end,
      cast(case when circle then n else n - j end as integer) from (select *, unnest(range(1, case when circle then n + 1 else n end)) as j from l), names
    union all select lib || '.C', lib || '.m1.C', 'defined', 1 from l where k % 3 = 0 and n = 1 and not circle
    union all select lib || '.m1', lib || '.m1', 'module', 1 from l where more = 1""")
def re_exports(spark, d):
    exports, _ = traced_names(spark, d)
    return exports.select("from_symbol", "to_symbol", "kind", "hops")


@query("annotated_returns", f"""
    select lib || '.m' || n || '.make' as function, lib || '.m' || n || '.C' as made from ({_LIBS}) where not circle""")
def annotated_returns(spark, d):
    return traced_names(spark, d)[1].select("function", "made")


@query("statuses_through_re_exports", f"""
    with l as ({_LIBS}), c as (select lib || '.m' || n || '.C.old' as old, lib || '.m' || n || '.f' as f from l where not circle)
    select lib as sample_id, 'f' as callee, case when circle then 'resolved_benign' else 'resolved_deprecated' end as status,
      case when circle then lib || '.f' else lib || '.m' || n || '.f' end as qualified_name, case when not circle then lib || '.m' || n || '.f' end as matched, null as reason from l
    union all select lib, 'old', case when circle then 'low_confidence' else 'resolved_deprecated' end, case when not circle then lib || '.m' || n || '.C.old' end,
      case when circle then (select min(old) from c) else lib || '.m' || n || '.C.old' end, case when circle then 'unresolved_receiver' end from l""")
def statuses_through_re_exports(spark, d):
    """Calls of re-exported functions and of methods of what they return."""
    exports, returns = traced_names(spark, d)
    s = suppliers(spark, d)
    samples = s.selectExpr(
        "concat('lib', s_suppkey) as sample_id", _text("import lib{s_suppkey} as lib", "def g():", "    lib.f()", "    x = lib.make(1)", "    return x.old()") + " as function")
    catalog = table(spark, d, "supplier").where(f"not ({_CIRCLE})").selectExpr(f"explode(array(concat('lib', {_K}, '.m', {_N}, '.f'), concat('lib', {_K}, '.m', {_N}, '.C.old'))) as qualified_name")
    got = res.call_statuses(samples, catalog, F.lit(""), carry=["sample_id"], aliases=exports, returns=returns)
    return got.select("sample_id", "callee", "status", "qualified_name", "matched", "reason")


_PARTS = f"select {', '.join(combined_source('({0} // {1})')[:-1])}, c_custkey as k from customer"


@query("find_candidates_combined", f"""
    with s as ({_PARTS})
    select prefix || case a when 0 then '.fa::old' when 1 then '.fa::o' when 2 then '.fa' else '.old' end as qualified_name, 'decorator' as origin,
      case when a < 2 then 'parameter' else 'function' end as scope, case when a = 3 then 'use ' || k end as message from s
    union all select prefix || case b when 0 then '.fb::p+q' when 1 then '.fb::p' when 2 then '.fb' else '.fb::k' end, 'warning', case when b = 2 then 'function' else 'parameter' end, null from s
    union all select prefix || '.fb::q', 'warning', 'parameter', null from s where b = 1
    union all select prefix || '.fc', 'comment', 'function', null from s
    union all select prefix || case d when 0 then '.K.L.m' else '.outer.inner' end, case d when 0 then 'docstring' else 'warning' end, 'function', null from s""")
def find_candidates_combined(spark, d):
    """All rules on files whose parts vary independently of one another."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = table(spark, d, "customer").select("c_custkey").repartition(parts, "c_custkey").selectExpr(*combined_source("cast(floor({0} / {1}) as bigint)"))
    found = find_candidates(files.select("file", "prefix", "source"))
    return found.select("qualified_name", "origin", "scope", F.when(F.col("qualified_name").endswith(".old"), F.col("message")).alias("message"))
