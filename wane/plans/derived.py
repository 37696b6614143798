"""Study inputs derived row by row from the test tables.

The tables hold no Python code. Each entry maps every row of one table to a record
the operators understand; the expressions are plain SQL that both engines read, so a
query and its check start from the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


_NL = "chr(10)"


def _text(*lines: str) -> str:
    """SQL for lines of text; ``{expr}`` parts are SQL expressions."""
    out = []
    for line in lines:
        bits = []
        while "{" in line:
            before, rest = line.split("{", 1)
            expr, line = rest.split("}", 1)
            if before:
                bits.append("'" + before.replace("'", "''") + "'")
            bits.append(f"cast({expr} as varchar(100))")
        if line:
            bits.append("'" + line.replace("'", "''") + "'")
        out.append(" || ".join(bits) if bits else "''")
    return " || ".join(f"{x} || {_NL}" for x in out)


CANDIDATES = ("events", [
    "'app.user' || cast(user_id as varchar(20)) || case when event_type = 'purchase' then '::p' else '' end as qualified_name",
    "case event_type when 'click' then 'decorator' when 'view' then 'docstring' when 'purchase' then 'warning' "
    "when 'error' then 'comment' else 'pep702:griffe' end as origin",
    "'day/./' || cast(cast(ts as date) as varchar(20)) as file",
    "hour(ts) as line",
    "' ' || event_type || ' ' || props as raw_evidence",
    "case when event_type = 'purchase' then 'parameter' else 'function' end as scope",
    "case when event_type <> 'purchase' then null when value > 20 then 'b+a' else 'a+b' end as param_name",
    "cast(null as varchar(10)) as function_name",
    "case when event_type in ('signup', 'error') then 'm' || cast(event_id as varchar(20)) else null end as message",
    "event_id as ord",
    "event_type as detector_name",
])

HOT_CANDIDATES = ("lineitem", [
    "'pkg.f' || l_returnflag || '::x' as qualified_name",
    "case when l_linestatus = 'O' then 'warning' else 'decorator' end as origin",
    "'pkg/mod.py' as file",
    "l_linenumber as line",
    "l_linestatus as raw_evidence",
    "'parameter' as scope",
    "case when l_linenumber in (1, 3, 5, 7) then l_returnflag || '+' || l_linestatus "
    "else l_linestatus || '+' || l_returnflag end as param_name",
    "'pkg.f' || l_returnflag as function_name",
    "cast(null as varchar(10)) as message",
    "l_orderkey * 8 + l_linenumber as ord",
])

SOURCES = ("part", [
    "'src/' || p_brand || '/m' || cast(p_partkey as varchar(20)) || '.py' as file",
    "'lib.m' || cast(p_partkey as varchar(20)) as prefix",
    "p_type as kind",
    "case p_type "
    "when 'ECONOMY' then " + _text(
        "import warnings", '@deprecated("use n{p_partkey}")', "def f(a, b=None):", '    """Old.', "",
        '    Deprecated since {p_size}."""', "    return a")
    + " when 'SMALL' then " + _text(
        "import warnings", "class W{p_size}(DeprecationWarning):", "    pass", "def f(a, b=None):",
        "    if b is not None:", '        warnings.warn("b is old", W{p_size})', "    return a")
    + " when 'MEDIUM' then " + _text(
        "x = 1", "# Deprecated: {p_brand}", "class C{p_partkey}:", "    def m(self):  # not deprecated", "        return 1")
    + " when 'PROMO' then " + _text(
        "from typing_extensions import deprecated", '@deprecated("use {p_name}")', "def f():", "    pass")
    + " when 'STANDARD' then " + _text(
        "def f(b, a):", "    if b and a:", "        pass", "    else:", '        warnings.warn("x", FutureWarning)')
    + " else " + _text("def f(a):", "    return a + {p_size}") + " end as source",
])

SNIPPETS = ("customer", [
    "'numpy_' || cast(c_custkey as varchar(20)) as sample_id",
    "case c_mktsegment when 'BUILDING' then 'pandas' when 'MACHINERY' then 'scipy' else 'numpy' end as library",
    "cast(c_custkey as int) as sample_idx",
    "case when c_acctbal < 5000 then 'outdated' else 'up-to-dated' end as category",
    "c_mktsegment as kind",
    "c_nationkey as nation",
    "case c_nationkey % 3 when 0 then 'alltrue' when 1 then 'product' else 'cumproduct' end as leaf",
    "case c_mktsegment "
    "when 'AUTOMOBILE' then 'import numpy as np' || chr(10) || 'def f(x):' || chr(10) || '    return np.' || "
    "case c_nationkey % 3 when 0 then 'alltrue' when 1 then 'product' else 'cumproduct' end || '(x)' || chr(10) "
    "when 'BUILDING' then " + _text("import pandas as pd", "def f(pdf):", "    return pdf.iteritems()")
    + " when 'FURNITURE' then " + _text("def f(x):", "    return alltrue(x) + np.zeros(3)")
    + " when 'HOUSEHOLD' then " + _text(
        "from itertools import product", "def f(x):", "    return product(x, x) + len(x)")
    + " else case when c_nationkey % 2 = 0 then " + _text(
        "import scipy.misc as sm", "def f(n):", '    return getattr(sm, "comb")(n)')
    + " else " + _text("def broken(:", "    return {c_nationkey}") + " end end as function",
])

def combined_source(div: str) -> list[str]:
    """Library files of four independent parts: a decorator or assignment, a guarded warning, a comment, a nested definition.

    ``div`` is the engine's integer division, with two placeholders.
    """
    n = "c_custkey"
    a, b, c, d = f"{n} % 4", f"{div.format(n, 4)} % 4", f"{div.format(n, 16)} % 3", f"{div.format(n, 48)} % 2"
    warn = '        warnings.warn("m", FutureWarning)'
    text = (
        f"case {a} when 0 then " + _text('@deprecate_kwarg("old", "new")', "def fa(new): pass")
        + " when 1 then " + _text('@deprecate_kwarg(new_arg_name="n", old_arg_name="o")', "def fa(n): pass")
        + " when 2 then " + _text('@deprecated("argument x is obsolete")', "def fa(x): pass")
        + " else " + _text("def fa(x): pass", 'old = np.deprecate(fa, message="use {c_custkey}")') + " end || "
        + f"case {b} when 0 then " + _text("def fb(p, q):", "    if p and q:", warn) + " when 1 then " + _text("def fb(p, q):", "    if p or q:", warn)
        + " when 2 then " + _text("def fb(p, q):", "    if GLOBAL:", warn) + " else " + _text("def fb(p, **kw):", '    if "k" in kw:', warn) + " end || "
        + f"case {c} when 0 then " + _text("# Deprecated: use y", "def fc(): pass") + " when 1 then " + _text("def fc():  # deprecated since 2", "    pass")
        + " else " + _text("def fc():", "    # leading deprecation note", "    return 1") + " end || "
        + f"case {d} when 0 then " + _text("class K:", "    class L:", "        def m(self):", '            """Deprecated."""')
        + " else " + _text("def outer():", "    def inner():", warn) + " end as source")
    return [
        f"'lib.m' || cast({n} as varchar(20)) as prefix", f"'m' || cast({n} as varchar(20)) || '.py' as file",
        f"cast({a} as int) as a", f"cast({b} as int) as b", f"cast({c} as int) as c", f"cast({d} as int) as d", text]


# one snippet for each pool of the benchmark's negatives and misses, some for two
POOLED = ("part", [
    "cast(p_partkey % 10 as int) as kind",
    "case when p_partkey % 10 in (4, 5, 7) then 'pandas' when p_partkey % 10 in (6, 9) then 'numpy' else 'scipy' end as library",
    "case when p_partkey % 10 in (4, 5, 7) then 'pandas' when p_partkey % 10 in (6, 9) then 'numpy' else 'scipy' end || '_' || cast(p_partkey as varchar(20)) as sample_id",
    "cast(p_partkey as int) as sample_idx",
    "case when p_size > 15 then 'up-to-dated' else 'outdated' end as category",
    "case p_partkey % 10 when 0 then " + _text("import scipy.special as sps", "sps.comb({p_size})")
    + " when 1 then " + _text("simpson(y)", "x = cumulative_trapezoid(y)") + " when 2 then " + _text("linalg.pinv(a)")
    + " when 3 then " + _text("misc.ascent()") + " when 4 then " + _text("df.map(f)", "x.ffill()")
    + " when 5 then " + _text("import pyspark", "psdf.items()") + " when 6 then " + _text("itertools.product(a)")
    + " when 7 then " + _text("it.product(psdf.first())") + " when 8 then " + _text("errprint()", "stats.rvs_ratio_uniforms(f)")
    + " else " + _text("x = {p_size}") + " end as function",
])

# calls that the two preambles resolve differently, and one of every reason for doubt
VARIED = ("customer", [
    "'v_' || cast(c_custkey as varchar(20)) as sample_id",
    "case c_nationkey % 3 when 0 then 'numpy' when 1 then 'pandas' else 'scipy' end as library",
    "case when c_acctbal < 5000 then 'outdated' else 'up-to-dated' end as category",
    "cast(c_custkey % 10 as int) as kind",
    "case c_custkey % 10 when 1 then 'pandas.io.formats.style.Styler.render' when 2 then 'scipy.misc.comb' when 3 then 'pandas.DataFrame.applymap' "
    "when 4 then 'scipy.misc.comb' when 5 then 'numpy.product' when 9 then 'pandas.DataFrame.iteritems' else 'numpy.alltrue' end as api",
    "case c_custkey % 10 when 0 then " + _text("def f(x):", "    return np.alltrue(x)")
    + " when 1 then " + _text("Styler(x).render()") + " when 2 then " + _text("choose = comb", "y = comb(5, {c_nationkey})")
    + " when 3 then " + _text("DataFrame(x).applymap(str)") + " when 4 then " + _text("scipy.special.comb(3)")
    + " when 5 then " + _text("if x:", "    from numpy import product", "else:", "    from itertools import product", "product({c_nationkey})")
    + " when 6 then 'x = ' || repeat('-', 20000) || '1' when 7 then " + _text("def broken(:")
    + " when 8 then " + _text('getattr(np, "alltrue")(x)') + " else " + _text("for k in pdf.iteritems():", "    pass") + " end as function",
])

# symbols of line items and a catalog of parts; both carry the part's name as leaf
SYMBOLS = ("lineitem join part on l_partkey = p_partkey", [
    "case when l_returnflag = 'A' and l_linestatus = 'O' then 'pandas.DataFrame.' "
    "when l_returnflag = 'A' then 'DataFrame.' "
    "when l_returnflag = 'N' and l_linestatus = 'O' then 'numpy.' "
    "when l_returnflag = 'N' then 'numpy.core.fromnumeric.' "
    "when l_linestatus = 'O' then 'pandas.core.generic.NDFrame.' else '' end || replace(p_name, ' ', '_') as symbol",
    "l_quantity as quantity",
])

PART_CATALOG = ("part", [
    "case p_type when 'ECONOMY' then 'pandas.Series.' when 'SMALL' then 'pandas.core.frame.DataFrame.' "
    "when 'MEDIUM' then 'numpy.' when 'PROMO' then 'numpy.core.umath.' when 'STANDARD' then 'NDFrame.' "
    "else 'scipy.misc.' end || replace(p_name, ' ', '_') as qualified_name",
    "case p_type when 'ECONOMY' then 'warning' when 'SMALL' then 'docstring' else 'comment' end as origin",
    "case when p_size > 25 then 'msg ' || cast(p_partkey as varchar(20)) else null end as message",
    "case when p_size % 2 = 0 then 'Deprecated ' || p_brand else p_brand end as raw_evidence",
    "'/data/benchmark_libs/' || p_brand || '/m.py:' || cast(p_size as varchar(10)) as location",
    "p_partkey as ord",
])

# names that may denote one of the targets
TARGET_NAMES = ("part", [
    "p_partkey as id",
    "case p_type when 'ECONOMY' then 'numpy.' when 'SMALL' then 'numpy.core.fromnumeric.' when 'MEDIUM' then "
    "'pandas.core.generic.NDFrame.' when 'PROMO' then 'pandas.DataFrame.' when 'STANDARD' then 'scipy.misc.' "
    "else 'scipy.special._basic.' end || "
    "case p_size % 10 when 0 then 'alltrue' when 1 then 'product' when 2 then 'cumproduct' when 3 then 'pad' "
    "when 4 then 'comb' when 5 then 'factorial' when 6 then 'first' when 7 then 'iteritems' when 8 then 'face' "
    "else 'zeros' end as symbol",
])

REQUESTS = ("documents", [
    "'c' || cast(doc_id as varchar(20)) as candidate_id",
    "'s' || cast(doc_id as varchar(20)) as sample_id",
    "source as library",
    "lang as cohort",
    "case when n_chars > 1000 then 'resolved_deprecated' else 'low_confidence' end as stage2_status",
    "case when n_chars > 1000 then 'confirmation' else 'inference' end as mode",
    "'lib.' || source as target_api",
    "cast(n_chars % 97 as int) as client_line",
    "case lang when 'en' then 'psdf.pad()' when 'fr' then ' pdf.pad() ' when 'de' then 'x.pad()' else 'itertools.product()' end "
    "|| ' # ' || cast(n_chars % 50 as varchar(10)) as call_site_snippet",
    "text as enclosing_code",
    "case when n_chars > 1000 then null else 'unresolved_receiver' end as failure_reason",
    "case when lang = 'en' then 'new.' || source else null end as recommended_replacement",
    "cast(null as varchar(10)) as evidence_warning",
    "case when lang <> 'de' then 'doc of ' || source else null end as evidence_docstring",
])


def load(spark: SparkSession, folder: str, spec: tuple[str, list[str]]) -> DataFrame:
    """The derived records as a DataFrame; code to be parsed is dealt by its key."""
    table, exprs = spec
    if " join " in table:
        left, rest = table.split(" join ")
        right, cond = rest.split(" on ")
        a, b = (c.strip() for c in cond.split("="))
        l, r = (spark.read.parquet(f"{folder}/{t.strip()}.parquet") for t in (left, right))
        df = l.join(r, l[a] == r[b])
    else:
        df = spark.read.parquet(f"{folder}/{table}.parquet")
        if spec in (SOURCES, SNIPPETS, VARIED, POOLED):
            # parsing costs far more than reading: deal the rows by a key that every one of them has
            key = "p_partkey" if table == "part" else "c_custkey"
            df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    return df.selectExpr(*exprs)


def sql(spec: tuple[str, list[str]]) -> str:
    """The same records as a SELECT."""
    return f"select {', '.join(spec[1])} from {spec[0]}"
