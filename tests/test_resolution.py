import re
from textwrap import dedent

from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.operators import resolution as res
from wane.operators.matching import target_dim


def run(spark, *codes, preamble=None, catalog=None):
    df = spark.createDataFrame([(f"s{i}", "pandas", dedent(c)) for i, c in enumerate(codes)], "sample_id string, library string, function string")
    cat = target_dim(spark) if catalog is None else catalog
    p = F.lit(None).cast("string") if preamble is None else preamble
    return res.call_statuses(df, cat, p, name="target_api", order=["ord"]).orderBy("sample_id", "idx").collect()


RESOLVED = {
    "numpy.alltrue": "import numpy as np\n\ndef f(a):\n    return np.alltrue(a)\n",
    "numpy.product": "from numpy import product as p\nproduct = p\nproduct([1])\n",
    "pandas.DataFrame.iteritems": "import pandas as pd\n\nclass C(pd.DataFrame):\n    pass\n\ndef f(df: C):\n    for k in df.iteritems():\n        pass\n",
    "pandas.DataFrame.first": "import pandas as pd\n\nclass C(pd.DataFrame):\n    def first(self):\n        return super().first()\n",
    "numpy.cumproduct": "from numpy import *\n\ndef f(m):\n    return cumproduct(m)\n",
    "scipy.misc.comb": "import scipy.misc as sm\n\ndef f(n):\n    return sm.comb(n, 2)\n",
    "pandas.Series.pad": "import pandas as pd\ns = pd.Series([1])\ns.pad()\n",
    "pandas.DataFrame.applymap": "from pandas import DataFrame\nDataFrame([1]).applymap(str)\n",
    "pandas.DataFrame.last": "import pandas as pd\nclass D(pd.DataFrame):\n    def g(self):\n        return self.last('1D')\n",
}


def test_resolved_forms(spark):
    rows = run(spark, *RESOLVED.values())
    got = {r.sample_id: (r.status, r.matched) for r in rows}
    assert got == {f"s{i}": ("resolved_deprecated", t) for i, t in enumerate(RESOLVED)}


def test_benign_and_low_confidence(spark):
    rows = run(
        spark,
        "from itertools import product\nproduct([1])\n",
        "import pandas as pd\ndef f(df):\n    for k, v in df.iteritems():\n        pass\n",
        "def f(x):\n    return alltrue(x)\n",
        'import numpy as np\ndef f(a):\n    return getattr(np, "alltrue")(a)\n',
        "def broken(:\n    return 1\n",
        " def compute(*args):\n\t\timport numpy as np\n\t\treturn np.alltrue(*args)\n",
        "import numpy as np\nnp.zeros(3)\n")
    got = {r.sample_id: (r.status, r.callee, r.reason, r.matched) for r in rows}
    assert got["s0"] == ("resolved_benign", "product", None, None)
    assert got["s1"] == ("low_confidence", "iteritems", "unresolved_receiver", "pandas.DataFrame.iteritems")
    assert got["s2"] == ("low_confidence", "alltrue", "empty_goto", "numpy.alltrue")
    assert got["s3"] == ("low_confidence", "alltrue", "dynamic_dispatch", "numpy.alltrue")
    assert got["s4"][2] == "syntax_error" and got["s5"][:2] == ("resolved_deprecated", "alltrue") and "s6" not in got


def test_two_calls_on_one_line(spark):
    rows = run(spark, "import numpy as np\nassert eq(np.product(x), product(x))\n")
    by = {r.client_col: (r.status, r.reason) for r in rows}
    assert by == {13: ("resolved_deprecated", None), 25: ("low_confidence", "empty_goto")}


def test_preamble_supplies_missing_imports(spark):
    assert run(spark, "np.alltrue(x)\n")[0].reason == "unresolved_receiver"
    r, = run(spark, "np.alltrue(x)\n", preamble=res.baseline_preamble())
    assert (r.status, r.client_line, r.client_col) == ("resolved_deprecated", 1, 3)


def test_re_exports(spark):
    df = spark.createDataFrame([("s", "scipy", "import scipy.misc as m\nm.comb(1)\n")], "sample_id string, library string, function string")
    aliases = spark.createDataFrame(fixed.RE_EXPORTS, "from_symbol string, to_symbol string")
    cat = spark.createDataFrame([("scipy.special.comb", 0)], "target_api string, ord int")
    rows = res.call_statuses(df, cat, F.lit(None).cast("string"), "target_api", ["ord"], aliases=aliases).collect()
    assert rows[0].matched == "scipy.special.comb"


def test_manifest_rules(spark):
    codes = ["import numpy as np\nnp.product(x)\nnp.alltrue(y)\n", "def f(df):\n    df.iteritems()\n    df.first()\n", "def f(df):\n    df.iteritems()\n"]
    s = spark.createDataFrame([(f"pandas_{i}", "pandas", i, ["up-to-dated", "outdated", "up-to-dated"][i], c) for i, c in enumerate(codes)],
                              "sample_id string, library string, sample_idx int, category string, function string")
    st = res.call_statuses(s, target_dim(spark), F.lit(None).cast("string"), "target_api", ["ord"], carry=["sample_id", "library", "sample_idx", "category"])
    m = {r.candidate_id: r for r in res.build_manifest(st, s).collect()}
    # an up-to-date sample keeps only resolved calls; "first" is not a pilot name
    assert sorted(m) == ["pandas_0_res_0_2_3", "pandas_0_res_1_3_3", "pandas_1_lc_0_2_7"]
    assert m["pandas_0_res_0_2_3"].recommended_replacement == "numpy.prod" and m["pandas_1_lc_0_2_7"].mode == "inference"
    assert m["pandas_1_lc_0_2_7"].enclosing_code == codes[1]
    total = [r for r in res.census(res.build_manifest(st, s)).collect() if r.library is None][0]
    assert (total.resolved_deprecated_calls, total.target_low_confidence_calls, total.total_candidate_calls) == (2, 1, 3)


def test_one_python_pass(spark):
    from wane.functions.syntax import snippet_calls
    df = spark.createDataFrame([("s", "x")], "sample_id string, function string")
    out = df.select("sample_id", snippet_calls(F.col("function")).alias("s"))
    out = out.select("sample_id", F.explode_outer("s.calls").alias("c"), "s.ok").where("c is not null")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_leaf_prediction_reports_the_first_target(spark):
    items = spark.createDataFrame([("x.pad()\ny.zip()", 1), ("x.pad()\ny.zip()", 2)], "enclosing_code string, client_line int")
    rows = res.leaf_on_line(items, fixed.TARGET_LIST).orderBy("client_line").collect()
    assert [(r.pred_a, r.matched_target_a) for r in rows] == [(True, "pandas.Series.pad"), (False, None)]


def test_long_chains_and_deep_code_stay_rows():
    from wane.functions.syntax import definition_rows, snippet_rows

    methods = snippet_rows("x" + ".f()" * 1500)
    assert methods["ok"] and len(methods["calls"]) == 1500 and methods["calls"][0]["receiver_expr"] == "x" + ".f()" * 1499
    terms = "+".join(["a"] * 6000)
    assert snippet_rows(f"({terms}).sum()")["calls"][0]["receiver_expr"].strip("()") == terms
    (row,) = definition_rows(f"def f(b):\n    if {terms}:\n        warnings.warn('deprecated', DeprecationWarning)\n")
    assert row["warns"][0]["guards"][0]["test"] == terms


def test_alias_chains_of_any_length_and_circles(spark):
    chain = "from numpy import product as p0\n" + "".join(f"p{i + 1} = p{i}\n" for i in range(50)) + "product = p50\nproduct(x)\n"
    rows = run(spark, chain, "a = b\nb = a\na.product()\n")
    assert [(r.status, r.qualified_name) for r in rows] == [("resolved_deprecated", "numpy.product"), ("low_confidence", None)]


SETS = {
    # the later assignment hides the earlier one only where it must run
    "import numpy as np\nimport itertools as it\nproduct = np.product\nproduct = it.product\nproduct(x)\n": ("resolved_benign", "itertools.product", None),
    "import numpy as np\nimport itertools as it\nproduct = np.product\nproduct(x)\nproduct = it.product\n": ("resolved_deprecated", "numpy.product", None),
    "import numpy as np\nimport itertools as it\nproduct = np.product\nif x:\n    product = it.product\nproduct(x)\n": ("low_confidence", None, "ambiguous_definitions"),
    "import numpy as np\nimport itertools as it\nproduct = np.product\nif x:\n    product = it.product\n    product(x)\n": ("resolved_benign", "itertools.product", None),
    "if x:\n    from numpy import product\nelse:\n    from itertools import product\n    product(x)\n": ("resolved_benign", "itertools.product", None),
    "if x:\n    from numpy import product\nelse:\n    from itertools import product\nproduct(x)\n": ("low_confidence", None, "ambiguous_definitions"),
    "try:\n    from scipy.misc import comb\nexcept ImportError:\n    from scipy.special import comb\ncomb(3)\n": ("low_confidence", None, "ambiguous_definitions"),
    "try:\n    from numpy import product\nexcept ImportError:\n    product = None\nproduct(3)\n": ("resolved_deprecated", "numpy.product", None),
    "if x:\n    from numpy import product\nelse:\n    from numpy.core.fromnumeric import product\nproduct(3)\n": ("resolved_deprecated", "numpy.product", None),
    "if x:\n    from a.b import product\nelif y:\n    from a.b import product as product\nproduct(3)\n": ("resolved_benign", "a.b.product", None),
    "import numpy as np\ndef f():\n    return np.product(3)\nimport itertools as np\n": ("resolved_benign", "itertools.product", None),
    "match x:\n    case 1:\n        from numpy import product\n    case _:\n        from itertools import product\nproduct(3)\n": ("low_confidence", None, "ambiguous_definitions"),
    "class A:\n    def product(self):\n        return self.product()\n": ("resolved_benign", "__main__.A.product", None),
    "import pandas as pd\nclass A(pd.DataFrame):\n    pass\nclass B(A):\n    def g(self):\n        self.iteritems()\n": ("resolved_deprecated", "pandas.DataFrame.iteritems", None),
}


def test_definitions_that_reach_a_call(spark):
    rows = run(spark, *SETS)
    got = {r.sample_id: (r.status, r.qualified_name, r.reason) for r in rows}
    assert got == {f"s{i}": want for i, want in enumerate(SETS.values())}
    assert len(rows) == len(SETS)


def test_two_preambles_share_one_parse(spark, monkeypatch):
    seen = []
    kept = res.snippet_calls
    monkeypatch.setattr(res, "snippet_calls", lambda *a: seen.append(a) or kept(*a))
    df = spark.createDataFrame([("s", "pandas", "comb(1)\nnp.alltrue(x)\n")], "sample_id string, library string, function string")
    preambles = {"baseline": res.baseline_preamble(), "with": F.lit("from scipy.misc import comb\n")}
    got = res.compared_statuses(df, target_dim(spark), preambles, "target_api", ["ord"])
    assert len(seen) == 1
    for name, want in (("baseline", ["low_confidence"]), ("with", ["resolved_deprecated"])):
        assert "ArrowEvalPython" not in got[name]._jdf.queryExecution().executedPlan().toString()
        assert [r.status for r in got[name].where("callee = 'comb'").collect()] == want
    assert [r.matched for r in got["baseline"].where("callee = 'alltrue'").collect()] == ["numpy.alltrue"]


def test_manifest_reads_the_code_in_place(spark):
    from wane.session import shared_folder

    s = spark.createDataFrame([(f"pandas_{i}", "pandas", i, "outdated", "import numpy as np\nnp.product(x)\n") for i in range(20)],
                              "sample_id string, library string, sample_idx int, category string, function string")
    st = res.call_statuses(s, target_dim(spark), F.lit(None).cast("string"), "target_api", ["ord"], carry=["sample_id", "library", "sample_idx", "category"])
    broad = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        m = res.build_manifest(res.by_sample(st, shared_folder(spark, "st")), res.by_sample(s, shared_folder(spark, "s")))
        plan = m._sc._jvm.PythonSQLUtils.explainString(m._jdf.queryExecution(), "formatted")
        exchanges = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part)]
        assert exchanges and not any("function#" in part for part in exchanges)
        assert m.count() == 20 and m.first().enclosing_code.startswith("import numpy")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broad)


def test_code_that_the_parser_gives_up_on_is_a_row(spark):
    (r,) = run(spark, "x = " + "-" * 200_000 + "1\n")
    assert (r.status, r.reason) == ("low_confidence", "jedi_exception") and r.details
    from wane.functions.syntax import definition_rows
    (row,) = definition_rows("x = " + "-" * 200_000 + "1\n")
    assert row["kind"] == "error" and "Error" in row["message"]


def test_place_of_a_call_over_several_lines():
    from wane.functions.syntax import snippet_rows

    (call,) = snippet_rows("y = (df\n     .é\n     .iteritems())\n")["calls"]
    assert (call["line"], call["col"], call["receiver"], call["text"]) == (3, 6, "é", ".iteritems())")
