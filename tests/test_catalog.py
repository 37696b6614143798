from pyspark.sql import functions as F

from wane.operators import catalog as cat
from wane.schemas import CANDIDATE


def union(spark, rows, **kw):
    base = dict(file="m.py", line=0, raw_evidence="", origins=None, scope="function", param_name=None, function_name=None, message=None)
    cols = [c.split()[0] for c in CANDIDATE.split(", ")]
    data = [tuple({**base, **r, "ord": i}[c] for c in cols) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, CANDIDATE).repartition(5)
    return cat.union_candidates(df, **kw).orderBy("ord").collect()


def test_channels_of_one_declaration_merge(spark):
    rows = union(spark, [
        dict(qualified_name="p.f", origin="decorator", line=4, raw_evidence="@d"),
        dict(qualified_name="p.f", origin="docstring", line=6, raw_evidence="doc"),
        dict(qualified_name="p.f", origin="warning", line=10, raw_evidence="w", message="first"),
        dict(qualified_name="p.f", origin="warning", line=11, raw_evidence=" w ", message="last"),
        dict(qualified_name="p.f", origin="comment", line=5, raw_evidence="# c"),
        dict(qualified_name="p.f", origin="warning", line=10, raw_evidence="w", file="other.py")])
    assert len(rows) == 2
    r = rows[0]
    assert (r.line, r.origin, r.origins) == (4, "decorator", ["comment", "decorator", "docstring", "warning"])
    assert r.raw_evidence == "@d | doc | w | # c" and r.message == "last" and r.raw_hits == 5


def test_scopes_stay_apart_and_parameters_are_sorted(spark):
    rows = union(spark, [
        dict(qualified_name="f", origin="decorator", line=3),
        dict(qualified_name="f::alpha+beta", origin="warning", scope="parameter", param_name="alpha+beta", line=32),
        dict(qualified_name="f::beta+alpha", origin="warning", scope="parameter", param_name="beta+alpha", line=30),
        dict(qualified_name="f", origin="comment", scope="class", line=1)])
    assert [(r.qualified_name, r.scope, r.line) for r in rows] == [
        ("f", "function", 3), ("f::alpha+beta", "parameter", 30), ("f", "class", 1)]


def test_declared_message_wins(spark):
    tags = ["pep702", "pep702:griffe"]
    r, = union(spark, [
        dict(qualified_name="f", origin="docstring", line=16, raw_evidence="d", message="other"),
        dict(qualified_name="f", origin="pep702:griffe", origins=tags, line=15, raw_evidence="e", message="declared"),
        dict(qualified_name="f", origin="warning", line=20, raw_evidence="x", message="late")])
    assert r.message == "declared" and r.origin == "pep702:griffe" and r.line == 15
    assert r.origins == ["docstring", "pep702", "pep702:griffe", "warning"]


def test_union_is_idempotent_and_ignores_partitioning(spark):
    rows = [dict(qualified_name=f"f{i % 7}", origin=["warning", "comment"][i % 2], line=i % 5, raw_evidence=f"e{i % 3}") for i in range(200)]
    once = union(spark, rows)
    again = spark.createDataFrame([tuple(r[c.split()[0]] for c in CANDIDATE.split(", ")) for r in once], CANDIDATE)
    twice = cat.union_candidates(again).orderBy("ord").collect()
    strip = lambda rs: [{k: v for k, v in r.asDict().items() if k != "raw_hits"} for r in rs]
    assert strip(once) == strip(twice) and sum(r.raw_hits for r in once) == 200


def test_paths_are_compared_in_canonical_form(spark):
    rows = union(spark, [dict(qualified_name="f", origin="warning", file="./a//b/./m.py", line=1),
                         dict(qualified_name="f", origin="comment", file="a/b/m.py", line=2)])
    assert len(rows) == 1 and rows[0].file == "./a//b/./m.py"
    assert len(union(spark, [dict(qualified_name="f", origin="warning", file=f"lib-{v}/lib/m.py") for v in ("1.0", "2.0")],
                     across_snapshots=True)) == 1


def test_coverage_and_statistics(spark):
    rows = [("numpy.core.fromnumeric.product", ["warning"], "a.py", 1, "ev", "function", 0),
            ("pandas.core.generic.NDFrame.pad", ["docstring", "pep702"], "b.py", 2, "x" * 300, "function", 1),
            ("numpy.f::p", ["warning", "decorator"], "c.py", 3, "y", "parameter", 2)]
    c = spark.createDataFrame(rows, "qualified_name string, origins array<string>, file string, line int, raw_evidence string, scope string, ord bigint")
    cov = {r.target_api: r for r in cat.target_coverage(c).collect()}
    assert len(cov) == 31 and sum(r.status == "DETECTED" for r in cov.values()) == 3
    assert cov["numpy.product"].location == "a.py:1" and len(cov["pandas.Series.pad"].evidence_snippet) == 150
    total = [r for r in cat.coverage_summary(cat.target_coverage(c)).collect() if r.library is None][0]
    assert (total.n_targets, total.n_detected, total.coverage_pct) == (31, 3, 9.7)
    assert {r.origin: r.n for r in cat.origin_counts(c).collect()} == {"warning": 2, "docstring": 1, "decorator": 1, "parameter": 1}
    assert {r.n_origins: r.n for r in cat.origin_multiplicity(c).collect()} == {1: 2, 2: 1, 3: 0, 4: 0, 5: 0}
    labels = {r.target_api: r.origin_tag for r in cat.origin_label(cat.target_coverage(c)).collect()}
    assert labels["pandas.DataFrame.pad"] == "multi_origin (docstring + pep702)" and labels["scipy.misc.comb"] == "unscanned_miss"


def test_union_combines_before_the_shuffle(spark):
    df = spark.createDataFrame([], CANDIDATE)
    plan = cat.union_candidates(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") >= 2 and "Window" not in plan
