"""Queries against their SQL on tables that hold what the small tables lack."""

import duckdb
import pytest

import __spark_entry__ as entry

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars int"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture
def against_sql(spark, tmp_path):
    """A function that writes tables and returns the rows of a query and of its SQL, both sorted."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        rows = sorted(map(repr, map(tuple, df.collect())))
        return rows, sorted(map(repr, con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()))

    return run


def test_fresh_wrappers_ask_for_the_words_of_their_check(against_sql):
    texts = ["a dask b", "no word", "KS.x", "koalas", "psdf in code"]
    docs = [(i, t, lang, "web", 10) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("en", "fr", "de"))]
    got, want = against_sql("fresh_wrappers", documents=(docs, DOCUMENTS), labels=([(0, 1, 0), (1, 1, 1)], LABELS))
    assert got == want and len(got) == 5


def test_words_begin_and_spaces_end_as_in_the_check(against_sql):
    texts = ["the", "éthe", "a_the", "9the", "éon the", "the \u0301on the", "a on\u000bthe the", "on\u00a0the x the", "in\u2028the the", "THE in\fthe",
             "on\r\nthe", "\u0301the", "ſthe", "x\u200dthe", "𝒳the", None, ""]
    docs = [(i, t, "en", "web", 1) for i, t in enumerate(texts)]
    got, want = against_sql("regex_negation", documents=(docs, DOCUMENTS))
    assert got == want and got


def test_long_logs_are_replayed_in_runs_of_steps(spark):
    import random

    from wane.operators import annotation as ann

    rnd, actions = random.Random(5), ["accept", "decide", "skip", "revise", "adjudicate", "reset", "dance"]
    log = sorted(((rnd.randrange(0, 400_000), rnd.choice(actions), rnd.choice([True, False, None])) for _ in range(4000)), key=lambda e: e[0])
    log = [*{e[0]: e for e in log}.values()]
    items = spark.createDataFrame([("a", "pre_labeled", True), ("b", "pre_labeled", None), ("c", None, False)], "benchmark_id string, annotation_status string, is_deprecated_call boolean")
    events = spark.createDataFrame([(i, *e) for i in "abcd" for e in log], "benchmark_id string, step long, action string, decision boolean")
    steps = ann.steps(items, events)
    assert "collect_list" not in steps._jdf.queryExecution().toString()
    got = {(r.benchmark_id, r.step): r.reason for r in steps.collect()}
    ends = {r.benchmark_id: (r.is_deprecated_call, r.annotation_status, r.annotator, r.steps) for r in ann.states(items, steps).collect()}
    for i, pre, own in (("a", True, True), ("b", True, None), ("c", False, False)):
        label, status, by, done = None, "unannotated", None, False
        for step, action, decision in log:
            made = action in ("decide", "revise", "adjudicate")
            why = ("unknown action" if action == "dance" else "no decision" if made and decision is None else "not documented" if action == "accept" and not pre
                   else "already decided" if action in ("accept", "decide", "skip") and done else "not decided" if action in ("reset", "adjudicate") and not done else None)
            assert got[i, step] == why
            if why is None and action != "skip":
                label = own if action == "accept" else decision if made else None
                status, by, done = ann.STATUSES[action], ann.ANNOTATORS.get(action), label is not None
        assert ends[i] == (label, status, by, len(log))
    assert len(got) == 3 * len(log)


def test_a_library_is_parsed_once(spark):
    from wane.operators import reexports as rex

    rows = [("lib/__init__.py", "lib", "from .a import f"), ("lib/a.py", "lib.a", "def f(): pass")]
    names = rex.library_names(spark.createDataFrame(rows, "file string, prefix string, source string"))
    assert "EvalPython" not in names._jdf.queryExecution().toString()
    assert [tuple(r) for r in rex.re_exports(names).select("from_symbol", "to_symbol").collect()] == [("lib.f", "lib.a.f")]


def test_mixed_parts_go_to_python_as_arrow(spark):
    from wane.operators.reconcile import match_pairs

    site = "_file string, _line int, _leaf string, _sym string, _ord bigint"
    at = ("f", 1, "pad")
    left = spark.createDataFrame([(*at, s, i) for i, s in enumerate(["pandas.DataFrame.pad", "pandas.core.generic.NDFrame.pad", "pandas.Series.pad"])], site)
    right = spark.createDataFrame([(*at, "pandas.core.frame.DataFrame.pad", 7), (*at, "pandas.core.generic.NDFrame.pad", 8)], site)
    got = match_pairs(left, right)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [(0, 7), (1, 8)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsed_calls_are_not_broadcast_to_the_targets(spark, tmp_path):
    from wane.operators.matching import leaf_lookup, target_dim

    rows = [(i, leaf, "np", "x" * 100) for i in range(200) for leaf in ("alltrue", "zeros", "<syntax_error>")]
    spark.createDataFrame(rows, "id int, callee string, receiver string, bindings string").write.parquet(f"{tmp_path}/calls")
    known = leaf_lookup(spark.read.parquet(f"{tmp_path}/calls"), target_dim(spark), "target_api", only=["<syntax_error>"])
    assert "Inner, BuildRight" in _plan(known) and "Inner, BuildLeft" not in _plan(known)
    got = {(r["callee"], r["leaf_match"]): r["n"] for r in known.groupBy("callee", "leaf_match").agg({"*": "count"}).toDF("callee", "leaf_match", "n").collect()}
    assert got == {("alltrue", "numpy.alltrue"): 200, ("<syntax_error>", None): 200}


def test_rows_are_not_sorted_by_their_symbols(spark, tmp_path):
    from pyspark.sql import functions as F

    from wane.operators import resolution as res
    from wane.operators.evidence import add_evidence
    from wane.operators.matching import target_dim

    codes = ["import numpy as np\nnp.alltrue(x)\n", "pdf.iteritems()\n", "def broken(:\n"]
    snippets = spark.createDataFrame([(str(i), "numpy", codes[i % 3]) for i in range(60)], "sample_id string, library string, function string")
    st = res.call_statuses(snippets, target_dim(spark), F.lit(None).cast("string"), "target_api", ["ord"])
    assert "ShuffledHashJoin [symbols" in _plan(st)
    assert sorted(r["count"] for r in st.groupBy("status", "reason").count().collect()) == [20, 20, 20]
    names = spark.createDataFrame([("numpy.alltrue",), ("a.b",), (None,)] * 20, "symbol string")
    rows = add_evidence(names, None, "symbol")
    assert "ShuffledHashJoin [coalesce(symbol" in _plan(rows)
    assert {(r["symbol"], r["count"]) for r in rows.groupBy("symbol", "recommended_replacement").count().collect()} == {("numpy.alltrue", 20), ("a.b", 20), (None, 20)}


def test_counted_evidence_sorts_no_rows(spark):
    plan = _plan(entry.queries()["evidence_fill"](spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in plan.split("ShuffledHashJoin")[0] and "ShuffledHashJoin" in plan
