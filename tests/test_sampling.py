import pytest
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.keys import draw
from wane.operators import annotation as ann, ranking as rank, sampling as smp


def test_proportional_sample_is_exact_and_stable(spark):
    rows = spark.createDataFrame([(f"{l}{c}{s}{i}", l, c, s) for l in "abc" for c in "xy" for s in "pq" for i in range(20)],
                                 "id string, lib string, cohort string, status string")
    got = smp.proportional_sample(rows, ["lib", "cohort", "status"], 30, ["id"])
    ids = sorted(r.id for r in got.collect())
    assert len(set(ids)) == 30 and {i[0] for i in ids} == set("abc") and {i[2] for i in ids} == set("pq")
    again = smp.proportional_sample(rows.repartition(7), ["lib", "cohort", "status"], 30, ["id"])
    assert ids == sorted(r.id for r in again.collect())


def test_proportional_sample_scans_its_rows_once(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "source")
    got = smp.proportional_sample(rows, ["lang", "source"], 20, ["doc_id"])
    assert len(got.collect()) == 20
    # the scan ended in the small table
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    kept = smp.bottom_rows(rows.withColumn("d", F.sha2(F.col("doc_id").cast("string"), 256)), ["lang", "source"], ["d"], 3)
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert kept.agg(F.sum("_n")).first()[0] == rows.count()
    with_nulls = spark.createDataFrame([(i, None if i % 2 else "a", None) for i in range(40)], "id int, lib string, cohort string")
    kept = smp.proportional_sample(with_nulls, ["lib", "cohort"], 10, ["id"]).collect()
    assert len(kept) == 10 and sum(r.lib is None for r in kept) == 5
    assert smp.proportional_sample(with_nulls.limit(0), ["lib", "cohort"], 10, ["id"]).count() == 0


def test_quota_errors_when_a_key_is_short(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(3)], "id int, k string")
    quotas = spark.createDataFrame([("a", 2), ("b", 0)], "k string, quota int")
    assert smp.quota_sample(rows, "k", quotas, ["id"]).count() == 2
    with pytest.raises(Exception, match="too few rows for the quota of a"):
        smp.quota_sample(rows, "k", spark.createDataFrame([("a", 4)], "k string, quota int"), ["id"]).collect()


def test_positions_and_numbers(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).alias("g"))
    p = rank.positions(df, ["g"], [F.col("id")], rank.id_bucket(F.col("id"), 4))
    assert [r.position for r in p.where("g").orderBy("id").collect()] == list(range(1, 335))
    names = [r.benchmark_id for r in rank.numbered(df, draw(42, F.col("id"))).collect()]
    assert len(set(names)) == 1000 and min(names) == "bench_001"


def test_benchmark_is_assembled(spark):
    manifest = [(f"{t}_{i}", f"numpy_{9000 + i}", i, t.split(".")[0], "outdated", t) for t, q in fixed.QUOTAS.items() for i in range(q + 1)]
    m = spark.createDataFrame(manifest, "candidate_id string, sample_id string, sample_idx int, library string, cohort string, target_api string")
    m = m.select("*", F.lit(1).alias("client_line"), F.lit(0).alias("column"), F.lit("x").alias("call_site_snippet"), F.lit("x").alias("enclosing_code"))
    code = {
        "scipy": ["import scipy.special as sps\nsps.comb(1)\n", "simpson(y)\n", "linalg.pinv(a)\n", "misc.ascent()\n"],
        "pandas": ["df.map(f)\nx.map(g)\n", "psdf.items()\n"], "numpy": ["itertools.product(a)\n"]}
    rows = [(f"{lib}_{i * 10 + k}", lib, i * 10 + k, "up-to-dated", c) for lib, cs in code.items() for k, c in enumerate(cs) for i in range(100, 110)]
    rows += [(f"scipy_{i}", "scipy", i, "outdated", "errprint()\n") for i in range(267, 277)]
    rows += [(f"scipy_{i}", "scipy", i, "outdated", "stats.rvs_ratio_uniforms(f)\n") for i in range(458, 462)]
    rows += [(f"scipy_{i}", "scipy", i, "outdated", "x") for i in (1500, 1560)]
    s = spark.createDataFrame(rows, "sample_id string, library string, sample_idx int, category string, function string")
    b = smp.assemble_benchmark(m, s)
    assert all(r.ok for r in smp.benchmark_checks(b).collect())
    strata = {r.stratum: r["count"] for r in b.groupBy("stratum").count().collect()}
    assert strata == {"candidate_positive": 100, "pipeline_miss": 8, "label_anomaly": 2, "hard_negative": 40}


def test_events_that_an_item_does_not_allow_stay_in_its_trace(spark):
    items = spark.createDataFrame([("b1", "pre_labeled", True), ("b2", "unannotated", None), ("b3", None, None)],
                                  "benchmark_id string, annotation_status string, is_deprecated_call boolean")
    log = [("b1", 1, "accept", None), ("b1", 2, "accept", None), ("b2", 1, "accept", None), ("b2", 2, "reset", None), ("b2", 3, "decide", True),
           ("b2", 4, "decide", False), ("b2", 5, "adjudicate", False), ("b2", 6, "reset", None), ("b2", 7, "revise", True), ("b2", 8, "dance", None),
           ("b9", 1, "decide", True), (None, 3, "freeze", None), (None, 9, "freeze", None)]
    events = spark.createDataFrame(log, "benchmark_id string, step int, action string, decision boolean")
    r = ann.replay(items, events)
    got = {x.benchmark_id: (x.is_deprecated_call, x.annotation_status, x.annotator) for x in r.collect()}
    assert got == {"b1": (True, "pre_labeled", "HUMAN_AUDITED_PRE_ESTABLISHED"), "b2": (True, "revised", "HUMAN_USER_REVISED"), "b3": (None, "unannotated", None)}
    bad = {(x.benchmark_id, x.step): x.reason for x in ann.illegal_steps(r).collect()}
    assert bad == {("b1", 2): "already decided", ("b2", 1): "not documented", ("b2", 2): "not decided", ("b2", 4): "already decided", ("b2", 8): "unknown action"}
    assert [x.benchmark_id for x in ann.unknown_events(items, events).collect()] == ["b9"]
    assert {(x.step, x.open, x.frozen) for x in ann.freezes(r, events).collect()} == {(3, 1, False), (9, 1, False)}


def test_annotation_states(spark):
    items = spark.createDataFrame([("b1", "pre_labeled", True), ("b2", "unannotated", None), ("b3", "unannotated", None)],
                                  "benchmark_id string, annotation_status string, is_deprecated_call boolean")
    a = ann.accept_prelabeled(items, items.limit(0))
    decide = lambda rows: spark.createDataFrame(rows, "benchmark_id string, decision boolean, step int")
    a = ann.record(items, a, decide([("b2", True, 1), ("b2", False, 2)]))
    assert [r.benchmark_id for r in ann.pending(items, a).collect()] == ["b3"]
    with pytest.raises(Exception, match="items without a decision: 1"):
        ann.freeze(items, a).collect()
    a = ann.record(items, a, decide([("b3", True, 1)]), "revised", "HUMAN_USER_REVISED")
    frozen = [(r.benchmark_id, r.is_deprecated_call) for r in ann.freeze(items, a).collect()]
    assert frozen == [("b1", True), ("b2", False), ("b3", True)]
    assert ann.reset(a, spark.createDataFrame([("b2",)], "benchmark_id string")).count() == 2
    none = ann.second_pass_agreement(spark.createDataFrame([], "primary_decision boolean, second_pass_decision boolean")).first()
    assert (none.concordance, none.kappa, none.pabak) == (1.0, 1.0, 1.0)
