import re
import tempfile

from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.operators import audit, verification as ver
from wane.operators.evidence import add_evidence
from wane.schemas import MANIFEST


def requests(spark, rows):
    base = dict.fromkeys([c.split()[0] for c in MANIFEST.split(", ")])
    data = []
    for i, r in enumerate(rows):
        v = {**base, "candidate_id": f"c{i}", "sample_id": f"s{i}", "sample_idx": i, "library": "pandas", "cohort": "outdated",
             "stage2_status": "low_confidence", "mode": "inference", "target_api": "pandas.DataFrame.pad", "client_line": 1,
             "column": 0, "call_site_snippet": "pdf.pad()", "enclosing_code": "code", **r}
        data.append(tuple(v[k] for k in base))
    return spark.createDataFrame(data, MANIFEST)


def test_keys_differ_by_model_version_and_context(spark):
    r = requests(spark, [{}])
    key = lambda **kw: ver.add_key(r, **kw).first().cache_key
    keys = {key(model="a"), key(model="b"), key(model="a", version="v2.0"), key(model="a", with_context=False)}
    assert len(keys) == 4 and all(len(k) == 64 for k in keys)
    import hashlib
    assert key(model="a", with_context=False) == hashlib.sha256(b"a:v1.1:pdf.pad():pandas.DataFrame.pad:||").hexdigest()


def test_hits_misses_and_repeat(spark):
    r = requests(spark, [{}, {}, {"call_site_snippet": "psdf.pad()"}])
    p, cache = ver.verify(r, ver.empty_cache(spark))
    rows = p.orderBy("candidate_id").collect()
    assert [x.cached for x in rows] == [False, True, False]
    assert [x.is_deprecated_usage for x in rows] == [True, True, False]
    t = ver.telemetry(p).first()
    assert (t.api_calls, t.cache_hits, t.cache_hit_rate_pct) == (2, 1, 33.33)
    again, _ = ver.verify(r, cache)
    assert ver.telemetry(again).first().api_calls == 0
    other, _ = ver.verify(r, cache, model="second")
    assert ver.telemetry(other).first().api_calls == 2


def test_a_paid_verifier_is_asked_once_per_key(spark):
    calls = spark.sparkContext.accumulator(0)

    def send(prompt):
        calls.add(1)
        return '{"is_deprecated_usage": true, "confidence": 0.8, "rationale": "r"}', 10, 3

    with tempfile.TemporaryDirectory() as d:
        r = requests(spark, [{}, {}, {"target_api": "x.y"}])
        p, cache = ver.verify(r, ver.empty_cache(spark), ver.remote_verifier(send, parallel=2, interval=0), store=f"{d}/run")
        assert p.count() == 3 and p.count() == 3 and cache.count() == 2
        assert calls.value == 2


def test_decisions_are_checked(spark):
    texts = ['{"is_deprecated_usage": true, "confidence": 0.5, "rationale": "x"}', '{"is_deprecated_usage": true, "confidence": 1.5, "rationale": "x"}',
             '{"is_deprecated_usage": true, "confidence": 0.5}', "no json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = [r.v for r in df.select("i", ver.decode(F.col("t")).alias("v")).orderBy("i").collect()]
    assert [r.is_deprecated_usage for r in rows] == [True, False, False, False, False]
    assert [r.confidence for r in rows] == [0.5, 0.0, 0.0, 0.0, 0.0] and rows[3].rationale.endswith("no json")


def test_prompts_depend_on_mode_and_version(spark):
    r = requests(spark, [{}, {"mode": "confirmation", "recommended_replacement": "ffill"}])
    v1, v2 = [[x.p for x in r.select(ver.prompt(v).alias("p")).collect()] for v in (fixed.PROMPT_VERSION, fixed.PROMPT_VERSION_RECEIVER)]
    assert len({*v1, *v2}) == 4 and "ffill" in v1[1] and "listed in the catalog" in v1[0]


def test_evidence_priorities(spark):
    cat = spark.createDataFrame([
        ("numpy.core.x.product", "warning", "m1", "raw", "/a/benchmark_libs/numpy-1/x.py:3", 1),
        ("lib.f", "docstring", None, "It is Deprecated", "l.py:1", 2), ("lib.f", "warning", None, "warned", "l.py:2", 3), ("m", "comment", None, "c", "z.py:1", 4)],
        "qualified_name string, origin string, message string, raw_evidence string, location string, ord int")
    rows = {r.target_api: r for r in add_evidence(spark.createDataFrame([(s,) for s in ("numpy.product", "lib.f", "numpy.core.q.alltrue", "a.B.m", "scipy.special.comb", None)], "target_api string"), cat).collect()}
    assert rows["numpy.product"].warning.startswith("`product` is deprecated") and rows["numpy.product"].recommended_replacement == "numpy.prod"
    assert (rows["lib.f"].warning, rows["lib.f"].docstring, rows["lib.f"].source_location) == ("warned", "It is Deprecated", "l.py:1")
    assert rows["numpy.core.q.alltrue"].recommended_replacement == "numpy.all" and rows["numpy.core.q.alltrue"].warning is None
    assert rows["a.B.m"].source_location == "z.py:1" and rows["scipy.special.comb"].recommended_replacement is None
    assert len(rows) == 6


def test_receiver_audit(spark):
    items = spark.createDataFrame([
        ("b1", "modin_df.last('3D')", "pandas.DataFrame.last", "", 1), ("b2", "from numpy import product\nproduct(x)", "numpy.product", "", 2),
        ("b3", "x = 1", "numpy.product", "itertools.product(x)", 1), ("b4", "x = 1", "numpy.product", "y", 1), ("b5", "obj.last(1)", "pandas.DataFrame.last", "", 1)],
        "benchmark_id string, enclosing_code string, target_api string, call_site_snippet string, client_line int")
    hand = spark.createDataFrame([("b5", "pdf", "native_pandas", True)], "benchmark_id string, receiver_expr string, receiver_category string, invokes_target_api boolean")
    got = {r.benchmark_id: (r.receiver_expr, r.receiver_category, r.invokes_target_api) for r in audit.audit_receivers(items, hand).collect()}
    assert got == {"b1": ("modin_df", "wrapper_modin", True), "b2": ("<direct_call>", "module_import", True),
                   "b3": ("itertools", "standard_library", False), "b4": ("<native_call>", "native_library", True), "b5": ("pdf", "native_pandas", True)}


def test_second_label_set(spark):
    items = spark.createDataFrame([("bench_108", True), ("bench_001", True)], "benchmark_id string, is_deprecated_call boolean")
    got = {r.benchmark_id: (r.is_deprecated_call, r.v1_label, r.label_changed) for r in audit.second_labels(items).collect()}
    assert got == {"bench_108": (False, True, True), "bench_001": (True, True, False)}


def test_fresh_wrappers_never_share_a_key(spark):
    r = requests(spark, [{"call_site_snippet": s} for s in ("psdf.pad()", "pdf.pad()", "styler.render()", "x.pad()")])
    rows = audit.wrapper_evaluation(r).orderBy("candidate_id").collect()
    assert [x.receiver_type for x in rows] == ["native_pandas" if t else "wrapper_lookalike" for t in (False, True, True, False)]
    assert all(x.cache_key_v1 != x.cache_key_v2 for x in rows)


def test_requests_without_an_answer_stay(spark):
    silent = lambda misses: ver.rule_verifier(misses).limit(0)
    silent.repeatable = True
    rows = ver.verify(requests(spark, [{}] * 3), ver.empty_cache(spark), silent)[0].collect()
    assert len(rows) == 3 and not any(r.cached or r.is_deprecated_usage for r in rows)
    assert {r.rationale for r in rows} == {fixed.NO_ANSWER}


def test_only_repeatable_verifiers_go_without_a_store(spark):
    import pytest

    with pytest.raises(ValueError):
        ver.verify(requests(spark, [{}]), ver.empty_cache(spark), lambda misses: ver.rule_verifier(misses))


def test_a_request_that_fails_leaves_the_others_their_answers(spark):
    def send(prompt):
        if "x.y" in prompt:
            raise OSError("refused")
        return '{"is_deprecated_usage": true, "confidence": 0.8, "rationale": "r"}', 1, 1

    with tempfile.TemporaryDirectory() as d:
        r = requests(spark, [{}, {"target_api": "x.y"}])
        p, cache = ver.verify(r, ver.empty_cache(spark), ver.remote_verifier(send, parallel=1, interval=0, attempts=1), store=f"{d}/run")
        assert {x.candidate_id: x.rationale for x in p.collect()} == {"c0": "r", "c1": fixed.NO_ANSWER} and cache.count() == 1


def test_store_reads_only_the_partitions_of_its_keys(spark):
    from wane.sinks.store import ResponseStore

    with tempfile.TemporaryDirectory() as d:
        log = ResponseStore(spark, f"file://{d}/log")
        assert log.rows().count() == 0 and log.compact() is None
        ver.verify_with_store(requests(spark, [{"target_api": f"lib.f{i}"} for i in range(60)]), log)
        ver.verify_with_store(requests(spark, [{"target_api": f"lib.g{i}"} for i in range(20)]), log)
        some = ver.add_key(requests(spark, [{"target_api": "lib.f7"}, {"target_api": "lib.g3"}, {"target_api": "unknown"}]), "primary")
        found = log.lookup(some)
        plan = found._jdf.queryExecution().executedPlan().toString()
        buckets = {r.cache_key[:2] for r in some.collect()}
        filters = re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]
        assert "bucket" in filters and all(b in filters for b in buckets) and found.count() == 2
        assert log.live() == ["run-000000000", "run-000000001"]
        before = sorted(r.cache_key for r in log.rows().collect())
        assert log.compact() == "upto-000000001" and log.live() == ["upto-000000001"]
        assert sorted(r.cache_key for r in log.rows().collect()) == before and log.next_run() == 2
        assert log.retire() == ["run-000000000", "run-000000001"] and log.lookup(some).count() == 2


def test_a_repeated_run_replaces_its_part(spark):
    from wane.sinks.store import ResponseStore

    with tempfile.TemporaryDirectory() as d:
        log = ResponseStore(spark, f"file://{d}/log", digits=1)
        r = requests(spark, [{"target_api": f"lib.f{i}"} for i in range(5)])
        for _ in range(2):
            assert ver.telemetry(ver.verify_with_store(r, log, run=0)).first().api_calls == 5
        assert ver.telemetry(ver.verify_with_store(r, log, run=1)).first().api_calls == 0 and log.rows().count() == 5


def test_any_failure_is_retried(spark):
    seen = spark.sparkContext.accumulator(0)
    state = {"n": 0}

    def send(prompt):
        seen.add(1)
        state["n"] += 1
        if state["n"] == 1:
            raise OSError("reset by peer")
        return '{"is_deprecated_usage": true, "confidence": 0.8, "rationale": "r"}', 1, 1

    with tempfile.TemporaryDirectory() as d:
        p, _ = ver.verify(requests(spark, [{}]), ver.empty_cache(spark), ver.remote_verifier(send, parallel=1, interval=0), store=f"{d}/run")
        assert p.first().is_deprecated_usage and seen.value == 2


def test_low_confidence_rules_in_order(spark):
    ndarray = "isinstance(values, np.ndarray)"
    rows = [("log_denominator = logsumexp(values)", ndarray, "scipy.misc.logsumexp", "scipy_555"),
            ("log_denominator = logsumexp(values)", ndarray, "scipy.misc.logsumexp", "scipy_1"),
            ("x = it.product(a)", "torch.", "scipy.misc.logsumexp", "scipy_555"), ("f(FakeTensor)", "", "numpy.product", "s"), ("a.b()", "", "numpy.product", "s")]
    out = spark.createDataFrame(rows, "a string, b string, c string, d string").select(
        audit.low_confidence_rule(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("k"))
    assert [r.k for r in out.collect()] == ["torch_tensor", "native_scipy", "standard_library", "custom_class", "native_library"]
