import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wane.operators import agreement as agr, significance as sig

CELLS = "both_true bigint, first_only bigint, second_only bigint, both_false bigint, n_missing bigint"


def kappa(spark, a, b, c, d, edge="one"):
    return agr.with_agreement(spark.createDataFrame([(a, b, c, d, 0)], CELLS), edge).first()


def test_kappa_and_friends(spark):
    assert kappa(spark, 50, 0, 0, 50).kappa == 1.0 and kappa(spark, 0, 50, 50, 0).kappa == -1.0
    assert 0.8 < kappa(spark, 80, 3, 2, 15).kappa < 1
    r = kappa(spark, 139, 1, 6, 4)
    assert [round(x, 4) for x in (r.concordance, r.kappa, r.pabak, r.balanced_accuracy)] == [0.9533, 0.5116, 0.9067, 0.8793]
    assert [kappa(spark, 9, 0, 0, 0, e).kappa for e in ("one", "agree", "zero")] == [1.0, 1.0, 0.0]
    assert kappa(spark, 0, 0, 0, 0).kappa == 0.0


def test_binary_metrics(spark):
    rows = [(True, True)] * 88 + [(True, False)] * 19 + [(False, False)] * 43 + [(None, True)] * 3
    m = agr.binary_metrics(spark.createDataFrame(rows, "t boolean, p boolean"), "t", "p").first()
    assert (m.tp, m.fp, m.fn, m.tn) == (88, 0, 19, 43)
    assert (m.precision, round(m.recall, 4), round(m.f1, 4), m.specificity) == (1.0, 0.8224, 0.9026, 1.0)
    none = agr.binary_metrics(spark.createDataFrame([], "t boolean, p boolean"), "t", "p").first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def exact_p(b, c):
    n, m = b + c, min(b, c)
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2 ** n)


def test_mcnemar_matches_exact_sums(spark):
    pairs = [(23, 19), (0, 0), (0, 5), (7, 0), (1, 1), (24, 0), (300, 250), (2000, 2100), (5, 900)]
    rows = spark.createDataFrame(pairs, "b bigint, c bigint").select("b", "c", sig.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(exact_p(r.b, r.c), rel=1e-9, abs=1e-300)
    assert round(rows[0].p, 4) == 0.6440
    huge = spark.createDataFrame([(10**10, 10**10 + 200000)], "b bigint, c bigint").select(sig.mcnemar_p(F.col("b"), F.col("c")).alias("p")).first().p
    assert huge == pytest.approx(math.erfc(199999 / math.sqrt(2 * 10**10) / math.sqrt(2)), rel=1e-3)


def test_edge_and_general_intervals(spark):
    rows = spark.createDataFrame([(88, 88), (0, 44), (44, 44), (0, 0), (88, 106), (1, 3)], "k int, n int")
    got = [(r.i.low, r.i.high) for r in rows.select(sig.clopper_pearson(F.col("k"), F.col("n")).alias("i")).collect()]
    assert got[0] == (pytest.approx(0.95895, abs=1e-5), 1.0) and got[1][0] == 0.0 and got[3] == (0.0, 1.0)
    # P(X >= k) at the lower bound and P(X <= k) at the upper bound are 2.5 %
    for (k, n), (low, high) in (((88, 106), got[4]), ((1, 3), got[5])):
        tail = lambda p, ks: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in ks)
        assert tail(low, range(k, n + 1)) == pytest.approx(0.025, rel=1e-6) and tail(high, range(k + 1)) == pytest.approx(0.025, rel=1e-6)


def test_power(spark):
    c = spark.createDataFrame([(23, 19), (5, 5), (4, 0)], "b bigint, c bigint")
    r = sig.mcnemar_power(c, 150).collect()
    assert (round(r[0].post_hoc_power, 4), r[0].required_discordant, r[0].required_total) == (0.0935, 863, 3083)
    assert r[1].required_discordant is None and r[2].post_hoc_power is None


def test_bootstrap_agrees_with_resampling(spark):
    tp, fp, fn, tn = 88, 0, 19, 43
    c = agr.with_metrics(spark.createDataFrame([(tp, fp, fn, tn)], "tp bigint, fp bigint, fn bigint, tn bigint"))
    r = sig.with_intervals(c).first()
    assert r.f1_low == pytest.approx(0.8556, abs=0.006) and r.f1_high == pytest.approx(0.9430, abs=0.006)
    assert r.precision_method == "clopper_pearson" and r.precision_low == pytest.approx(0.95895, abs=1e-5)
    again = sig.with_intervals(c.repartition(3)).first()
    assert again.f1_low == r.f1_low and again.f1_high == r.f1_high
    y = np.array([1] * (tp + fn) + [0] * (fp + tn), bool)
    p = np.array([1] * tp + [0] * fn + [1] * fp + [0] * tn, bool)
    rng, f1s = np.random.RandomState(1), []
    for _ in range(4000):
        i = rng.randint(0, len(y), len(y))
        a, b = y[i], p[i]
        f1s.append(2 * (a & b).sum() / (a.sum() + b.sum()))
    assert r.f1_low == pytest.approx(np.percentile(f1s, 2.5), abs=0.006) and r.f1_high == pytest.approx(np.percentile(f1s, 97.5), abs=0.006)


def test_paired_bootstrap(spark):
    rng = random.Random(5)
    rows = [(rng.random() < 0.7, rng.random() < 0.6, rng.random() < 0.6) for _ in range(150)]
    c = sig.paired_counts(spark.createDataFrame(rows, "t boolean, a boolean, b boolean"), "t", "a", "b")
    r = sig.paired_bootstrap(c).first()
    f1 = lambda i: 2 * sum(x[0] and x[i] for x in rows) / (sum(x[0] for x in rows) + sum(x[i] for x in rows))
    assert r.point_estimate == pytest.approx(f1(1) - f1(2)) and r.ci_low < r.point_estimate < r.ci_high
    swapped = sig.paired_bootstrap(sig.paired_counts(spark.createDataFrame(rows, "t boolean, a boolean, b boolean"), "t", "b", "a")).first()
    assert swapped.point_estimate == pytest.approx(-r.point_estimate) and abs(swapped.p_two_sided - r.p_two_sided) < 0.05


def test_predictive_values_and_what_if(spark):
    m = agr.with_metrics(spark.createDataFrame([("a", 106, 24, 0, 20), ("c", 90, 12, 16, 32)], "name string, tp bigint, fp bigint, fn bigint, tn bigint"))
    t = {(r.name, r.rate): round(r.ppv * 100, 2) for r in sig.ppv_table(m, ["name"]).collect()}
    assert t["a", 0.01] == 1.82 and t["c", 0.01] == 3.05 and len(t) == 10
    w = sig.recovered(agr.with_metrics(spark.createDataFrame([(88, 0, 18, 44)], "tp bigint, fp bigint, fn bigint, tn bigint")), F.lit(5)).first()
    assert (w.tp_if, w.fn_if) == (93, 13) and round(w.recall_if, 4) == 0.8774


def test_one_sided(spark):
    assert spark.range(1).select(sig.one_sided_p(F.lit(24)).alias("p")).first().p == 2 * 0.5**24
