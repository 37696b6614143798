import itertools
import random

from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.names import build_keys, compatible, probe_keys
from wane.operators.matching import first_match, leaf_lookup, match_target, pairs


def compat_rows(spark, names):
    df = spark.createDataFrame(list(names), "a string, b string")
    return {(r.a, r.b): r.c for r in df.select("a", "b", compatible(F.col("a"), F.col("b")).alias("c")).collect()}


def test_distinct_targets_are_incompatible(spark):
    got = compat_rows(spark, itertools.permutations(fixed.TARGET_LIST, 2))
    assert len(got) == 930 and not any(got.values())


def test_targets_and_replacements_are_incompatible(spark):
    both = [p for t, r in fixed.REPLACEMENTS.items() for p in ((t, r), (r, t))]
    assert not any(compat_rows(spark, both).values())


def test_partial_and_bare_names(spark):
    got = compat_rows(spark, [
        ("pandas.DataFrame.iteritems", "DataFrame.iteritems"), ("pandas.DataFrame.iteritems", "Series.iteritems"),
        ("pandas.DataFrame.iteritems", "iteritems"), ("numpy.alltrue", "alltrue"),
        ("pandas.DataFrame.pad", "pandas.core.generic.NDFrame.pad"),
        ("pandas.DataFrame.pad", "pandas.core.series.Series.pad"),
        ("scipy.integrate.cumtrapz", "scipy.integrate._quadrature.cumtrapz"),
        ("scipy.misc.comb", "scipy.special.comb"), ("", "a"), ("a..b", "a.b")])
    assert list(got.values())[:8] == [True, False, False, True, True, False, True, False]


def test_target_matching(spark):
    accept = {
        "numpy.alltrue": "numpy.alltrue", "numpy.core.fromnumeric.product": "numpy.product",
        "numpy.core.fromnumeric.cumproduct": "numpy.cumproduct", "scipy.misc.comb": "scipy.misc.comb",
        " scipy.linalg.pinv2 ": "scipy.linalg.pinv2",
        "pandas.core.frame.DataFrame.iteritems": "pandas.DataFrame.iteritems",
        "pandas.io.formats.style.Styler.render": "pandas.io.formats.style.Styler.render"}
    reject = [
        "scipy.special.comb", "scipy.special._basic.comb", "scipy.special._basic.comb::legacy", "scipy.integrate.simpson",
        "pandas.core.frame.DataFrame.map", "numpy.lib.shape_base.expand_dims", "scipy.linalg._basic.pinv",
        "numpy.core.records.fromstring.shape", "scipy.stats._continuous_distns.frechet_r_gen.sf"]
    df = spark.createDataFrame([(s,) for s in [*accept, *reject]] + [(None,)], "s string")
    got = {r.s: r.target_api for r in match_target(df, "s").collect()}
    assert {k: got[k] for k in accept} == accept
    assert all(got[s] is None for s in reject) and got[None] is None


def random_names(n):
    rng = random.Random(7)
    seg = ["pandas", "numpy", "core", "frame", "DataFrame", "Series", "NDFrame", "Index", "x", "pad", "all"]
    return sorted({".".join(rng.choice(seg) for _ in range(rng.randint(1, 5))) for _ in range(n)})


def test_keys_meet_exactly_when_compatible(spark):
    names = random_names(420)
    a = spark.createDataFrame([(n,) for n in names], "a string")
    b = a.withColumnRenamed("a", "b")
    for bare in (False, True):
        meet = F.arrays_overlap(build_keys(F.col("a"), bare), probe_keys(F.col("b"), bare))
        rule = compatible(F.col("a"), F.col("b"))
        if bare:
            rule = rule | F.endswith("a", F.concat(F.lit("."), "b")) | F.endswith("b", F.concat(F.lit("."), "a"))
        wrong = a.crossJoin(b).where(meet != rule)
        assert wrong.take(5) == []
    symmetric = a.crossJoin(b).where(compatible(F.col("a"), F.col("b")) != compatible(F.col("b"), F.col("a")))
    assert symmetric.take(1) == []


def test_first_match_equals_scan(spark):
    names = random_names(300)
    catalog = [(n, i) for i, n in enumerate(names[::3])]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, s string")
    cat = spark.createDataFrame(catalog, "name string, ord int")
    scan = pairs(rows, cat, "s", "name").groupBy("id").agg(
        F.min_by("name", F.struct((F.col("name") != F.col("s")), "ord")).alias("m"))
    expect = {r.id: r.m for r in scan.collect()}
    got = {r.id: r.matched for r in first_match(rows, "s", cat, "name", ["ord"]).collect()}
    assert len(got) == len(names) and {k: v for k, v in got.items() if v} == expect
    plan = first_match(rows, "s", cat, "name", ["ord"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_leaf_lookup_prefers_receiver(spark):
    cat = spark.createDataFrame([("pandas.Series.pad",), ("pandas.DataFrame.pad",), ("numpy.pad",)], "n string")
    calls = spark.createDataFrame([("pad", "df1"), ("pad", "my_series"), ("pad", None), ("zip", "df")], "callee string, receiver string")
    got = [r.leaf_match for r in leaf_lookup(calls, cat, "n").orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(map(str, got)) == ["None", "numpy.pad", "pandas.DataFrame.pad", "pandas.Series.pad"]
