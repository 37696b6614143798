import random

from pyspark.sql import functions as F

from wane.functions.names import compatible
from wane.operators.reconcile import reconcile

LEFT = "client_file string, line int, target_symbol string, origins array<string>, raw_evidence string, message string, param_name string, scope string, ord bigint"
RIGHT = "file string, line int, qualified_name string, origin string, origins array<string>, raw_evidence string, message string, param_name string, scope string, ord bigint"


def run(spark, left, right):
    l = spark.createDataFrame([(f, n, s, ["warning"], ev, m, None, "function", i) for i, (f, n, s, ev, m) in enumerate(left)], LEFT)
    r = spark.createDataFrame([(f, n, s, "pep702:mypy", ["pep702", "pep702:mypy"], ev, m, None, "function", i) for i, (f, n, s, ev, m) in enumerate(right)], RIGHT)
    return reconcile(l, r).orderBy("side", "ord").collect()


def test_three_cases(spark):
    rows = run(spark, [("a.py", 1, "pandas.DataFrame.applymap", "call", None), ("a.py", 9, "numpy.product", "call", "m")],
               [("a.py", 1, "applymap", "bare", None), ("./a.py", 1, "DataFrame.applymap", "diag", "use map"), ("b.py", 9, "numpy.product", "", None)])
    assert [r.case for r in rows] == ["both", "catalog_only", "checker_only", "checker_only"]
    assert rows[0].origins == ["pep702", "pep702:mypy", "warning"] and rows[0].message == "use map"
    assert rows[0].raw_evidence == "call | diag" and not rows[0].is_typechecker_recovery
    assert rows[2].is_typechecker_recovery and rows[2].target_symbol == "applymap" and rows[1].message == "m"


def test_classes_on_one_line_stay_apart(spark):
    rows = run(spark, [("a.py", 1, "pandas.DataFrame.iteritems", "x", None)], [("a.py", 1, "pandas.Series.iteritems", "y", None)])
    assert [r.case for r in rows] == ["catalog_only", "checker_only"]


def greedy(left, right, fits):
    taken, pairs = set(), {}
    for i, l in enumerate(left):
        for j, r in enumerate(right):
            if j not in taken and l[:2] == r[:2] and fits[l[2], r[2]]:
                taken.add(j)
                pairs[i] = j
                break
    return pairs


def test_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    names = ["pandas.DataFrame.pad", "pandas.Series.pad", "pandas.core.generic.NDFrame.pad", "DataFrame.pad", "numpy.pad", "numpy.lib.pad", "pad"]
    make = lambda n: [(f"f{rng.randint(0, 2)}", rng.randint(1, 3), rng.choice(names), "", None) for _ in range(n)]
    left, right = make(150), make(140)
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    fits = {(r.a, r.b): r.c for r in pairs.select("a", "b", compatible(F.col("a"), F.col("b")).alias("c")).collect()}
    tag = lambda rows, t: [(f, n, s, f"{t}{i}", None) for i, (f, n, s, _, _) in enumerate(rows)]
    got = {}
    out = run(spark, tag(left, "L"), tag(right, "R"))
    for r in out:
        if r.case == "both":
            a, b = r.raw_evidence.split(" | ")
            got[int(a[1:])] = int(b[1:])
    assert got == greedy(left, right, fits)
    assert len(out) == len(left) + len(right) - len(got)


def test_one_huge_line_is_not_handed_to_python(spark):
    n = 3000
    rows = run(spark, [("a.py", 1, "numpy.product", "x", None)] * n, [("a.py", 1, "numpy.core.fromnumeric.product", "x", None)] * (n - 10))
    assert sum(r.case == "both" for r in rows) == n - 10 and len(rows) == n
