"""Hard negatives against scores computed pair by pair."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wane.llm import hardneg


def brute_force(rows, positives=5, negatives=5):
    ok = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = Counter()
    for a, (i, v, label) in enumerate(ok):
        if i is None or i % 100:
            continue
        others = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, lab, b) for b, (j, w, lab) in enumerate(ok) if b != a]
        others.sort()
        for p in [o for o in others if o[3] == label][:positives]:
            near = [o for o in others if o[3] != label and 80 * -p[0] <= 100 * -o[0] <= 100 * -p[0]][:negatives]
            for rank, o in enumerate(near, 1):
                out[(i, None if p[1] else p[2], rank, None if o[1] else o[2], -p[0], -o[0])] += 1
    return out


def random_rows(seed, n, width, labels=3):
    r = random.Random(seed)
    base = [[r.gauss(0, 0.3) for _ in range(width)] for _ in range(6)]
    rows = []
    for k in range(n):
        v = [x + r.gauss(0, 0.1) for x in r.choice(base)] if k % 4 else base[0]
        rows.append((k * 5, v, r.randrange(labels)))
    return rows


@pytest.mark.parametrize("width", [3, 8, 20])
def test_equal_to_brute_force(spark, width):
    rows = random_rows(width, 240, width)
    nan = float("nan")
    rows += [
        (100, rows[0][1], 0), (100, rows[0][1], 0), (None, rows[1][1], 1), (None, None, 1), (7, None, 2), (1100, [nan] * width, 1),
        (1200, [float("inf")] * width, 1), (1300, [None] * width, 1), (1400, rows[4][1], None), (1500, [0.0] * width, 1), (1600, [], 2),
        (1700, [0.5], 1), (1800, [-0.25] * width, 0)]
    df = spark.createDataFrame([(*x, 1, 2, "c") for x in rows], "vec_id long, embedding array<float>, label int, row int, id int, planes string")
    got = Counter(map(tuple, hardneg.mine(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == brute_force(rows) and got


def test_far_larger_components_stay_exact(spark):
    r = random.Random(9)
    rows = [(k * 20, [float(np.float32(r.uniform(-9000, 9000))) for _ in range(9)], k % 2) for k in range(60)] + [(3, [1e30] + [0.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(map(tuple, hardneg.mine(df, F.col("vec_id") % 100 == 0).collect())) == brute_force(rows[:-1])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hardneg.mine(alone, F.col("vec_id") % 100 == 0).collect() == []


def test_tables_and_planes():
    r = np.random.default_rng(3)
    a, b = r.integers(-500, 500, (5, 16)), r.integers(-129, 128, (40, 16))
    planes = hardneg.bit_planes(b, 9, 2)
    assert np.array_equal(hardneg.from_planes(planes), b)
    assert np.array_equal(hardneg.scores(hardneg.subset_sums(a), planes), b @ a.T)
