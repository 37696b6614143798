"""Exact tests, intervals, bootstrap and predictive values from small counts.

Every statistic here depends on the data only through a handful of counts, so the
rows are aggregated once and no group is ever handed to a Python worker.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.operators.agreement import ratio


def log_factorial(n: Column) -> Column:
    """ln n!, by the Stirling series from n + 10 on and a product below."""
    x = n.cast("double") + 11
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    down = F.lit(0.0)
    for i in range(1, 11):
        down = down + F.log(n.cast("double") + i)
    return series - down


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact p of the binomial test on the discordant counts.

    Terms are summed downwards from min(b, c). They shrink at least like a normal tail,
    so some multiple of sqrt(n) of them suffices however many pairs there are.
    """
    m, n = F.least(b, c).cast("bigint"), (b + c).cast("bigint")
    terms = F.least(m, (F.ceil(F.sqrt(n) * 8) + 20).cast("bigint"))
    step = lambda acc, j: F.struct(
        (acc["term"] * (m - j + 1) / (n - m + j)).alias("term"),
        (acc["sum"] + acc["term"] * (m - j + 1) / (n - m + j)).alias("sum"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    ladder = F.when(terms >= 1, F.sequence(F.lit(1).cast("bigint"), terms)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(ladder, start, step, lambda acc: acc["sum"])
    log_top = log_factorial(n) - log_factorial(m) - log_factorial(n - m) - n * math.log(2)
    return F.least(F.exp(log_top + F.log(total)) * 2, F.lit(1.0))


def discordance(rows: DataFrame, truth: str, first: str, second: str, by: list[str] = ()) -> DataFrame:
    """McNemar counts of two predictors and the exact p; ``b`` is where only ``first`` is right."""
    ok1, ok2 = F.col(first) == F.col(truth), F.col(second) == F.col(truth)
    counts = rows.groupBy(*by).agg(
        F.count_if(ok1 & ok2).alias("both_correct"), F.count_if(ok1 & ~ok2).alias("b"),
        F.count_if(~ok1 & ok2).alias("c"), F.count_if(~ok1 & ~ok2).alias("both_wrong"))
    return counts.withColumn("statistic", F.least("b", "c").cast("double")).withColumn(
        "p_value", mcnemar_p(F.col("b"), F.col("c")))


def one_sided_p(n: Column) -> Column:
    """Two-sided sign test when all n discordant pairs lie on one side."""
    return F.lit(2.0) * F.pow(F.lit(0.5), n)


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """Exact binomial interval (low, high); (0, 1) when n is 0."""
    def bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        low, high = [], []
        for a, m in zip(k, n):
            low.append(0.0 if a == 0 or m == 0 else _beta_quantile(alpha / 2, a, m - a + 1))
            high.append(1.0 if a == m or m == 0 else _beta_quantile(1 - alpha / 2, a + 1, m - a))
        return pd.DataFrame({"low": low, "high": high})

    general = F.pandas_udf(bounds, "low double, high double")(k.cast("double"), n.cast("double"))
    # the two edge cases have closed forms
    kd, nd = k.cast("double"), n.cast("double")
    edge = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    return (
        F.when(nd == 0, edge(F.lit(0.0), F.lit(1.0)))
        .when(kd == nd, edge(F.pow(F.lit(alpha / 2), F.lit(1.0) / nd), F.lit(1.0)))
        .when(kd == 0, edge(F.lit(0.0), F.lit(1.0) - F.pow(F.lit(alpha / 2), F.lit(1.0) / nd)))
        .otherwise(general))


def edge_interval(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """Closed-form interval for k = 0 or k = n, null otherwise."""
    kd, nd = k.cast("double"), n.cast("double")
    edge = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    return (
        F.when(nd == 0, edge(F.lit(0.0), F.lit(1.0)))
        .when(kd == nd, edge(F.pow(F.lit(alpha / 2), F.lit(1.0) / nd), F.lit(1.0)))
        .when(kd == 0, edge(F.lit(0.0), F.lit(1.0) - F.pow(F.lit(alpha / 2), F.lit(1.0) / nd))))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    d = 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    c, h = 1.0, d
    for m in range(1, 10_000 + 10 * int(math.sqrt(a + b))):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * h
    raise ArithmeticError(f"the continued fraction at x={x}, a={a}, b={b} has not converged")


def _beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if _beta_cdf(mid, a, b) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def mcnemar_power(counts: DataFrame, total: int | Column, alpha: float = 0.05, power: float = 0.80) -> DataFrame:
    """Post-hoc power and required sizes by the normal approximation.

    ``counts`` has the discordant counts ``b`` and ``c``; ``total`` is the number of items.
    """
    normal = NormalDist()
    z_alpha, z_beta = normal.inv_cdf(1 - alpha / 2), normal.inv_cdf(power)
    cdf = F.pandas_udf(lambda s: s.map(normal.cdf, na_action="ignore"), "double")
    total = F.lit(total) if isinstance(total, int) else total
    n = (F.col("b") + F.col("c")).cast("double")
    p = ratio(F.col("b"), n)
    var = p * (1 - p)
    se = F.sqrt(n * var)
    # null where every discordant pair is on one side, or as many on each
    high = F.try_divide(n * 0.5 + z_alpha * F.sqrt(n * 0.25) - n * p, se)
    low = F.try_divide(n * 0.5 - z_alpha * F.sqrt(n * 0.25) - n * p, se)
    needed = F.ceil(F.try_divide(F.pow(F.lit(z_alpha * 0.5) + z_beta * F.sqrt(var), 2), F.pow(p - 0.5, 2)))
    c = counts.withColumn("discordant", n.cast("bigint")).withColumn("p_observed", p).withColumn(
        "effect", F.abs(p - 0.5)).withColumn("_high", high).withColumn("_low", low).withColumn(
        "required_discordant", needed).withColumn("required_total", F.ceil(F.try_divide(needed * total, n)))
    return c.withColumn("post_hoc_power", 1 - cdf("_high") + cdf("_low")).drop("_high", "_low")


def _multinomial(cells: list[str], seed: int):
    """Replicate counts: resampling n items only changes how many fall in each cell."""
    def resample(rep: pd.Series, *counts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(rep), len(cells)), dtype="int64")
        for i, (r, *c) in enumerate(zip(rep, *counts)):
            n = sum(c)
            if n:
                out[i] = np.random.default_rng([seed, int(r)]).multinomial(n, np.array(c) / n)
        return pd.DataFrame(out, columns=cells)

    return F.pandas_udf(resample, ", ".join(f"{c} bigint" for c in cells))


def _replicates(counts: DataFrame, cells: list[str], replicates: int, seed: int) -> DataFrame:
    reps = counts.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    reps = reps.repartition(*[F.col(c) for c in counts.columns], F.pmod("_rep", F.lit(64)))
    return reps.withColumn("_c", _multinomial(cells, seed)("_rep", *cells))


def bootstrap_metrics(counts: DataFrame, by: list[str] = (), replicates: int = 10000, seed: int = 42) -> DataFrame:
    """95 % percentile intervals of precision, recall, specificity and F1.

    ``counts`` has tp, fp, fn, tn per group. A draw of n items with replacement is a
    multinomial draw of the four cells, so the work does not grow with n.
    """
    cells = ["tp", "fp", "fn", "tn"]
    r = _replicates(counts.select(*by, *cells), cells, replicates, seed)
    tp, fp, fn, tn = (F.col(f"_c.{c}") for c in cells)
    p, rc = ratio(tp, tp + fp), ratio(tp, tp + fn)
    r = r.select(*by, p.alias("precision"), rc.alias("recall"), ratio(tn, tn + fp).alias("specificity"),
                 ratio(p * rc * 2, p + rc).alias("f1"))
    out = []
    for m in ("precision", "recall", "specificity", "f1"):
        out += [F.percentile(m, F.lit(0.025)).alias(f"{m}_low"), F.percentile(m, F.lit(0.975)).alias(f"{m}_high")]
    return r.groupBy(*by).agg(*out)


def with_intervals(counts: DataFrame, by: list[str] = (), replicates: int = 10000, seed: int = 42) -> DataFrame:
    """Bootstrap intervals, with the exact interval where a proportion is 0 or 1."""
    boot = bootstrap_metrics(counts, by, replicates, seed)
    j = counts.join(boot, list(by)) if by else counts.crossJoin(F.broadcast(boot))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    for m, k, n in (("precision", tp, tp + fp), ("recall", tp, tp + fn), ("specificity", tn, tn + fp)):
        exact = edge_interval(k, n)
        j = j.withColumn(f"{m}_method", F.when(exact.isNotNull(), F.lit("clopper_pearson")).otherwise(F.lit("bootstrap")))
        j = j.withColumn(f"{m}_low", F.coalesce(exact["low"], f"{m}_low")).withColumn(
            f"{m}_high", F.coalesce(exact["high"], f"{m}_high"))
    return j


def paired_counts(rows: DataFrame, truth: str, first: str, second: str, by: list[str] = ()) -> DataFrame:
    """Counts of the eight (truth, first, second) cells."""
    cells = []
    for t in (1, 0):
        for a in (1, 0):
            for b in (1, 0):
                cells.append(F.count_if((F.col(truth) == bool(t)) & (F.col(first) == bool(a)) & (F.col(second) == bool(b))).alias(f"n{t}{a}{b}"))
    return rows.groupBy(*by).agg(*cells)


def _f1(prefix: str, position: int) -> Column:
    col = lambda name: F.col(prefix + name)
    cell = lambda t, p: sum((col(f"n{t}{a}{b}") for a in (1, 0) for b in (1, 0) if (a, b)[position] == p), F.lit(0))
    tp, fp, fn = cell(1, 1), cell(0, 1), cell(1, 0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return ratio(p * r * 2, p + r)


def paired_bootstrap(counts: DataFrame, by: list[str] = (), replicates: int = 10000, seed: int = 42) -> DataFrame:
    """Difference in F1 of two predictors on the same items: interval and p-values."""
    cells = [f"n{t}{a}{b}" for t in (1, 0) for a in (1, 0) for b in (1, 0)]
    base = counts.select(*by, *cells)
    base = base.withColumn("_point", _f1("", 0) - _f1("", 1))
    r = _replicates(base, cells, replicates, seed)
    r = r.select(*by, "_point", (_f1("_c.", 0) - _f1("_c.", 1)).alias("_delta"))
    shifted = F.abs(F.col("_delta") - F.col("_point")) >= F.abs("_point")
    against = F.when(F.col("_point") > 0, F.col("_delta") <= 0).otherwise(F.col("_delta") >= 0)
    return r.groupBy(*by).agg(
        F.first("_point").alias("point_estimate"),
        F.percentile("_delta", F.lit(0.025)).alias("ci_low"), F.percentile("_delta", F.lit(0.975)).alias("ci_high"),
        F.avg(shifted.cast("double")).alias("p_two_sided"), F.avg(against.cast("double")).alias("p_one_sided"))


def predictive_value(sensitivity: Column, specificity: Column, prevalence: Column) -> Column:
    hit = sensitivity * prevalence
    return ratio(hit, hit + (1 - specificity) * (1 - prevalence))


def ppv_table(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Positive predictive value at fixed prevalences for rows with recall and specificity."""
    steps = F.array(*[F.struct(F.lit(n).alias("prevalence"), F.lit(v).alias("rate")) for n, v in fixed.PREVALENCES])
    t = metrics.withColumn("_p", F.explode(steps))
    return t.select(*columns, F.col("_p.prevalence").alias("prevalence"), F.col("_p.rate").alias("rate"),
                    predictive_value(F.col("recall"), F.col("specificity"), F.col("_p.rate")).alias("ppv"))


def recovered(counts: DataFrame, extra: Column) -> DataFrame:
    """What recall and F1 would be if ``extra`` of the misses were found."""
    tp, fp, fn = F.col("tp") + extra, F.col("fp"), F.col("fn") - extra
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumn("tp_if", tp).withColumn("fn_if", fn).withColumn("recall_if", r).withColumn(
        "f1_if", ratio(p * r * 2, p + r))
