"""Confusion counts, agreement and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def half_even(c: Column, digits: int) -> Column:
    """Round the way Python does, half to even."""
    return F.bround(c, digits)


def confusion(truth: Column, pred: Column, where: Column | None = None, prefix: str = "") -> list[Column]:
    """tp, fp, fn, tn; a null on either side counts nowhere."""
    keep = F.lit(True) if where is None else where
    cell = lambda t, p: F.count_if(keep & (truth == t) & (pred == p))
    return [cell(True, True).alias(prefix + "tp"), cell(False, True).alias(prefix + "fp"),
            cell(True, False).alias(prefix + "fn"), cell(False, False).alias(prefix + "tn")]


def with_metrics(counts: DataFrame, prefix: str = "") -> DataFrame:
    tp, fp, fn, tn = (F.col(prefix + c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumn(prefix + "precision", p).withColumn(prefix + "recall", r).withColumn(
        prefix + "specificity", ratio(tn, tn + fp)).withColumn(prefix + "f1", ratio(p * r * 2, p + r))


def binary_metrics(rows: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    return with_metrics(rows.groupBy(*by).agg(*confusion(F.col(truth), F.col(pred))))


def conditional_and_end_to_end(rows: DataFrame, truth: str, pred: str, missed: Column, by: list[str] = ()) -> DataFrame:
    """The same metrics with and without the rows the pipeline never saw, in one pass."""
    t, p = F.col(truth), F.col(pred)
    counts = rows.groupBy(*by).agg(*confusion(t, p, prefix="e2e_"), *confusion(t, p, ~missed, "cond_"))
    return with_metrics(with_metrics(counts, "e2e_"), "cond_")


def contingency(first: Column, second: Column) -> list[Column]:
    """2x2 counts; pairs with a missing decision are counted on their own."""
    cell = lambda a, b: F.count_if((first == a) & (second == b))
    return [cell(True, True).alias("both_true"), cell(True, False).alias("first_only"),
            cell(False, True).alias("second_only"), cell(False, False).alias("both_false"),
            F.count_if(first.isNull() | second.isNull()).alias("n_missing")]


def kappa(po: Column, pe: Column, edge: str = "one") -> Column:
    """Cohen's kappa. ``edge`` says what chance agreement 1 means: 'one', 'agree' or 'zero'."""
    k = (po - pe) / F.nullif(F.lit(1.0) - pe, F.lit(0.0))
    if edge == "one":
        return F.when(pe >= 1.0, 1.0).otherwise(k)
    close = lambda x: F.abs(x - 1.0) <= 1e-9 * F.greatest(F.abs(x), F.lit(1.0))
    if edge == "agree":
        return F.when(close(pe), F.when(close(po), 1.0).otherwise(0.0)).otherwise(k)
    return F.when(F.lit(1.0) - pe > 1e-9, k).otherwise(0.0)


def with_agreement(counts: DataFrame, edge: str = "one", empty: float = 0.0) -> DataFrame:
    """Concordance, kappa, PABAK, sensitivity, specificity, balanced accuracy (fractions).

    ``empty`` is the value of the agreement measures when there are no pairs.
    """
    a, b, c, d = (F.col(x).cast("double") for x in ("both_true", "first_only", "second_only", "both_false"))
    n = a + b + c + d
    po = ratio(a + d, n)
    pe = ratio((a + b) * (a + c) + (c + d) * (b + d), n * n)
    sens, spec = ratio(a, a + c), ratio(d, d + b)
    some = n > 0
    return counts.withColumn("n", n.cast("bigint")).withColumn("agreed", (a + d).cast("bigint")).withColumn(
        "concordance", F.when(some, po).otherwise(empty)).withColumn("chance", pe).withColumn(
        "kappa", F.when(some, kappa(po, pe, edge)).otherwise(empty)).withColumn(
        "pabak", F.when(some, po * 2 - 1).otherwise(empty)).withColumn(
        "sensitivity", sens).withColumn("specificity", spec).withColumn("balanced_accuracy", (sens + spec) / 2)


def agreement(rows: DataFrame, first: str, second: str, by: list[str] = (), edge: str = "one", empty: float = 0.0) -> DataFrame:
    return with_agreement(rows.groupBy(*by).agg(*contingency(F.col(first), F.col(second))), edge, empty)


def join_predictions(benchmark: DataFrame, report: DataFrame, zero_shot: DataFrame) -> DataFrame:
    """Benchmark rows with three predictions; a row without one of them is an error."""
    r = report.select("benchmark_id", "pred_a", "pred_b", "reason_b")
    z = zero_shot.select("benchmark_id", F.col("zero_shot_pred").alias("pred_c"))
    j = benchmark.join(r, "benchmark_id", "left").join(z, "benchmark_id", "left")
    whole = F.col("pred_a").isNotNull() & F.col("pred_b").isNotNull() & F.col("pred_c").isNotNull()
    return j.where(F.when(whole, True).otherwise(
        F.raise_error(F.concat(F.lit("no prediction for "), "benchmark_id")).cast("boolean")))


def ablation(rows: DataFrame, truth: str = "is_deprecated_call") -> DataFrame:
    """Which stage kept the true negatives, and which removed the false positives of the leaf match."""
    neg = ~F.col(truth) & ~F.col("pred_b")
    removed = neg & F.col("pred_a")
    model = F.contains("reason_b", F.lit("rejected_by_llm"))
    types = F.contains("reason_b", F.lit("resolved_benign_by_jedi_"))
    early = F.col("reason_b").isin("unmanifested_upstream_filtered", "unmanifested_no_call_on_target_line")
    out = []
    for name, base in (("true_negatives", neg), ("eliminated", removed)):
        out += [F.count_if(base).alias(f"{name}_total"), F.count_if(base & early).alias(f"{name}_upstream"),
                F.count_if(base & types).alias(f"{name}_type_resolution"), F.count_if(base & model).alias(f"{name}_verifier")]
    return rows.agg(*out)
