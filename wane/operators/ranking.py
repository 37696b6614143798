"""Ranks, first rows and line-ups that stay exact when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def id_bucket(c: Column, bits: int = 16) -> Column:
    """Runs of consecutive integers; a run of unique ids has a bounded size."""
    return F.shiftright(c.cast("bigint"), bits)


def hash_bucket(c: Column, digits: int = 4) -> Column:
    """Leading digits of a hex digest."""
    return F.substring(c, 1, digits)


def positions(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str = "position") -> DataFrame:
    """Exact 1-based position within each key group.

    ``bucket`` must not decrease along ``order``. Only one bucket of a group is sorted
    in one task; the rows before it come from counts per bucket.
    """
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = before.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    cond = F.lit(True)
    for k in [*keys, "_bucket"]:
        cond = cond & b[k].eqNullSafe(offsets[k])
    joined = b.join(offsets, cond).select(b["*"], offsets["_before"])
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return joined.withColumn(out, (F.row_number().over(inside) + F.col("_before")).cast("bigint")).drop("_bucket", "_before")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key; the literal bound lets every map task keep only ``k``."""
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= F.lit(k))


def _has_map(kind) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    """Ties go by the other columns, as far as they can be ordered (maps cannot)."""
    rest = [c for c in df.columns if c not in keys]
    ties = [F.col(c) for c in rest if not _has_map(df.schema[c].dataType)]
    place = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate([*order, *ties])])
    return df.groupBy(*keys).agg(pick(F.struct(*rest), place).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key, by partial aggregation instead of a sort of the group."""
    return _one_per_key(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _one_per_key(df, keys, order, F.min_by)


def numbered(df: DataFrame, draw: Column, pattern: str = "bench_%03d", out: str = "benchmark_id") -> DataFrame:
    """Shuffle by a digest and give every row a sequence name."""
    ranked = positions(df.withColumn("_draw", draw), [], [F.col("_draw")], hash_bucket(F.col("_draw")), "_pos")
    return ranked.withColumn(out, F.format_string(pattern, "_pos")).drop("_draw", "_pos")


def ordered_distinct(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct keys in order of first appearance."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace: for every key the row with the highest ``order`` stays."""
    return latest_per_key(table.unionByName(changes, allowMissingColumns=True), keys, [F.col(order)])
