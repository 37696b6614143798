"""Hard negatives by exact integer scores with Four-Russians tables.

Every vector becomes integers, and every row keeps its integers as bit planes: for each plane one byte per eight dimensions. For an
anchor and a group of eight dimensions a table holds the sums of all 256 subsets of the anchor's integers there. A score is then
looked up, not multiplied: plane by plane from the sign down, double what is there and add the tables at the row's bytes.

The anchors are a stated set of queries against all rows, in blocks: each shard of rows meets each group of anchors once, in a task
of its own, and only an anchor's few best rows of a shard leave it. The first pass scores an anchor against the rows of its own label
and finds its positives; the second scores it against the other rows, so each pair is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wane.llm.common import stored

#: Anchors that meet a shard in one task, anchors whose tables are held at once, rows scored at once.
ANCHOR_GROUP, TABLES, ROWS = 8_192, 64, 4_096
#: A shard holds so many rows at most; small tables are cut into LEAST_SHARDS.
SHARD, LEAST_SHARDS = 262_144, 24
PACKED = "row long, id {kind}, label {label}, anchor boolean, planes binary"


def quantized(vectors: list[np.ndarray], scale: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of vectors as rows of one array, shorter ones filled with zeros, and which of them stay within the limit."""
    width = max(map(len, vectors), default=0)
    out, fine = np.zeros((len(vectors), width), np.int64), np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        scaled = np.floor(np.asarray(v, np.float64) * scale)
        fine[k] = bool((np.abs(scaled) <= limit).all())
        if fine[k]:
            out[k, : len(v)] = scaled
    return out, fine


def bit_planes(values: np.ndarray, planes: int, groups: int) -> np.ndarray:
    """Two's complement planes of integers, the sign's first: (rows, planes, groups) bytes, bit d of a byte is dimension d of its group."""
    wide = np.zeros((len(values), groups * 8), np.int64)
    wide[:, : values.shape[1]] = values
    bits = np.stack([(wide >> p) & 1 for p in range(planes - 1, -1, -1)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The integers again."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    out = -bits[:, 0]
    for p in range(1, bits.shape[1]):
        out = 2 * out + bits[:, p]
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of each eight dimensions, doubled up dimension by dimension."""
    n, width = anchors.shape
    out = np.zeros((width // 8, 256, n), anchors.dtype)
    for g in range(width // 8):
        for d in range(8):
            out[g, 1 << d : 2 << d] = out[g, : 1 << d] + anchors[:, 8 * g + d]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) exact inner products by lookups, doublings and additions."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    picked = np.empty_like(total)
    for p in range(planes.shape[1]):
        if p:
            total += total
        for g in range(planes.shape[2]):
            np.take(tables[g], planes[:, p, g], axis=0, out=picked)
            if p:
                total += picked
            else:
                total -= picked
    return total


def _packed(rows: DataFrame, scale: int, limit: float, planes: int, groups: int, shard: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                values, fine = quantized(part["vector"].to_numpy(zero_copy_only=False).tolist(), scale, limit)
                part, packed = part.filter(pa.array(fine)), bit_planes(values[fine], planes, groups)
                number = np.arange(at, at + part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), part["id"], part["label"], part["anchor"], pa.array([p.tobytes() for p in packed], pa.binary())],
                    names=["row", "id", "label", "anchor", "planes"],
                )

    return rows.mapInArrow(run, schema)


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: Fraction = Fraction(80, 100), scale: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the inner product of these integers, higher first, ties to the smaller id. Positives
    are an anchor's first `positives` other rows of its label, negatives for each of them the first `negatives` rows of other labels
    that score between `low` of the positive's score and that score. Rows with a null label, vector or component, or a component that
    is not finite, take no part, nor do those whose components are so large that scores could leave 64 bits. A shorter
    vector counts as filled with zeros; an empty one scores 0. Repeated ids and rows are rows of their own, as anchors too. A null id can
    be a positive or negative and comes last in ties. An anchor without positives, a positive without negatives and an empty table give no
    rows. Other columns are left out.
    """
    spark, ids, labels = rows.sparkSession, rows.schema[id_column].dataType.simpleString(), rows.schema[label_column].dataType.simpleString()
    taken = rows.select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taken = taken.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    reach = F.array_max(F.transform("vector", lambda x: F.abs(x) * scale))
    size = taken.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(reach).alias("reach"),
        F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    groups = max(1, -(-(size["width"] or 0) // 8))
    limit = float(int(np.sqrt((2**63 - 1) / (8 * groups))) - 1)
    largest = int(min((size["reach"] or 0.0) + 1, limit))
    n_planes = largest.bit_length() + 1
    number = np.int32 if groups * 8 * (largest + 1) ** 2 < 2**31 else np.int64
    n_shards = max(LEAST_SHARDS, -(-size["n"] // SHARD))
    n_groups = max(1, -(-(size["anchors"] or 0) // ANCHOR_GROUP))
    schema = PACKED.format(kind=ids, label=labels)
    table = stored(_packed(taken, scale, limit, n_planes, groups, SHARD, schema), "bit-planes")
    shape = (n_planes, groups)

    def planes_of(frame: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(frame["planes"]), np.uint8).reshape(len(frame), *shape)

    def meetings(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows dealt to shards once for each group of anchors, anchors dealt to groups once for each shard."""
        left = table.select("row", "label", "planes", F.col("id").isNull().alias("missing"), F.coalesce("id", F.lit("0").cast(ids)).alias("id"))
        left = left.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int"))
        left = left.withColumn("bunch", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        right = asked.withColumn("bunch", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(n_groups)).cast("int"))
        right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        # The work of a group is not in proportion to its bytes, so the number of tasks is stated.
        return tuple(x.repartition(min(n_shards * n_groups, 10_000), "shard", "bunch") for x in (left, right))

    def order_of(frame: pd.DataFrame) -> np.ndarray:
        """Place of each row by id, nulls last."""
        order = frame[["missing", "id"]].reset_index(drop=True).sort_values(["missing", "id"], kind="stable").index.to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place

    def blocks(own: np.ndarray, many: pd.DataFrame, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor numbers, row numbers, their scores) of anchors of one label against the rows of that label or of the others."""
        packed, label = planes_of(many), many["label"].to_numpy()
        asked, integers = own["label"].to_numpy(), from_planes(planes_of(own)).astype(number)
        for one in pd.unique(asked):
            where = np.flatnonzero((label == one) if same else (label != one))
            who = np.flatnonzero(asked == one)
            if not len(where):
                continue
            for k in range(0, len(who), TABLES):
                part = who[k : k + TABLES]
                tables = subset_sums(integers[part])
                yield part, where, np.concatenate([scores(tables, packed[where[a : a + ROWS]]) for a in range(0, len(where), ROWS)])

    def first_same(key: tuple, many: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found, place = [], order_of(many)
        row, mine_row = many["row"].to_numpy(), own["row"].to_numpy()
        for part, where, score in blocks(own, many, True) if len(many) and len(own) else ():
            keep = min(positives + 1, len(where))
            for j, a in enumerate(part):
                s = score[:, j]
                least = np.partition(s, len(s) - keep)[len(s) - keep]
                near = np.flatnonzero(s >= least)
                near = near[np.lexsort((place[where[near]], -s[near].astype(np.int64)))]
                near = near[row[where[near]] != mine_row[a]][:positives]
                found += [(mine_row[a], row[where[b]], int(s[b])) for b in near]
        return pd.DataFrame(found, columns=["row", "other", "score"])

    top, bottom = low.numerator, low.denominator

    def first_other(key: tuple, many: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found, place = [], order_of(many)
        row, mine_row, asked = many["row"].to_numpy(), own["row"].to_numpy(), own["scores"].tolist()
        for part, where, score in blocks(own, many, False) if len(many) and len(own) else ():
            for j, a in enumerate(part):
                bounds = [(p, -(-top * int(p) // bottom)) for p in asked[a]]
                s = score[:, j]
                near = np.flatnonzero((s <= max(b[0] for b in bounds)) & (s >= min(b[1] for b in bounds)))
                near = near[np.lexsort((place[where[near]], -s[near].astype(np.int64)))]
                down = -s[near].astype(np.int64)
                for p, least in dict.fromkeys(bounds):
                    at = int(np.searchsorted(down, -p))
                    found += [(mine_row[a], int(p), row[where[b]], int(s[b])) for b in near[at : at + negatives] if s[b] >= least]
        return pd.DataFrame(found, columns=["row", "positive_score", "other", "score"])

    names = table.select(F.col("row").alias("other"), F.col("id").alias("other_id"))
    asked = table.filter("anchor").select("row", "label", "planes")
    left, right = meetings(asked)
    same = left.groupBy("shard", "bunch").cogroup(right.groupBy("shard", "bunch")).applyInPandas(first_same, "row long, other long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    held = stored(
        same.join(names, "other").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
        .join(table.filter("anchor").select("row", F.col("id").alias("anchor_id"), "label", "planes"), "row"), "positives")
    wanted = held.groupBy("row").agg(F.first("label").alias("label"), F.first("planes").alias("planes"), F.collect_list("score").alias("scores"))
    left, right = meetings(wanted)
    other = left.groupBy("shard", "bunch").cogroup(right.groupBy("shard", "bunch")).applyInPandas(first_other, "row long, positive_score long, other long, score long")
    # Bounded: at most `negatives` rows of each shard for each anchor and score of a positive.
    last = Window.partitionBy("row", "positive_score").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    ranked = other.join(names, "other").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= negatives)
    pairs = held.select("row", "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(ranked, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
