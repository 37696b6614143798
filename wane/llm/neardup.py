"""Near-duplicate documents by minhash with tensored banding.

Instead of one collection of minhashes per table, `collections` small collections are computed and every pair of them keys a
table: m collections give m (m - 1) / 2 tables, so the hashes needed are about the square root of those of independent
tables. Two documents are candidates when two of their collections agree; links are confirmed on the full shingle sets.

Documents of equal sets are one class from the start, so copies never meet. Within a table key every class is first compared
with the key's smallest class. Only classes that remain in several components are compared further, in blocks of bounded size
that respect the sets' lengths, without a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wane.llm.common import byte_blocks, stored
from wane.llm.fingerprints import length_partition
from wane.llm.graph import components
from wane.llm.shingles import collections as collections_of
from wane.llm.shingles import set_digest, shared, shingle_sets


def _alike(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, least: Fraction):
    """Exact test in integers: intersection >= least * union."""
    return least.denominator * both >= least.numerator * (a + b - both)


def _signed(docs: DataFrame, kind: str, width: int, number: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", 4_000_000):
            value, cuts = shingle_sets(block["text"].to_pylist(), width)
            one, two = set_digest(value, cuts)
            keys = collections_of(value, cuts, number, size).view(np.int64)
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, number, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [block["id"], pa.array(np.diff(cuts)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), flat], names=["id", "n", "class", "check", "keys"]
            )

    return docs.mapInArrow(run, f"id {kind}, n long, class long, check long, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", 4_000_000):
            value, cuts = shingle_sets(block["text"].to_pylist(), width)
            packed = pa.array([value[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([block["class"], block["n"], packed], names=["class", "n", "members"])

    return docs.mapInArrow(run, "class long, n long, members binary")


def _confirmed(edges: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Edges (class, head) whose full sets are alike."""
    ratio = float(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "other", 16_000_000):
            ok, last, head = [], None, None
            for x, y in zip(block["members"], block["other"], strict=True):
                a, raw = np.frombuffer(x.as_buffer(), np.uint64), y.as_buffer()
                b = np.frombuffer(raw, np.uint64)
                ok.append(bool(_alike(shared(a, b), len(a), len(b), least)))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([block["a"].filter(keep), block["b"].filter(keep)], names=["a", "b"])

    fits = (F.col("n") >= F.col("m") * ratio - 1) & (F.col("m") >= F.col("n") * ratio - 1)
    pairs = edges.join(sets, "class").join(sets.select(F.col("class").alias("head"), F.col("n").alias("m"), F.col("members").alias("other")), "head").filter(fits)
    return pairs.select(F.col("class").alias("a"), F.col("head").alias("b"), "members", "other").mapInArrow(run, "a long, b long")


def _within_blocks(active: DataFrame, least: Fraction, block: int) -> DataFrame:
    """Links between the components of each group. active: (class, n, members, root, grp).

    Classes are dealt to blocks of about `block` by group, length partition and hash; every two blocks of the same or of neighbouring
    partitions are one task's input. A task returns only links that join components it has not joined yet.
    """
    sized = active.withColumn("lane", length_partition(F.col("n"), float(least)))
    counts = sized.groupBy("grp", "lane").count().select("grp", "lane", F.ceil(F.col("count") / block).cast("int").alias("k"))
    near = counts.select("grp", "lane", "k", F.lit(0).alias("d")).union(counts.select("grp", F.col("lane") - 1, "k", F.lit(1))).union(counts.select("grp", F.col("lane") + 1, "k", F.lit(-1)))
    near = near.groupBy("grp", "lane").agg(*(F.coalesce(F.max(F.when(F.col("d") == d, F.col("k"))), F.lit(0)).alias(c) for d, c in ((0, "k"), (1, "up"), (-1, "down"))))
    own = F.pmod(F.xxhash64("class"), F.col("k")).cast("int")
    numbers = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda lane, s, up, t: F.struct(lane.cast("int").alias("lane"), s.cast("int").alias("s"), F.lit(up).alias("up"), t.cast("int").alias("t"))
    same = F.transform(numbers("k"), lambda x: task(F.col("lane"), F.least(x, F.col("own")), 0, F.greatest(x, F.col("own"))))
    above = F.transform(numbers("up"), lambda x: task(F.col("lane"), F.col("own"), 1, x))
    below = F.transform(numbers("down"), lambda x: task(F.col("lane") - 1, x, 1, F.col("own")))
    dealt = sized.join(near, ["grp", "lane"]).withColumn("own", own).withColumn("task", F.explode(F.concat(same, above, below)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first, s, t, up = int(pdf["task_lane"].iloc[0]), int(pdf["s"].iloc[0]), int(pdf["t"].iloc[0]), int(pdf["up"].iloc[0])
        names, roots = pdf["class"].to_numpy(), {}
        left = np.flatnonzero((pdf["lane"] == first) & (pdf["own"] == s))
        right = np.flatnonzero((pdf["lane"] == first + up) & (pdf["own"] == t))
        sets = [np.frombuffer(m, np.uint64) for m in pdf["members"]]
        size = np.array([len(x) for x in sets])

        def root(x: int) -> int:
            while roots.get(x, x) != x:
                roots[x] = x = roots.get(roots[x], roots[x])
            return x

        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        flat = np.concatenate([sets[i] for i in right])
        owner = np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        comp, out = pdf["root"].to_numpy(), []
        for i in left:
            lo, hi = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], side="right")
            n = hi - lo
            if not n.sum():
                continue
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(right))
            for j in np.flatnonzero(_alike(both, size[i], size[right], least)):
                x, y = root(comp[i]), root(comp[right[j]])
                if x != y:
                    roots[x] = y
                    out.append((names[i], names[right[j]]))
        return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)

    rows = dealt.select("grp", "class", "members", "root", "lane", "own", F.col("task.lane").alias("task_lane"), "task.s", "task.up", "task.t")
    return rows.groupBy("grp", "task_lane", "s", "up", "t").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, width: int = 5, least: float | Fraction = Fraction(4, 5), number: int = 20, size: int = 3, block: int = 256,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: components of links with Jaccard similarity of `least` or more.

    A pair at similarity s is missed when fewer than two of `number` collections agree, each with chance s ** size: 1.3e-5 at
    0.8 and less above. component_id is the smallest id of the component, kept marks it. Null and wordless texts are empty
    and linked with nothing. Rows with a null id are linked with nothing and kept. Rows that repeat an id are one document with
    the texts of all. An empty table gives no rows. Other columns are left out.
    """
    least = Fraction(least).limit_denominator(1000)
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    signed = stored(_signed(plain, kind, width, number, size), "neardup-signed")
    known = signed.filter("id is not null and n > 0")

    # Tables keyed by pairs of collections, of those that some other class has too.
    reps = known.groupBy("class").agg(F.min("id").alias("id"))
    one = known.join(reps, ["class", "id"]).dropDuplicates(["class"])
    single = one.select("class", F.posexplode("keys").alias("i", "c"))
    often = single.groupBy("i", "c").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("i", "c")
    per = single.join(often, ["i", "c"]).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("own")).filter(F.size("own") > 1)
    joint = F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.greatest(F.size("own") - i - 1, F.lit(0))), lambda y: F.xxhash64(x["i"], x["c"], y["i"], y["c"])))
    keys = per.select("class", F.explode(F.flatten(joint)).alias("key"))
    heads = keys.groupBy("key").agg(F.min("class").alias("head"), F.max("class").alias("last")).filter("head != last").select("key", "head")
    keys = stored(keys.join(heads, "key"), "neardup-keys")

    # Full sets of the classes that share a key.
    wanted = keys.select("class").distinct().join(one.select("class", "id", "n"), "class")
    texts = plain.join(wanted, "id").select("class", "n", "text")
    sets = _sets(texts, width).filter(F.length("members") == F.col("n") * 8)
    sets = stored(sets.dropDuplicates(["class"]), "neardup-sets")
    edges = keys.select("class", "head").filter("class != head").distinct()
    links = stored(_confirmed(edges, sets, least), "neardup-links")
    root = components(links)

    # Keys that still hold several components.
    of = keys.join(root.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("root", "class").alias("root"), "head")
    mixed_keys = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    rest = stored(of.join(mixed_keys, "key").select("class", "root", "head").distinct(), "neardup-rest")
    group = components(rest.select(F.col("class").alias("a"), F.col("head").alias("b")))
    active = rest.select("class", "root").distinct().join(group.select(F.col("node").alias("class"), F.col("root").alias("grp")), "class").join(sets, "class")
    more = _within_blocks(active, least, block)
    final = components(links.union(more))

    # Rows that repeat an id tie the classes of their texts together.
    ids = known.select("id", "class").distinct()
    named = ids.join(final.withColumnRenamed("node", "class"), "class", "left").select("id", F.coalesce("root", "class").alias("root"))
    repeated = named.groupBy("id").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("id", "a")
    tied = components(named.join(repeated, "id").select("a", F.col("root").alias("b")))
    merged = tied.select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = named.join(merged, "root", "left").select("id", F.coalesce("top", "root").alias("root")).distinct()
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    result = named.join(smallest, "root").select("id", "component_id")
    out = signed.select("id", "n").join(result, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
