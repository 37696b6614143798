"""Nearest neighbours by a hierarchical navigable small-world graph for each shard of vectors.

Shards have a bounded number of distinct vectors. A graph is stored as one row of flat arrays: the neighbours of node i on level l
are a fixed-width slice. Every shard answers every query block with its nearest, and a ranking over shards merges them.
Equal vectors are one node, which keeps the smallest ids that a result can need.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wane.llm.common import stored


class Graph:
    """levels[l]: (n, width) neighbours with -1 for none; level 0 has twice the width of the others."""

    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.entry = vectors, levels, entry
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.seen = np.zeros(len(vectors), np.int32)
        self.stamp = 0

    def near(self, q: np.ndarray, starts: list[tuple[float, int]], level: int, breadth: int) -> list[tuple[float, int]]:
        """The nearest nodes found by a beam of `breadth`, ascending. Distances are squared, less the query's own square."""
        links, vectors, norms, seen = self.levels[level], self.vectors, self.norms, self.seen
        self.stamp += 1
        stamp = self.stamp
        for _, i in starts:
            seen[i] = stamp
        todo, best = list(starts), [(-d, i) for d, i in starts]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= breadth:
                break
            some = links[i]
            some = some[(seen[some] != stamp) & (some >= 0)]
            if not len(some):
                continue
            seen[some] = stamp
            far = norms[some] - 2 * (vectors[some] @ q)
            if len(best) >= breadth:
                closer = far < -best[0][0]
                some, far = some[closer], far[closer]
            for x, j in zip(far.tolist(), some.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (-x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                else:
                    continue
                heapq.heappush(todo, (x, j))
        return sorted((-d, i) for d, i in best)

    def start(self, q: np.ndarray, down_to: int) -> list[tuple[float, int]]:
        at = [(float(self.norms[self.entry] - 2 * (self.vectors[self.entry] @ q)), self.entry)]
        for level in range(len(self.levels) - 1, down_to, -1):
            at = self.near(q, at, level, 1)
        return at


def build(vectors: np.ndarray, width: int, breadth: int, seed: int = 1) -> Graph:
    """Insert the vectors one by one; each links to a diverse choice of the nearest found so far."""
    n = len(vectors)
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(width)).astype(int)
    levels = [np.full((n, 2 * width if k == 0 else width), -1, np.int32) for k in range(int(height.max()) + 1)]
    graph = Graph(vectors, levels, 0)
    top = int(height[0])
    for i in range(1, n):
        q, level = vectors[i], int(height[i])
        graph.levels = levels[: top + 1]
        at = graph.start(q, level)
        for k in range(min(level, top), -1, -1):
            at = graph.near(q, at, k, breadth)
            nodes = np.array([j for _, j in at])
            chosen = diverse(vectors, nodes, np.array([d for d, _ in at]) + graph.norms[i], width)
            links = levels[k]
            links[i, : len(chosen)] = chosen
            for j in chosen:
                row = links[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    others = np.append(row, i)
                    gap = vectors[others] - vectors[j]
                    d = np.einsum("ij,ij->i", gap, gap)
                    order = np.argsort(d, kind="stable")
                    keep = diverse(vectors, others[order], d[order], links.shape[1])
                    row[:] = -1
                    row[: len(keep)] = keep
        if level > top:
            graph.entry, top = i, level
    graph.levels = levels
    return graph


def diverse(vectors: np.ndarray, nodes: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Nodes, nearest first, that are nearer to the centre than to any node chosen before; then the nearest of the others."""
    if len(nodes) <= most:
        return nodes
    own = vectors[nodes]
    square = np.einsum("ij,ij->i", own, own)
    gap = square[:, None] + square[None, :] - 2 * (own @ own.T)
    nearest = np.full(len(nodes), np.inf)
    first: list[int] = []
    for i in range(len(nodes)):
        if distance[i] < nearest[i]:
            first.append(i)
            if len(first) == most:
                break
            nearest = np.minimum(nearest, gap[i])
    if len(first) < most:
        rest = np.ones(len(nodes), bool)
        rest[first] = False
        first += np.flatnonzero(rest)[: most - len(first)].tolist()
    return nodes[first]


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def index(points: DataFrame, k: int, shard_size: int, width: int, breadth: int) -> DataFrame:
    """One row for each shard. points: (id, v array<double>)."""
    keyed = points.withColumn("h", F.xxhash64("v"))
    smallest = Window.partitionBy("h", "v").orderBy("id")
    nodes = keyed.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = stored(nodes.withColumn("dim", F.size("v")), "ann-nodes")
    counts = nodes.groupBy("dim").count().select("dim", F.ceil(F.col("count") / shard_size).cast("int").alias("shards"))
    # A shard's work is large and its bytes are few: a fixed number of partitions keeps shards from being put together.
    total = counts.agg(F.sum("shards")).first()[0] or 1
    dealt = nodes.join(counts, "dim").withColumn("shard", F.pmod("h", F.col("shards")).cast("int")).repartition(4 * int(total), "dim", "shard")

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        vectors = np.stack(pdf["v"].to_list())
        graph = build(vectors.astype(np.float32), width, breadth)
        counts = np.array([len(x) for x in pdf["ids"]], np.int32)
        return pd.DataFrame([{
            "dim": key[0], "shard": key[1], "n": len(vectors), "vectors": vectors.astype("<f8").tobytes(), "ids": np.concatenate(pdf["ids"].to_list()).astype("<i8").tobytes(),
            "counts": counts.tobytes(), "entry": graph.entry, "levels": [x.astype("<i4").tobytes() for x in graph.levels],
        }])

    schema = "dim int, shard int, n int, vectors binary, ids binary, counts binary, entry int, levels array<binary>"
    return stored(dealt.groupBy("dim", "shard").applyInPandas(make, schema), "ann-index")


def nearest(
    points: DataFrame, queries: Column, k: int = 10, shard_size: int = 4096, width: int = 16, build_breadth: int = 80, breadth: int = 160,
    query_block: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): for each row where `queries` holds, the k nearest other rows found, by Euclidean distance.

    Distances are in double precision; ties go to the smaller id. Rows whose vector is null, empty, zero or not finite, or whose
    id is null, take no part; vectors of different lengths are never compared. Rows that repeat an id are one
    candidate for each different vector and never neighbours of that id. An empty table gives no rows.
    """
    kind = points.schema[id_column].dataType.simpleString()
    vector = F.transform(F.col(vector_column).cast("array<double>"), lambda x: x + F.lit(0.0))
    known = points.select(F.col(id_column).cast("long").alias("id"), vector.alias("v"), queries.alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    shards = index(known.select("id", "v"), k, shard_size, width, build_breadth)

    asked = known.filter("asks").select("id", "v", F.size("v").alias("dim")).distinct()
    blocks = asked.groupBy("dim").count().select("dim", F.ceil(F.col("count") / query_block).cast("int").alias("blocks"))
    sizes = shards.groupBy("dim").agg((F.max("shard") + 1).alias("shards")).join(blocks, "dim")
    left = asked.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = left.select("dim", "block", "id", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    right = shards.join(sizes.select("dim", "blocks"), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(key: tuple, asks: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in graphs.itertuples():
            vectors = np.frombuffer(row.vectors, "<f8").reshape(row.n, -1)
            counts = np.frombuffer(row.counts, np.int32)
            ids, ends = np.frombuffer(row.ids, "<i8"), np.cumsum(counts)
            graph = Graph(vectors.astype(np.float32), [np.frombuffer(x, "<i4").reshape(row.n, -1) for x in row.levels], row.entry)
            for own, v in zip(asks["id"], asks["v"], strict=True):
                if row.n <= breadth:
                    found = np.arange(row.n)
                else:
                    q = np.asarray(v, np.float32)
                    found = np.array([i for _, i in graph.near(q, graph.start(q, 0), 0, breadth)])
                score = np.sqrt(((vectors[found] - np.asarray(v)) ** 2).sum(axis=1))
                every = np.concatenate([ids[ends[i] - counts[i] : ends[i]] for i in found])
                score = np.repeat(score, counts[found])
                other = every != own
                every, score = every[other], score[other]
                best = np.lexsort((every, score))[:k]
                out.append(pd.DataFrame({"query_id": own, "id": every[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(search, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("id").cast(kind).alias(id_column), "score")
