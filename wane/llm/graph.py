"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wane.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b", purpose: str = "components") -> DataFrame:
    """(node, root) for every node of an edge table: root is the smallest node that edges connect it with.

    Each round ties every node's larger neighbours, then all its smaller ones, to its smallest neighbour, until no
    edge changes; both halves are aggregations and joins keyed by node. Loops and null ends are left out, repeated edges
    are counted once, an empty table gives no rows. Rounds are stored tables, so a lost executor repeats one at most.
    """
    now = edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("low") != F.col("high")))
    now = stored(now.distinct(), purpose)
    mark = None
    while True:
        # Larger neighbours of each node go to its smallest neighbour or itself.
        both = now.union(now.select("high", "low")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = both.filter("other > node").join(least, "node").select(F.col("m").alias("low"), F.col("other").alias("high")).filter("low != high").distinct()
        # Smaller neighbours and the node itself go to the smallest of them.
        floor = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(floor, "high").select(F.col("m").alias("low"), F.explode(F.array("low", "high")).alias("high")).filter("low != high").distinct()
        # the write itself tells what it wrote
        seen = Observation()
        now = stored(small.observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(20,0)")).alias("a"),
            F.sum(F.col("low").cast("decimal(38,0)")).alias("b"), F.bit_xor(F.xxhash64("high", "low")).alias("c")), purpose)
        state = seen.get
        if state == mark:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root")).union(now.select("low", "low").distinct())
        mark = state
