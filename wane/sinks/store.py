"""Responses as an append-only log that is read by key.

Every run appends one part below the root, partitioned by the first hex digits of the key and sorted by key within them, with Parquet's Bloom
filters on the key. A lookup names the partitions of the keys that it asks for, so it lists and reads only these, and joins before anything is
aggregated: its cost follows the batch, not the log. `compact` merges the parts so far into one. A part counts once its success mark is
written; a repeated run replaces its own part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wane.operators.ranking import latest_per_key

COLUMNS = (
    "cache_key string, model_name string, prompt_version string, api_name string, call_site_text string, evidence_snippet string, "
    "response_json string, prompt_tokens int, candidate_tokens int, total_tokens int, created_at timestamp")
RUN, UPTO = "run-", "upto-"


def _number(part: str) -> int:
    return int(part.rsplit("-", 1)[1])


@dataclass(frozen=True)
class ResponseStore:
    """A log of responses below `root`, any folder that Spark can write. `digits` hex digits of the key make a partition: 16**digits of them."""

    spark: SparkSession
    root: str
    digits: int = 2

    def _bucket(self) -> Column:
        return F.substring("cache_key", 1, self.digits)

    def _files(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.root)
        return jvm, root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        """Finished parts, one folder each: what was compacted first."""
        jvm, root, system = self._files()
        if not system.exists(root):
            return []
        names = [s.getPath().getName() for s in system.listStatus(root) if s.isDirectory()]
        return sorted(
            (n.removeprefix("part=") for n in names if n.startswith("part=") and system.exists(jvm.Path(jvm.Path(root, n), "_SUCCESS"))),
            key=lambda n: (n.startswith(RUN), n))

    def live(self, before: int | None = None) -> list[str]:
        """The parts to read: the widest compacted one and the runs after it. With `before`, only runs below that number count."""
        parts = [p for p in self.parts() if before is None or _number(p) < before]
        upto = max((_number(p) for p in parts if p.startswith(UPTO)), default=-1)
        return [p for p in parts if p == f"{UPTO}{upto:09d}" or (p.startswith(RUN) and _number(p) > upto)]

    def next_run(self) -> int:
        return max((_number(p) for p in self.parts()), default=-1) + 1

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows of the live parts, with their partition; older answers of a key among them."""
        live = self.live(before)
        if not live:
            return self.spark.createDataFrame([], f"{COLUMNS}, part string, bucket string")
        read = self.spark.read.schema(f"{COLUMNS}, part string, bucket string").option("basePath", self.root)
        return read.parquet(*[f"{self.root}/part={p}" for p in live])

    def append(self, responses: DataFrame, run: int | None = None) -> int:
        """Write one part; a run that is repeated replaces it. Returns the run's number."""
        run = self.next_run() if run is None else run
        self._write(responses, f"{RUN}{run:09d}")
        return run

    def _write(self, responses: DataFrame, part: str) -> None:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        out = responses.select(*names).withColumn("bucket", self._bucket())
        # one file for each partition: rows are narrow and keys are spread by their hash
        out = out.repartition("bucket").sortWithinPartitions("bucket", "cache_key")
        out.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#cache_key", "true").parquet(f"{self.root}/part={part}")

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The latest response of each key of `keys` (a column cache_key) that has one."""
        # at most 16**digits names
        wanted = [r[0] for r in keys.where("cache_key is not null").select(self._bucket().alias("b")).distinct().collect()]
        if not wanted:
            return self.rows(before).limit(0).drop("part", "bucket")
        found = self.rows(before).where(F.col("bucket").isin(wanted)).join(keys.select("cache_key").distinct(), "cache_key", "left_semi")
        return latest_per_key(found, ["cache_key"], [F.col("created_at"), F.col("part")]).drop("part", "bucket")

    def compact(self) -> str | None:
        """Merge the live parts: the latest response of each key, partition by partition. The parts stay until `retire`."""
        live = self.live()
        if len(live) < 2:
            return None
        part = f"{UPTO}{_number(live[-1]):09d}"
        self._write(latest_per_key(self.rows(), ["cache_key"], [F.col("created_at"), F.col("part")]), part)
        return part

    def retire(self) -> list[str]:
        """Delete the parts that a compacted one replaces. For a time when no reader began before `compact` ended."""
        jvm, root, system = self._files()
        old = [p for p in self.parts() if p not in self.live()]
        for p in old:
            system.delete(jvm.Path(root, f"part={p}"), True)
        return old
