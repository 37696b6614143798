"""Shared pieces of the text operators: folders, stored tables, batches and hashed words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the rolling and mixing hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Only a local session that names none (tests) gets one on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wane-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a finished execution; they would stay until the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: for writes whose result is read back, and whose input nobody runs again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def stored_apart(df: DataFrame, purpose: str, test: Column, key: str, buckets: int) -> tuple[DataFrame, DataFrame, str]:
    """Write in one pass, and read back apart, the rows that meet a test (never null) and the others, in buckets of `key`: what groups them
    by it leaves them in place. Last comes the folder of the others, which can be discarded."""
    spark = df.sparkSession
    folder, name = shared_folder(spark, purpose), f"stored_{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.withColumn("_apart", test).write.partitionBy("_apart").bucketBy(buckets, key).option("path", folder).option("compression", "zstd").saveAsTable(name)
    both = spark.table(name)
    return both.filter("_apart").drop("_apart"), both.filter("not _apart").drop("_apart"), f"{folder}/_apart=false"


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Empty folders that nothing reads any more: those named, and those of tables that `stored` gave."""
    for x in tables:
        for folder in {x} if isinstance(x, str) else {f.rpartition("/")[0] for f in x.inputFiles()}:
            spark.range(0).write.mode("overwrite").parquet(folder)


def give_back() -> None:
    """Return the memory of finished work to the system: the driver's Python, or a worker that waits for its next task, would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bucket_of(id_column: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a number; a null id counts as empty text."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def byte_blocks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into blocks of about so many text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch[text]).fill_null(0)).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def joined_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with a blank after each, and the start of each text (one more at the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8), ends.astype(np.int64)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashed_words(data: np.ndarray, starts: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hash of each word `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and the number of the text it stands in.

    With `prefix`, also a hash of each word's first so many bytes (under 64), 0 for words that have no more.
    """
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return (np.empty(0, np.uint64), np.empty(0, np.int64), *([np.empty(0, np.uint64)] if prefix else []))
    # Polynomial value of each word, Horner order: one step per byte position, long words only while they last.
    length = last - first
    order = np.argsort(-length, kind="stable")
    begin, size = first[order], length[order]
    value = np.zeros(len(begin), np.uint64)
    alive, early = len(begin), np.zeros(len(begin) if prefix else 0, np.uint64)
    for k in range(int(size[0])):
        if k >= 64:
            break
        if prefix and k == prefix:
            alive = int(np.searchsorted(-size, -k, side="left"))
            early[:alive] = mixed(value[:alive] ^ np.uint64(prefix))
        alive = int(np.searchsorted(-size, -k, side="left"))
        value[:alive] = value[:alive] * BASE + low[begin[:alive] + k] + np.uint64(1)
    if k >= 64:
        for i in range(int(np.searchsorted(-size, -64, side="left"))):
            rest = low[begin[i] + 64 : begin[i] + size[i]].astype(np.uint64) + np.uint64(1)
            p = _powers(len(rest) + 1)
            with np.errstate(over="ignore"):
                value[i] = value[i] * p[-1] + (rest * p[:-1][::-1]).sum(dtype=np.uint64)
    out = np.empty_like(value)
    out[order] = mixed(value ^ (size.astype(np.uint64) << np.uint64(48)))
    of = np.searchsorted(starts, first, side="right") - 1
    if not prefix:
        return out, of
    head = np.empty_like(early)
    head[order] = early
    return out, of, head
