"""One large JSON array read by many tasks.

A file is cut into ranges of bytes. Whether a range begins inside a string, and how deep in the nesting, follows from all bytes before it; so
each task first tells what its range does to both, for either answer about the string, and the few numbers of the ranges are put together
in order. Then each task takes the records that begin in its range and reads on to the end of the last one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 8_000_000
QUOTE, ESCAPE = ord('"'), ord("\\")


def _opened(path):
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _range(f, start, end):
    """Bytes of a range, and whether an escape is open before its first byte."""
    back, before = 64, b""
    while start and (not before or before.count(b"\\") == len(before)) and len(before) < start:
        size = min(back, start)
        f.seek(start - size)
        before, back = f.read(size), back * 8
    f.seek(start)
    return f.read(end - start), (len(before) - len(before.rstrip(b"\\"))) % 2 == 1


def _structure(data, escaped):
    """(parity of quotes before each byte, change of depth at each byte as if outside strings)."""
    raw = np.frombuffer(data, np.uint8)
    quote = raw == QUOTE
    if escaped or (raw == ESCAPE).any():
        # a byte is escaped after an odd run of escapes
        at = np.arange(len(raw), dtype=np.int32)
        other = np.where(raw != ESCAPE, at, np.int32(-1))
        last = np.concatenate((np.array([-1], np.int32), np.maximum.accumulate(other)[:-1]))
        run = at - 1 - last + np.where(last == -1, np.int32(escaped), np.int32(0))
        quote = quote & (run % 2 == 0)
    seen = np.cumsum(quote, dtype=np.int32) - quote
    step = np.zeros(len(raw), np.int32)
    step[(raw == ord("{")) | (raw == ord("["))] = 1
    step[(raw == ord("}")) | (raw == ord("]"))] = -1
    return raw, seen % 2, int(quote.sum()) % 2, step


def _summaries(batches):
    """What each range does: for either state at its start the change of depth, and how many objects open at each relative depth."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            with _opened(r.path) as f:
                raw, inside, flips, step = _structure(*_range(f, r.start, r.end))
            for state in (0, 1):
                moves = np.where(inside == state, step, 0)
                depth = np.cumsum(moves, dtype=np.int32) - moves
                opens = Counter(depth[(moves == 1) & (raw == ord("{"))].tolist())
                rows.append((r.path, r.start, state, flips, int(moves.sum()), {int(k): int(n) for k, n in opens.items()}))
        yield pd.DataFrame(rows, columns=["path", "start", "state", "flips", "change", "opens"])


def _records(batches):
    """Texts of the records that begin in each range, numbered within their file."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            with _opened(r.path) as f:
                data, escaped = _range(f, r.start, r.end)
                raw, inside, _, step = _structure(data, escaped)
                moves = np.where(inside == r.state, step, 0)
                depth = r.depth + np.cumsum(moves, dtype=np.int32) - moves
                begins = np.flatnonzero((depth == 1) & (moves == 1) & (raw == ord("{")))
                if not len(begins):
                    continue
                ends = np.flatnonzero((depth + moves == 1) & (moves == -1)) + 1
                f.seek(r.end)
                # the last record may go on beyond the range
                while not len(ends) or ends[-1] <= begins[-1]:
                    more = f.read(1 << 20)
                    if not more:
                        raise ValueError(f"{r.path}: the array ends within a record")
                    data += more
                    raw, inside, _, step = _structure(data, escaped)
                    moves = np.where(inside == r.state, step, 0)
                    depth = r.depth + np.cumsum(moves, dtype=np.int32) - moves
                    ends = np.flatnonzero((depth + moves == 1) & (moves == -1)) + 1
            held, size = [], 0
            for k, (a, b) in enumerate(zip(begins, ends[np.searchsorted(ends, begins, side="right")])):
                held.append((r.path, r.first + k, data[a:b].decode("utf-8", "replace")))
                size += b - a
                if size >= 8_000_000:
                    yield pd.DataFrame(held, columns=["path", "position", "value"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["path", "position", "value"])


def array_records(spark: SparkSession, pattern: str, size: int = RANGE) -> DataFrame:
    """(path, position, value): the objects of the JSON arrays in files, as text, numbered from 0 in each file.

    An array of other things than objects has no records; objects within objects are part of theirs. A file that ends within a record is an error.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    spans = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(size))).alias("start"))
    spans = spans.select("path", "start", F.least("length", F.col("start") + size).alias("end"))
    # a number of its own: spans are tiny rows, and adaptive execution would put them into one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = spans.repartition(parts, "path", "start")
    told = spans.mapInPandas(_summaries, "path string, start long, state int, flips int, change int, opens map<int,int>")
    # a few numbers for each range
    what = {(r.path, r.start, r.state): r for r in told.collect()}
    begun, path, state, depth, first = [], None, 0, 0, 0
    for at, start in sorted({(p, s) for p, s, _ in what}):
        if at != path:
            path, state, depth, first = at, 0, 0, 0
        begun.append((path, start, state, depth, first))
        r = what[path, start, state]
        first += r.opens.get(1 - depth, 0)
        state, depth = state ^ r.flips, depth + r.change
    known = spark.createDataFrame(begun, "path string, start long, state int, depth int, first long")
    return spans.join(known, ["path", "start"]).repartition(parts, "path", "start").mapInPandas(_records, "path string, position long, value string")
