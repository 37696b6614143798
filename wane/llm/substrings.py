"""Removal of byte strings that occurred earlier in the corpus, with suffix arrays.

Every window of `length` bytes has an anchor, its smallest hashed k-mer; equal windows have equal anchors. Consecutive windows with
one anchor form a cell. Cells are dealt by anchor: later cells of equal content are repeats as a whole, anchors with one cell
are done, and only cells that share an anchor but differ need their windows compared. Those go, some anchors at a time, to suffix
arrays; the windows of an anchor with very many different cells (the edge of a passage that many documents share) are
grouped by their own digests instead, so that no anchor has to fit in one task. These are dealt by a second anchor, so that neighbours
stay together, and those of a second anchor with very many windows also by their digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wane.llm.common import BASE, MIX1, byte_blocks, mixed, stored
from wane.llm.suffixes import suffix_arrays
from wane.operators.ranking import positions

#: Bytes of an anchor's k-mer. Windows shorter than this are their own anchor.
ANCHOR_BYTES = 20
_SECOND = np.uint64(0xA24BAED4963EE407)


def rolled(data: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Mixed polynomial hash of every run of `size` bytes."""
    with np.errstate(over="ignore"):
        whole, power, have = data.astype(np.uint64) + np.uint64(1), base, 1
        value, got = None, 0
        while True:
            if size & have:
                if value is None:
                    value, got = whole, have
                else:
                    n = len(whole) - got
                    # The part had so far, then the next `have` bytes.
                    value = value[:n] * power + whole[got : got + n] if n > 0 else np.empty(0, np.uint64)
                    got += have
            if have * 2 > size:
                break
            n = len(whole) - have
            whole = whole[:n] * power + whole[have : have + n] if n > 0 else np.empty(0, np.uint64)
            power, have = power * power, have * 2
    return mixed(value[: max(0, len(data) - size + 1)])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    n, m, s = len(h) - width + 1, h, 1
    while s * 2 <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[:n], m[width - s : width - s + n])


def cells_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content digest, first window and number of windows of each cell of one text."""
    if len(data) < length:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    k = min(ANCHOR_BYTES, length)
    h = rolled(data, k, BASE)
    anchor = _least(h, length - k + 1)
    # A cell also ends where its anchor leaves the window, so an anchor stands once in a cell.
    cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (h[: len(anchor) - 1] == anchor[:-1])) + 1
    first = np.concatenate(([0], cuts))
    windows = np.diff(np.append(first, len(anchor)))
    # Order-sensitive sums over the k-mers of a cell: each is weighted by a power of its place, undone by the inverse power.
    with np.errstate(over="ignore"):
        last = first + windows + length - k - 1
        weight = np.multiply.accumulate(np.full(len(h), MIX1, np.uint64))
        total = np.concatenate(([np.uint64(0)], np.cumsum(h * weight, dtype=np.uint64)))
        undo = np.multiply.accumulate(np.full(len(h), np.uint64(pow(int(MIX1), -1, 1 << 64)), np.uint64))
        content = mixed((total[last + 1] - total[first]) * undo[first] + windows.astype(np.uint64) * BASE)
    return anchor[first], content, first, windows


def repeated_windows(cells: list[bytes], length: int, of: np.ndarray) -> np.ndarray:
    """For the windows of all cells in turn: whether the same bytes begin earlier in a cell with the same number in `of`.

    Cells with one number are neighbours and make one text for the suffix arrays; windows never reach into the next cell.
    """
    size = np.array([len(c) for c in cells], np.int64)
    cut = np.flatnonzero(np.diff(of)) + 1
    last = np.zeros(len(cells), bool)
    last[np.append(cut - 1, len(cells) - 1)] = True
    # Bytes as 2 to 257, 1 after each cell, 0 after each text.
    tail = np.where(last, 2, 1)
    at = np.cumsum(size + tail) - size - tail
    text = np.ones(int((size + tail).sum()), np.int64)
    where = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
    raw = np.frombuffer(b"".join(cells), np.uint8)
    text[where] = raw.astype(np.int64) + 2
    text[(at + size + 1)[last]] = 0
    starts = np.append(at[np.concatenate(([0], cut)).astype(np.int64)], len(text))
    order = suffix_arrays(text, starts)
    number = np.full(len(text), -1, np.int64)  # of the window that begins here
    n = np.maximum(size - length + 1, 0)
    begin = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
    number[begin] = np.arange(len(begin))
    owner = np.repeat(of, n)
    order = order[number[order] >= 0]
    rows = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), length)
    ident = number[order]
    equal = np.zeros(len(order), bool)
    for a in range(1, len(order), 20_000):
        b = min(len(order), a + 20_000)
        equal[a:b] = (rows[order[a:b]] == rows[order[a - 1 : b - 1]]).all(axis=1)
    equal[1:] &= owner[ident[1:]] == owner[ident[:-1]]
    run = np.cumsum(~equal) - 1
    earliest = np.full(run[-1] + 1 if len(run) else 0, len(begin), np.int64)
    np.minimum.at(earliest, run, ident)
    out = np.zeros(len(begin), bool)
    out[ident] = ident > earliest[run]
    return out


def _spans(repeat: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of the bytes that repeated windows cover; window 0 begins at `first`."""
    edge = np.diff(np.concatenate(([0], repeat.view(np.int8), [0])))
    return [(first + int(a), first + int(b) - 1 + length) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _pack(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize * n for k in kinds]
    data, out, at = pa.decompress(raw, decompressed_size=sum(sizes), codec="zstd", asbytes=True), [], 0
    for k, s in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(data, k, n, at))
        at += s
    return out


_CELL = ("<u8", "<u8", "<i8", "<i8", "<i4")  # anchor, content, document, first window, windows


def _dealt_cells(docs: DataFrame, length: int, shards: int, block_bytes: int) -> DataFrame:
    """Packed cells of blocks of documents, by shard of their anchors. Equal cells of a block are sent once, its earliest;
    the block's other cells of that content are repeats already and go along as spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turn = TaskContext.get().partitionId()

        def dealt() -> pa.RecordBatch:
            nonlocal turn
            doc = np.concatenate([np.full(len(h[1][0]), h[0], np.int64) for h in held])
            anchor, content, first, windows = (np.concatenate([h[1][i] for h in held]) for i in range(4))
            held.clear()
            order = np.lexsort((first, doc, content, anchor))
            anchor, content, first, windows, doc = anchor[order], content[order], first[order], windows[order], doc[order]
            again = np.zeros(len(doc), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1]) & (windows[1:] == windows[:-1])
            turn += 1
            rows = [(turn % shards, 1, int(again.sum()), _pack(doc[again], first[again], windows[again].astype(np.int32)))] if again.any() else []
            anchor, content, first, windows, doc = (x[~again] for x in (anchor, content, first, windows, doc))
            shard = ((anchor >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((first, doc, shard))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards):
                at = order[cuts[s] : cuts[s + 1]]
                if len(at):
                    rows.append((s, 0, len(at), _pack(anchor[at], content[at], doc[at], first[at], windows[at].astype(np.int32))))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["shard", "kind", "n", "packed"])

        size = 0
        for block in byte_blocks(batches, "text", 1_000_000):
            for d, t in zip(block["doc"].to_pylist(), block["text"].to_pylist(), strict=True):
                raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
                if len(raw) >= length:
                    held.append((d, cells_of(raw, length)))
                    size += len(raw)
            if size >= block_bytes:
                yield dealt()
                size = 0
        if held:
            yield dealt()

    return docs.mapInArrow(run, "shard int, kind int, n int, packed binary")


def _judged(dealt: DataFrame, most_cells: int) -> DataFrame:
    """What is known of cells from anchors and contents: kind 1 repeats as a whole; kind 2 must be compared with the other cells
    of its anchor; kind 3 the same for an anchor with more than `most_cells` different ones."""
    schema = "kind int, anchor long, cells int, doc long, first long, windows int"

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, raw in zip(pdf["n"][pdf["kind"] == 1], pdf["packed"][pdf["kind"] == 1], strict=True):
            doc, first, windows = _unpack(raw, n, *_CELL[2:])
            out.append(pd.DataFrame({"kind": 1, "anchor": 0, "cells": 0, "doc": doc, "first": first, "windows": windows}))
        parts = [_unpack(raw, n, *_CELL) for n, raw in zip(pdf["n"][pdf["kind"] == 0], pdf["packed"][pdf["kind"] == 0], strict=True)]
        if parts:
            anchor, content, doc, first, windows = (np.concatenate([p[i] for p in parts]) for i in range(5))
            order = np.argsort(anchor, kind="stable")
            same = anchor[order][1:] == anchor[order][:-1]
            two = np.zeros(len(order), bool)
            two[1:] |= same
            two[:-1] |= same
            order = order[two]  # anchors that occur twice or more
            anchor, content, doc, first, windows = (x[order] for x in (anchor, content, doc, first, windows))
            order = np.lexsort((first, doc, windows, content, anchor))
            anchor, content, doc, first, windows = (x[order] for x in (anchor, content, doc, first, windows))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (windows[1:] != windows[:-1])
            _, back, different = np.unique(anchor[fresh], return_inverse=True, return_counts=True)
            kind, cells = np.ones(len(order), np.int32), np.zeros(len(order), np.int32)
            cells[fresh] = different[back]
            kind[fresh] = np.select([different[back] > most_cells, different[back] > 1], [3, 2], 0)
            keep = kind > 0
            out.append(pd.DataFrame({"kind": kind[keep], "anchor": anchor[keep].view(np.int64), "cells": cells[keep], "doc": doc[keep], "first": first[keep], "windows": windows[keep]}))
        names = ["kind", "anchor", "cells", "doc", "first", "windows"]
        return pd.concat(out)[names] if out else pd.DataFrame({c: [] for c in names})

    return dealt.groupBy("shard").applyInPandas(judge, schema)


def _earliest(one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple]]:
    """Of windows with equal digests: the numbers of the earliest, and (document, start, end) spans of the others."""
    order = np.lexsort((start, doc, two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    late = order[~fresh]
    late = late[np.lexsort((start[late], doc[late]))]
    cut = np.ones(len(late), bool)
    cut[1:] = (doc[late][1:] != doc[late][:-1]) | (start[late][1:] != start[late][:-1] + 1)
    at = np.flatnonzero(cut)
    last = np.append(at[1:], len(late)) - 1
    return order[fresh], list(zip(doc[late[at]].tolist(), start[late[at]].tolist(), (start[late[last]] + length).tolist(), strict=True)) if len(late) else []


_WINDOW = ("<u8", "<u8", "<i8", "<i8", "<u8")  # both digests, document, first byte, second anchor


def _fetched(docs: DataFrame, asked: DataFrame, length: int, shards: int, most_windows: int = 150_000) -> DataFrame:
    """Bytes of the cells asked for (kind 2), and packed digests of windows by their shard (kind 3: `anchor` is the shard and `cells`
    their number). Of equal windows that a task has together only the earliest is packed, the others are spans at once (kind 4:
    `first` to `end`)."""
    schema = "kind int, anchor long, cells int, doc long, first long, end long, cell binary"
    names = ["kind", "anchor", "cells", "doc", "first", "end", "cell"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("first", "windows", "kind", "anchor", F.col("cells").alias("of"))).alias("cells"))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def reduced() -> pa.RecordBatch:
            one, two, doc, start, by = (np.concatenate([h[i] for h in held]) for i in range(5))
            held.clear()
            at, spans = _earliest(one, two, doc, start, length)
            rows = [(4, None, None, *x, None) for x in spans]
            shard = ((by[at] >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
            at = at[np.lexsort((start[at], doc[at], shard))]
            cuts = np.searchsorted(np.sort(shard), np.arange(shards + 1))
            for s in range(shards):
                own = at[cuts[s] : cuts[s + 1]]
                if len(own):
                    rows.append((3, s, len(own), None, None, None, _pack(one[own], two[own], doc[own], start[own], by[own])))
            return batch_of(rows)

        many = 0
        for block in byte_blocks(batches, "text", 1_000_000):
            out: list[tuple] = []
            for doc, text, cells in zip(block["doc"].to_pylist(), block["text"].to_pylist(), block["cells"].to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for c in cells:
                    piece, n = raw[c["first"] : c["first"] + c["windows"] + length - 1], c["windows"]
                    if c["kind"] == 2:
                        out.append((2, c["anchor"], c["of"], doc, c["first"], None, piece))
                    else:
                        data = np.frombuffer(piece, np.uint8)
                        # Equal windows have equal second anchors, and neighbours mostly too: spans stay whole within a shard.
                        k = min(ANCHOR_BYTES, length)
                        by = _least(rolled(data, k, _SECOND), length - k + 1)
                        held.append((rolled(data, length, BASE), rolled(data, length, _SECOND), np.full(n, doc, np.int64), np.arange(c["first"], c["first"] + n), by))
                        many += n
            yield batch_of(out)
            if many >= most_windows:
                yield reduced()
                many = 0
        if held:
            yield reduced()

    return docs.join(wanted, "doc").select("doc", "text", "cells").mapInArrow(run, schema)


def _heavy(windows: DataFrame, most: int) -> dict[int, int]:
    """Second anchors of more than `most` windows, and into how many parts each is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, raw in zip(batch["n"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                by, count = np.unique(_unpack(raw, n, *_WINDOW)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(by.view(np.int64)), pa.array(count.astype(np.int64))], names=["by", "n"])

    counts = windows.select("n", "packed").mapInArrow(run, "by long, n long").groupBy("by").agg(F.sum("n").alias("n"))
    return {r["by"]: -(-r["n"] // most) for r in counts.filter(F.col("n") > most).collect()}


def _parted(windows: DataFrame, heavy: dict[int, int]) -> DataFrame:
    """The windows by shard and part: 0, and for those of heavy second anchors one by their own digest, so that equal ones still meet."""
    anchors = np.array(sorted(heavy), np.int64)
    parts = np.array([heavy[a] for a in anchors.tolist()], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, raw in zip(*(batch[c].to_pylist() for c in ("shard", "n", "packed")), strict=True):
                window = _unpack(raw, n, *_WINDOW)
                by = window[4].view(np.int64)
                at = np.minimum(np.searchsorted(anchors, by), len(anchors) - 1)
                # Anchors of one shard have parts of their own.
                part = np.where(anchors[at] == by, 1 + (mixed(window[0] ^ window[4]) % parts[at] + mixed(window[4]) % np.uint64(2**40)).astype(np.int64), 0)
                order = np.argsort(part, kind="stable")
                cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), n)
                rows = [(part[order[a]], b - a, _pack(*(w[order[a:b]] for w in window))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), *(pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary())))], names=["shard", "part", "n", "packed"])

    return windows.select("shard", "n", "packed").mapInArrow(run, "shard long, part long, n int, packed binary")


def _late_windows(windows: DataFrame, length: int, most: int = 500_000) -> DataFrame:
    """Spans of all but the earliest of equal windows; neighbours in different parts are spans of their own. windows: packed rows (shard, n, packed)."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(raw, n, *_WINDOW) for n, raw in zip(pdf["n"], pdf["packed"], strict=True)]
        _, spans = _earliest(*(np.concatenate([p[i] for p in parts]) for i in range(4)), length)
        return pd.DataFrame(spans, columns=["doc", "start", "end"]).astype(np.int64)

    heavy = _heavy(windows, most)
    dealt = _parted(windows, heavy) if heavy else windows.withColumn("part", F.lit(0).cast("long"))
    return dealt.groupBy("shard", "part").applyInPandas(judge, "doc long, start long, end long")


def _compared(cells: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """Spans of repeated windows among cells that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(rows: list[tuple]) -> pa.RecordBatch:
            _, number, count = np.unique([r[0] for r in rows], return_inverse=True, return_counts=True)
            by = np.lexsort((np.arange(len(rows)), number, count[number]))
            rows, of = [rows[i] for i in by], number[by]
            repeat = repeated_windows([r[3] for r in rows], length, of)
            out, at = [], 0
            for _, doc, first, cell in rows:
                n = len(cell) - length + 1
                out += [(doc, a, b) for a, b in _spans(repeat[at : at + n], first, length)]
                at += n
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["doc", "start", "end"])

        size = 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "doc", "first", "cell")), strict=True):
                if size >= batch_bytes and held[-1][0] != row[0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield found(held)

    # Anchors with like numbers of cells come together: texts of like length take like numbers of steps.
    dealt = cells.repartition("anchor").sortWithinPartitions("cells", "anchor", "doc", "first")
    return dealt.select("anchor", "doc", "first", "cell").mapInArrow(run, "doc long, start long, end long")


def remove_repeats(
    docs: DataFrame, length: int = 100, most_cells: int = 32, shards: int | None = None, block_bytes: int = 24_000_000, most_windows: int = 500_000,
    id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n_bytes, spans, kept, kept_text, rest) of every row: the maximal removed runs of bytes and the bytes left, concatenated.

    kept_text is those bytes as text without what a cut has left of a character. rest is a struct of the columns in `carry`.
    A byte is removed if a string of `length` bytes that covers it also begins earlier: in a row of a smaller id or before in the same
    text. Strings are judged on the input. Ids are integers; if some are null or repeat, rows are ordered by id (nulls last), then
    text. Null texts are empty. Texts shorter than `length` stay as they are. An empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    shards = shards or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(0)
    plain = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    plain_ids = plain.agg(F.count("id").alias("known"), F.count(F.lit(1)).alias("all")).first()
    if plain_ids["known"] == plain_ids["all"] and not plain.groupBy("id").count().filter("count > 1").limit(1).count():
        numbered = plain.withColumn("doc", F.col("id").cast("long"))
    else:  # stored, so that equal rows keep their places
        order = [F.col("id").isNull(), F.col("id"), F.col("text"), F.col("turn")]
        turned = stored(plain.withColumn("turn", F.monotonically_increasing_id()), "substrings-rows")
        bucket = F.coalesce(F.shiftright(F.col("id").cast("long"), 12), F.lit(2**62))
        numbered = stored(positions(turned, [], order, bucket, out="doc").drop("turn"), "substrings-rows")
    known = numbered.select("doc", "text")

    judged = stored(_judged(_dealt_cells(known, length, shards, block_bytes), most_cells), "substrings-cells")
    whole = judged.filter("kind = 1").select("doc", F.col("first").alias("start"), (F.col("first") + F.col("windows") + length - 1).alias("end"))
    asked = judged.filter("kind > 1")
    fetched = stored(_fetched(known, asked, length, shards), "substrings-texts")
    compared = _compared(fetched.filter("kind = 2"), length, 700_000)
    single = _late_windows(fetched.filter("kind = 3").select(F.col("anchor").alias("shard"), F.col("cells").alias("n"), F.col("cell").alias("packed")), length, most_windows)
    early = fetched.filter("kind = 4").select("doc", F.col("first").alias("start"), "end")
    spans = whole.union(compared).union(single).union(early).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for block in byte_blocks(batches, "text", 1_500_000):
            sizes, merged, kept = [], [], []
            for text, found in zip(block["text"].to_pylist(), block["found"].to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                for s in sorted((f["start"], f["end"]) for f in found or []):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                sizes.append(len(raw))
                merged.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)], strict=True)))
            texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            columns = [block["id"], pa.array(sizes, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary()), texts, block["rest"]]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_bytes", "spans", "kept", "kept_text", "rest"])

    id_kind = docs.schema[id_column].dataType.simpleString()
    rows = numbered.join(spans, "doc", "left").select("id", "text", "found", "rest")
    rest_kind = rows.schema["rest"].dataType.simpleString()
    return rows.mapInArrow(cut, f"`{id_column}` {id_kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_text string, rest {rest_kind}")
