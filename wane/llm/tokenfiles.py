"""Token ids of documents in compressed files: written in ascending document order, read back in parallel.

A folder holds three tables. `table`: one frequency table for all blocks, learned from all documents. `blocks`: each row is one
block of about 65,536 ids with its own checksums and checkpoints (see `rans`), the documents it holds and their lengths.
`files`: for each file (a range of documents) the number of ids in the files before it. A document with more ids than a block
has blocks of its own, so that all others are read without bringing pieces together.
"""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wane.llm import rans
from wane.llm.common import byte_blocks, runs, stored

#: Ids of a block, and blocks that a task encodes or decodes side by side.
BLOCK, ABREAST = 65_536, 32
#: Different words whose ids a worker remembers; emptied when full, without effect on results.
REMEMBERED = 1_500_000
#: White space beside other white space or at an edge, rare white space, or the mark of a text's first word.
_UNUSUAL = "[ \n][ \n]|^[ \n]|[ \n]$|[\\t\\v\\f\\r\\x00\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_FIRST = "\x00"
#: Runs of letters, digits or marks that the vocabulary's pattern never joins. Words with an apostrophe, other letters or signs have none.
_UNIT = re.compile("[A-Za-zÀ-ÖØ-öø-ɏа-яА-Яα-ω]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: visible ones themselves, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(hidden)) for b in range(256)}


_SHOWN = _byte_letters()
_BLANK = _SHOWN[32]


class ByteWords:
    """Ids of texts by a tokenizer file, as its library gives them.

    A byte-level vocabulary without normalizer cuts a text before each lone blank or line end, so equal words have equal ids and
    each different one is encoded once. Texts with other white space or special tokens, and all texts of other kinds
    of vocabularies, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        before = spec.get("pre_tokenizer") or {}
        self.by_words = (
            spec["model"].get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space") and before.get("use_regex", True)
            and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding"))
        self.unusual = "|".join([_UNUSUAL, *(re.escape(t["content"]) for t in spec.get("added_tokens") or [])])
        self.known, self.merge = {}, self.tokenizer.model.tokenize

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, part: str) -> bytes:
        """Of a word with what stands before it. Runs of letters, digits and marks are units of the vocabulary's pattern; they are
        remembered and go to its merges directly. Words with other characters are encoded by the library and remembered too."""
        if part.isascii() and part.isalpha():
            ids = self.known[part] = array("I", [t.id for t in self.merge(_BLANK + part)]).tobytes()
            return ids
        before, word = (part[0], part[1:]) if part[0] in (_FIRST, "\n") else (" ", part)
        units = _UNIT.findall(word)
        if sum(map(len, units)) < len(word) or not word:
            ids = self.known[part] = self.whole(word if before == _FIRST else before + word)
            return ids
        if before == " ":
            units[0] = " " + units[0]
        return b"".join([self.known.get(_FIRST + u) or self._merged(u) for u in (["\n", *units] if before == "\n" else units)])

    def _merged(self, unit: str) -> bytes:
        shown = unit.encode().decode("latin-1").translate(_SHOWN)
        ids = self.known[_FIRST + unit] = array("I", [t.id for t in self.merge(shown)]).tobytes()
        return ids

    def of(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, null as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return [self.whole(t) for t in texts.to_pylist()]
        if len(self.known) > REMEMBERED:
            self.known, self.merge = {}, self.tokenizer.model.tokenize
        odd = pc.or_(pc.match_substring_regex(texts, self.unusual), pc.equal(texts, ""))
        usual = pc.if_else(odd, "", texts)
        parts = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_FIRST, usual, ""), "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        get, learn = self.known.get, self.learn
        each = [get(w) or learn(w) if w != _FIRST else b"" for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        ids, start = np.frombuffer(b"".join(each), np.uint32), np.cumsum(size) - size
        size = size[number]
        raw = memoryview(ids[runs(start[number], size)].tobytes())
        ends = np.concatenate(([0], np.cumsum(size)))[parts.offsets.to_numpy() - parts.offsets[0].as_py()] * 4
        out = [bytes(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self.whole(texts[k].as_py())
        return out


def words_of(path: str) -> ByteWords:
    """A worker's tokenizer for a file. It is kept in a module of the process, not in this one: code comes with each task anew."""
    held = vars(sys.modules.setdefault("wane_worker", types.ModuleType("wane_worker")))
    return held.get(path) or held.setdefault(path, ByteWords(path))


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n, ids): ids of each row's text and the end id, two bytes each where the vocabulary has at most 65,536, else four."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer_file)
        narrow, end = _narrow(words.size), array("I", [end_id]).tobytes()
        for batch in byte_blocks(batches, text_column, 8_000_000):
            rows = [raw + end for raw in words.of(batch[1])]
            sizes = pa.array([len(r) // 4 for r in rows], pa.int64())
            ids = [np.frombuffer(r, np.uint32).astype(narrow).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch[0], sizes, pa.array(ids, pa.binary())], names=[id_column, "n", "ids"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n long, ids binary")


def _narrow(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _counts(ids: DataFrame, narrow: str) -> DataFrame:
    """(id, count) over all rows: a sum for each task first, then one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch[0]:
                more = np.bincount(np.frombuffer(raw.as_buffer(), narrow))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks_of(docs: Iterator[tuple], narrow: str) -> Iterator[tuple]:
    """(split, first, begins, ids, documents, lengths) from (document, ids) in order; places count from the file's first id."""
    at, held, size = 0, [], 0
    for doc, raw in docs:
        ids = np.frombuffer(raw, narrow)
        if held and size + len(ids) > BLOCK:
            yield False, at - size, at - size, np.concatenate([h[1] for h in held]), [h[0] for h in held], [len(h[1]) for h in held]
            held, size = [], 0
        if len(ids) > BLOCK:
            for k in range(0, len(ids), BLOCK):
                piece = ids[k : k + BLOCK]
                yield True, at + k, at, piece, [doc], [len(piece)]
        else:
            held.append((doc, ids))
            size += len(ids)
        at += len(ids)
    if held:
        yield False, at - size, at - size, np.concatenate([h[1] for h in held]), [h[0] for h in held], [len(h[1]) for h in held]


def write_tokens(
    docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = 2, ids_per_file: int = 8_000_000, id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write the ids of all documents below `folder`, in ascending order of their id (null first; rows that share an id in the order
    of the scan). A null text is empty and has the end id alone. An empty table writes empty tables. Other columns are left out.

    The texts are read once. Ids are stored once before they are counted and dealt by ranges of documents, with the row's number as
    second key, so rows of one repeated id spread over files.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = _narrow(ByteWords(tokenizer_file).size)
    ids = stored(tokenize(docs, tokenizer_file, end_id, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    # At most one row for each id of the vocabulary.
    counts = {r["id"]: r["n"] for r in _counts(ids, narrow).collect()}
    table = rans.scaled([counts.get(k, 0) for k in range(max(counts, default=0) + 1)])
    spark.createDataFrame([(k, int(f)) for k, f in enumerate(table) if f], "id long, frequency long").coalesce(1).write.parquet(f"{folder}/table")
    schema = f"file int, block int, split boolean, first long, begins long, n_ids int, documents array<{kind}>, lengths array<int>, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, made, kept, of = rans.Coder(table), TaskContext.get().partitionId(), 0, [], None

        def rows() -> Iterator[tuple]:
            nonlocal of
            for batch in batches:
                of = batch.schema.field(0).type
                yield from zip(batch[0].to_pylist(), (x.as_buffer() for x in batch[1]), strict=True)

        def packed() -> pa.RecordBatch:
            nonlocal made
            payload = coder.encode([k[3] for k in kept])
            columns = [
                pa.array([file] * len(kept), pa.int32()), pa.array(range(made, made + len(kept)), pa.int32()), pa.array([k[0] for k in kept]),
                pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()),
                pa.array([len(k[3]) for k in kept], pa.int32()), pa.array([k[4] for k in kept], pa.list_(of)),
                pa.array([k[5] for k in kept], pa.list_(pa.int32())), pa.array(payload, pa.binary())]
            made += len(kept)
            kept.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "split", "first", "begins", "n_ids", "documents", "lengths", "payload"])

        for block in _blocks_of(rows(), narrow):
            kept.append(block)
            if len(kept) == ABREAST:
                yield packed()
        if kept:
            yield packed()

    files = max(1, -(-sum(counts.values()) // ids_per_file))
    dealt = ids.repartitionByRange(files, F.col(id_column).asc_nulls_first(), "row").sortWithinPartitions(F.col(id_column).asc_nulls_first(), "row")
    dealt.select(id_column, "ids").mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    # A number for each file.
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()
    ends = np.cumsum([0, *(r["n"] for r in sizes)]).tolist()
    spark.createDataFrame([(r["file"], at) for r, at in zip(sizes, ends, strict=False)], "file int, before long").coalesce(1).write.parquet(f"{folder}/files")


def read_tokens(spark: SparkSession, folder: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document written below `folder`: `start` counts the ids of all documents before it, `ids` are
    little-endian unsigned 32-bit. Every block is decoded once, whichever task has it; a checksum that does not hold is an error."""
    # Bounded by the vocabulary.
    table = spark.read.parquet(f"{folder}/table").collect()
    frequency = np.zeros(max((r["id"] for r in table), default=0) + 1, np.int64)
    for r in table:
        frequency[r["id"]] = r["frequency"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["documents"].dataType.elementType.simpleString()
    schema = f"`{id_column}` {kind}, file int, begins long, at long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(frequency)
        for whole in byte_blocks(batches, "payload", 4_000_000):
            for k in range(0, whole.num_rows, ABREAST):
                batch = whole.slice(k, ABREAST)
                decoded = coder.decode(batch["payload"].to_pylist())
                lengths = batch["lengths"].flatten().to_numpy().astype(np.int64)
                each = np.diff(batch["lengths"].offsets.to_numpy())
                place = np.concatenate([np.cumsum(n) - n for n in np.split(lengths, np.cumsum(each)[:-1])])
                ends = np.concatenate(([0], np.cumsum(lengths * 4)))
                raw = pa.py_buffer(np.concatenate(decoded).astype("<u4").tobytes())
                first, begins = (np.repeat(batch[c].to_numpy(), each) for c in ("first", "begins"))
                split = np.repeat(batch["split"].to_numpy(zero_copy_only=False), each)
                ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["documents"].flatten(), pa.array(np.repeat(batch["file"].to_numpy(), each)), pa.array(np.where(split, begins, first + place)),
                        pa.array(first + place), pa.array(lengths), ids,
                    ],
                    names=[id_column, "file", "begins", "at", "n_tokens", "ids"],
                )

    def join(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("at")
        whole = b"".join(pieces["ids"].to_pylist())
        return pieces.slice(0, 1).set_column(5, "ids", pa.array([whole], pa.binary())).set_column(4, "n_tokens", pa.array([len(whole) // 4], pa.int64()))

    columns = ["file", "split", "first", "begins", "documents", "lengths", "payload"]
    whole = blocks.filter("not split").select(columns).mapInArrow(run, schema)
    # The pieces of one document, which its own text bounds.
    parts = blocks.filter("split").select(columns).mapInArrow(run, schema).groupBy("file", "begins").applyInArrow(join, schema)
    files = spark.read.parquet(f"{folder}/files")
    return whole.union(parts).join(files, "file").select(id_column, (F.col("before") + F.col("begins")).alias("start"), "n_tokens", "ids")

