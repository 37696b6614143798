"""Best-fit packing of tokenized documents into sequences of a fixed length.

Bounded-space online best-fit: a packer keeps at most `open_bins` sequences open. Their free space is a bit in one integer,
so the tightest sequence that still takes a piece is the lowest set bit at or above its length. When one sequence too many is
open, the fullest closes. Every Spark task packs the documents of its own split as it reads them: no shuffle, and memory
bounded by the open sequences' free-space table and one block of pieces.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wane.llm.common import byte_blocks, runs

SCHEMA = "{id} {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"
#: Distinct words whose ids a Python worker remembers, over all its tasks. The memory is emptied when it is full; results do not
#: depend on it.
REMEMBERED_WORDS = 1_200_000
_known: dict[str, Words] = {}
#: Small letters that normalization leaves as they are.
_SMALL = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return dict(zip(visible, visible, strict=True)) | {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _stays_letter(c: str) -> bool:
    """Whether normalization keeps a character one letter; some become a letter and a mark, which then joins the marks that follow."""
    small = unicodedata.normalize("NFC", c.lower())
    return c.isalpha() and len(small) == 1 and small.isalpha()


def _known_rules(tokenizer_file: str) -> bool:
    """Whether a tokenizer file has the rules that `Words` relies on: composed characters, small letters, no blanks, letters apart from marks."""
    spec = json.loads(Path(tokenizer_file).read_text(encoding="utf-8"))
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [n["type"] for n in normal.get("normalizers", [])]
    cuts = [(p["type"], p.get("behavior"), p.get("invert"), p.get("use_regex")) for p in before.get("pretokenizers", [])]
    pattern = (before.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex", "")
    return (
        steps == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", "Removed", True, None), ("ByteLevel", None, None, False)]
        and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and spec["model"].get("end_of_word_suffix") == "</w>"
        and not spec.get("truncation") and not spec.get("padding") and not spec["model"].get("dropout"))


class Words:
    """Token ids of blank-separated pieces of text, computed once for each.

    The vocabulary's pre-tokenizer never joins characters across blanks and drops the blanks themselves. Marks after a letter
    are tokens of their own, and ASCII capitals count as small letters. A word of small letters is one unit of the vocabulary's
    merges, so it goes to them directly.
    """

    def __init__(self, tokenizer, by_words: bool = True):
        self.encode, self.known, self.merge, self.by_words = tokenizer.encode, {"": b""}, tokenizer.model.tokenize, by_words

    def learn(self, word: str) -> bytes:
        """Of a word that is not known as it stands; one that is made of known parts is put together each time."""
        known = self.known
        if word in known:
            return known[word]
        bare = word.rstrip(".,;:!?")
        if bare != word and bare and _stays_letter(bare[-1]):
            return (known.get(bare) or self.learn(bare)) + (known.get(mark := word[len(bare) :]) or self.learn(mark))
        if word.isascii() and word.isalpha() and not word.islower():
            small = word.lower()
            return known.get(small) or self.learn(small)
        if _SMALL.fullmatch(word):
            tokens = self.merge(word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS))
            ids = known[word] = array("I", [t.id for t in tokens]).tobytes()
        else:
            ids = known[word] = array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        return ids

    def of(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text. The words of all texts are numbered first, so that each different one is looked up once."""
        if not self.by_words:
            return [array("I", self.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts.to_pylist()]
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {"": b""}
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        get, learn = self.known.get, self.learn
        each = [get(w) or learn(w) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        ids, start = np.frombuffer(b"".join(each), np.uint32), np.cumsum(size) - size
        size = size[number]
        raw = memoryview(ids[runs(start[number], size)].tobytes())
        ends = np.concatenate(([0], np.cumsum(size)))[parts.offsets.to_numpy() - parts.offsets[0].as_py()] * 4
        return [bytes(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class OpenBins:
    """Free space of the open sequences: bit f of `bits` is set while some open sequence has f places left."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.n_open, self.made = capacity, most, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Number of the sequence that takes the piece, and the offset in it."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.by_space[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - space


def pack(
    docs: DataFrame, tokenizer_file: str, capacity: int = 2048, open_bins: int = 1024, block: int = 2000, end_id: int = 0,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit), sequence and offset.

    A document is its token ids followed by `end_id`. Only documents longer than `capacity` are cut, at its multiples.
    Blocks of `block` pieces are placed longest first. Sequence numbers are the partition's number and a count within it, so a
    repeated task gives the same rows. Null or empty texts are one piece of one id. Null ids and repeated rows are
    packed like others and keep their id. An empty table gives no rows. Other columns are left out.
    """
    schema = SCHEMA.format(id=f"`{id_column}`", kind=docs.schema[id_column].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        if tokenizer_file not in _known:
            _known[tokenizer_file] = Words(Tokenizer.from_file(tokenizer_file), _known_rules(tokenizer_file))
        words, bins = _known[tokenizer_file], OpenBins(capacity, open_bins)
        first = TaskContext.get().partitionId() << 36
        end, width = array("I", [end_id]).tobytes(), 4 * capacity
        kept: list[tuple] = []

        def placed(kind: pa.DataType) -> pa.RecordBatch:
            kept.sort(key=lambda x: -len(x[3]))
            where = [bins.place(len(x[3]) // 4) for x in kept]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in kept], kind), pa.array([x[1] for x in kept], pa.int32()),
                    pa.array([x[2] for x in kept], pa.int64()), pa.array([len(x[3]) // 4 for x in kept], pa.int64()),
                    pa.array([x[3] for x in kept], pa.binary()), pa.array([first + n for n, _ in where], pa.int64()),
                    pa.array([o for _, o in where], pa.int64()),
                ],
                names=[id_column, "piece", "start", "length", "ids", "sequence_id", "offset"],
            )
            kept.clear()
            return out

        kind = pa.int64()
        for batch in byte_blocks(batches, text_column, 16_000_000):
            kind = batch.schema.field(0).type
            for doc, ids in zip(batch[0].to_pylist(), words.of(batch[1]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    kept.append((doc, k, k * capacity, ids[at : at + width]))
                    if len(kept) >= block:
                        yield placed(kind)
        if kept:
            yield placed(kind)

    return docs.select(id_column, text_column).mapInArrow(run, schema)
