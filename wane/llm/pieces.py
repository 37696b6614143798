"""Encoding texts as vocabulary pieces, and back, with a relational lattice.

Texts are cut into words that no piece crosses. The distinct words of the corpus are exploded into their substrings of up to the
longest piece's length and equi-joined with the piece table; the matches, grouped by word, are its lattice. The segmentation is chosen
along the lattice: by `best_path` (Viterbi, the largest sum of scores) for vocabularies trained as word lists, by `merge_edges` for
those trained by pair merging, where the library's own result is the sequence of merges and not the best sum.

Blocks of documents are stored as numbers of a block's own distinct words, so words travel once for each block.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wane.llm.common import byte_blocks, discard, give_back, runs, stored, stored_apart

SPACE = "▁"
#: Blanks stay with the word after them; a line end is a word. Where no piece mixes them, runs of letters, of ASCII digits and of
#: other characters are words of their own, which makes far fewer different words.
_LETTER = r"[^\W\d_²³¹¼-¾]"
_COARSE = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_FINE = re.compile(rf"{SPACE}*(?:{_LETTER}+|[0-9]+|(?:[^\w\n{SPACE}]|[_²³¹¼-¾]|(?![0-9])\d)+)|{SPACE}+|\n")
#: Words of more characters are merged with a queue, without a lattice.
LONG_WORD = 48


class Vocabulary:
    """Pieces of a model file, with their scores and the numbers of the 256 byte pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.bytes = [i for i in range(n) if model.is_byte(i)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)} | set(self.bytes)
        self.plain = {self.texts[i]: (i, float(model.get_score(i))) for i in range(n) if i not in special}
        self.longest = max(map(len, self.plain))
        if any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", t) for t in self.plain) or len(self.bytes) != 256:
            raise ValueError("pieces that cross words, or no byte pieces")
        self.word = _FINE if all(_FINE.fullmatch(t) for t in self.plain) else _COARSE
        self.rank = {s: k for k, s in enumerate(sorted({s for _, s in self.plain.values()}))}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, s, self.rank[s]) for t, (i, s) in self.plain.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double, rank int")


def lattice(words: DataFrame, vocabulary: Vocabulary, edge: Column, parts: int, most: int = 0) -> DataFrame:
    """(word, edges): for each distinct word the list of `edge`, an expression over (start, length, id, score, rank).

    The piece table is as large as the vocabulary file and is broadcast. Exploding and joining keep the words' partitioning, so the
    edges are grouped where they are; a number in front of the word makes that sort cheap. Words without a match have no edges.
    A word is many rows here, so words are dealt to more partitions (`parts`) than their own size asks for: no sort spills. Words of
    more than `most` characters are one row.
    """
    size = F.char_length("word")
    if most:
        size = F.when(size <= most, size).otherwise(1)
    at = words.withColumn("h", F.xxhash64("word")).repartition(parts, "h", "word").select("h", "word", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    cut = at.select("h", "word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), size - F.col("start")))).alias("length"))
    cut = cut.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("length")))
    first = (F.col("start") == 0) & (F.col("length") == 1)
    edges = cut.join(F.broadcast(vocabulary.table(words.sparkSession)), "piece", "left").filter(F.col("id").isNotNull() | first)
    edges = edges.select("h", "word", F.when(F.col("id").isNotNull(), edge).alias("edge"))
    return edges.groupBy("h", "word").agg(F.collect_list("edge").alias("edges")).select("word", "edges")


def _key(start: Column, length: Column) -> Column:
    return start * 64 + length


def packed_edge() -> Column:
    """An edge as one number: its key, the rank of its score among all scores, its piece."""
    return _key(F.col("start"), F.col("length")).cast("long") * 2**42 + F.col("rank").cast("long") * 2**21 + F.col("id")


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merge_edges(size: int, edges: list[int]) -> tuple[list[int], dict[int, int]]:
    """Ends of a word's pieces after merging, again and again, the neighbours whose joint piece has the highest score, the leftmost first;
    and the piece of each key. edges: `packed_edge` of each edge; size: the word's characters."""
    rank = {e >> 42: e >> 21 & (1 << 21) - 1 for e in edges}
    joint = lambda a, b: rank.get(a * 64 + b - a, -1)
    cuts = list(range(size + 1))
    joints = [joint(i, i + 2) for i in range(size - 1)]  # of the pieces at i and i + 1
    while joints and (best := max(joints)) >= 0:
        i = joints.index(best)
        del cuts[i + 1], joints[i]
        if i:
            joints[i - 1] = joint(cuts[i - 1], cuts[i + 1])
        if i < len(joints):
            joints[i] = joint(cuts[i], cuts[i + 2])
    return cuts, {e >> 42: e & (1 << 21) - 1 for e in edges}


def scored(edges: Column) -> Column:
    """Score and piece of each edge struct by its key."""
    return F.map_from_entries(F.transform(edges, lambda e: F.struct(_key(e["start"], e["length"]), F.struct(e["score"].alias("score"), e["id"].alias("id")))))


def best_path(word: Column, known: Column, unknown: float = -100.0) -> Column:
    """Ends of the pieces with the largest sum of scores (Viterbi); a character without a piece counts `unknown`.

    The fold keeps the best (score, way) of every prefix. Of equal sums the one that sorts highest stays.
    """
    size = F.char_length(word)
    first = F.array(F.struct(F.lit(0.0).alias("sum"), F.array(F.lit(0)).alias("cuts")))

    def step(best: Column, end: Column) -> Column:
        ways = F.transform(
            F.sequence(F.lit(1), F.least(end, F.lit(63))),
            lambda n: F.struct(
                (F.get(best, end - n)["sum"] + F.coalesce(known[_key(end - n, n)]["score"], F.when(n == 1, F.lit(unknown)))).alias("sum"),
                F.concat(F.get(best, end - n)["cuts"], F.array(end)).alias("cuts"),
            ),
        )
        return F.concat(best, F.array(F.array_max(F.filter(ways, lambda w: w["sum"].isNotNull()))))

    return F.aggregate(F.sequence(F.lit(1), size), first, step, lambda best: F.element_at(best, -1)["cuts"])


def numbers_of(word: Column, cuts: Column, bytes_of: list[int], piece) -> Column:
    """Numbers of the pieces that end at `cuts`; piece(key) is a piece's number, and a character without one gives its bytes'."""
    numbers = F.array(*(F.lit(b) for b in bytes_of))

    def one(i: Column) -> Column:
        start, length = F.get(cuts, i - 1), F.get(cuts, i) - F.get(cuts, i - 1)
        raw = F.hex(F.substring(word, start + 1, length).cast("binary"))
        single = F.transform(F.sequence(F.lit(1), (F.length(raw) / 2).cast("int")), lambda k: F.get(numbers, F.conv(F.substring(raw, 2 * k - 1, F.lit(2)), 16, 10).cast("int")))
        return _bound(piece(_key(start, length)), lambda found: F.when(found.isNotNull(), F.array(found)).otherwise(single))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), one))


def merge_word(word: str, plain: dict[str, tuple[int, float]], bytes_of: list[int]) -> list[int]:
    """What merging along the lattice gives, with a queue: for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # of the symbol that begins here; 0 for none
    before = list(range(-1, n - 1))
    queue: list[tuple] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < n and (hit := plain.get(word[a : end[b]])):
            heapq.heappush(queue, (-hit[1], a, b, end[b]))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, a, b, stop = heapq.heappop(queue)
        if not end[a] or not end[b] or end[a] != b or end[b] != stop:
            continue
        end[a], end[b] = stop, 0
        if stop < n:
            before[stop] = a
            offer(a, stop)
        offer(before[a], a)
    out, at = [], 0
    while at < n:
        hit = plain.get(word[at : end[at]])
        out += [hit[0]] if hit else [bytes_of[b] for b in word[at : end[at]].encode("utf-8", "surrogatepass")]
        at = end[at]
    return out


def merged_words(words: DataFrame, vocabulary: Vocabulary, parts: int, shards: int = 0) -> DataFrame:
    """(word, ids array<int>) of distinct words by merging along the lattice. Words longer than LONG_WORD go through a queue.

    With `shards`, packed by shard instead: (shard, n, m, raw, packed) of n words with m ids.
    """
    plain, bytes_of = vocabulary.plain, vocabulary.bytes

    def ids_of(word: str, edges: list[int]) -> list[int]:
        if len(word) > LONG_WORD:
            return merge_word(word, plain, bytes_of)
        cuts, piece = merge_edges(len(word), edges)
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            hit = piece.get(a * 64 + b - a)
            out += [bytes_of[x] for x in word[a:b].encode("utf-8", "surrogatepass")] if hit is None else [hit]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["word"].to_pylist()
            ids = list(map(ids_of, texts, batch["edges"].to_pylist()))
            if not shards:
                yield pa.RecordBatch.from_arrays([batch["word"], pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])
                continue
            of: dict[int, list[int]] = {}
            raw = [w.encode("utf-8", "surrogatepass") for w in texts]
            for i, w in enumerate(raw):
                of.setdefault(zlib.crc32(w) % shards, []).append(i)
            rows = []
            for shard, own in of.items():
                own.sort(key=raw.__getitem__)
                flat = np.array([x for i in own for x in ids[i]], np.uint32)
                whole = b"\xff".join([raw[i] for i in own])
                rows.append((shard, len(own), len(flat), len(whole), _squeeze(np.array([len(ids[i]) for i in own], np.uint32).tobytes() + flat.tobytes() + whole)))
            yield _batch(rows, _KNOWN)

    schema = "shard int, n int, m int, raw long, packed binary" if shards else "word string, ids array<int>"
    return lattice(words, vocabulary, packed_edge(), parts, LONG_WORD).mapInArrow(run, schema)


#: Names and kinds of packed rows.
_KNOWN = {"shard": pa.int32(), "n": pa.int32(), "m": pa.int32(), "raw": pa.int64(), "packed": pa.binary()}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=[*kinds])


def encode_words(words: DataFrame, vocabulary: Vocabulary, fold=None, parts: int = 8) -> DataFrame:
    """(word, ids array<int>) of distinct words, by merging, or cut by `fold` (`best_path`), which takes words of up to LONG_WORD characters."""
    if fold is None:
        return merged_words(words, vocabulary, parts)
    # Maps and cuts are columns of their own, so that later folds do not compute them anew.
    edge, piece = F.struct("start", "length", "id", "score"), lambda key: F.col("known")[key]["id"]
    folded = lattice(words.filter(F.char_length("word") <= LONG_WORD), vocabulary, edge, parts)
    folded = folded.withColumn("known", scored(F.col("edges"))).withColumn("cuts", fold(F.col("word"), F.col("known")))
    return folded.select("word", numbers_of(F.col("word"), F.col("cuts"), vocabulary.bytes, piece).alias("ids"))


def _squeeze(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _expand(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    """Lowest bytes of all numbers first, then the next ones: these compress better."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _numbered(docs: DataFrame, kind: str, word: re.Pattern, shards: int, block_bytes: int) -> DataFrame:
    """Blocks of documents as numbers of their distinct words (shard -1), and those words by shard, in order of number and of their bytes."""
    schema = f"shard int, block long, n int, raw long, packed binary, ids array<{kind}>, sizes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, turn = TaskContext.get().partitionId() << 32, 0
        ids, texts, size, id_kind = [], [], 0, pa.int64()

        def packed() -> pa.RecordBatch:
            nonlocal turn
            seen: dict[str, int] = {}
            parts = []
            for t in texts:
                words = word.findall(SPACE + t.replace(" ", SPACE)) if t else []
                parts.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.uint32))
            raw = [w.encode("utf-8", "surrogatepass") for w in seen]
            shard = np.array([zlib.crc32(w) % shards for w in raw], np.int64)
            order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
            order = order[np.argsort(shard[order], kind="stable")]
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            flat = number[np.concatenate(parts)] if len(raw) else np.empty(0, np.uint32)
            rows = [(-1, len(flat), flat.nbytes, _squeeze(_planes(flat)), ids, [len(p) for p in parts])]
            for s in range(shards):
                if cuts[s + 1] > cuts[s]:
                    own = b"\xff".join([raw[i] for i in order[cuts[s] : cuts[s + 1]]])
                    rows.append((s, int(cuts[s + 1] - cuts[s]), len(own), _squeeze(own), None, None))
            number, turn = first + turn, turn + 1
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(id_kind), pa.list_(pa.int32()))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            ids.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([columns[0], pa.array([number] * len(rows), pa.int64()), *columns[1:]], names=["shard", "block", "n", "raw", "packed", "ids", "sizes"])

        for block in byte_blocks(batches, "text", 2_000_000):
            id_kind = block.schema.field(0).type
            ids += block["id"].to_pylist()
            texts += block["text"].to_pylist()
            size += block["text"].nbytes
            if size >= block_bytes:
                yield packed()
                size = 0
        if ids:
            yield packed()
        give_back()

    return docs.mapInArrow(run, schema)


def _words_of(packed: bytes, raw: int) -> list[bytes]:
    return _expand(packed, raw).split(b"\xff")


def encode(
    docs: DataFrame, vocabulary: Vocabulary, shards: int | None = None, block_bytes: int = 6_000_000, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, n_tokens, ids) of every row; ids are little-endian unsigned 32-bit numbers, as the model's own library gives them.

    Null and empty texts have no ids. Null ids and repeated rows are encoded like others. An empty table gives no rows. Other
    columns are left out.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or max(64, partitions)
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    numbered = _numbered(plain, kind, vocabulary.word, shards, block_bytes)
    texts, cells, of_cells = stored_apart(numbered, "pieces-blocks", F.col("shard") < 0, "block", partitions)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Distinct words of a shard (block null), and the numbers of each block's words among them."""
        own = [_words_of(packed, raw) for packed, raw in zip(pdf["packed"], pdf["raw"], strict=True)]
        words = sorted(set().union(*own))
        of, whole, shard = {w: i for i, w in enumerate(words)}, b"\xff".join(words), pdf["shard"].iloc[0]
        rows = [(shard, None, len(words), len(whole), _squeeze(whole))]
        for block, some in zip(pdf["block"], own, strict=True):
            step = np.diff(np.fromiter(map(of.__getitem__, some), np.uint32, len(some)), prepend=np.uint32(0))
            rows.append((shard, block, len(some), step.nbytes, _squeeze(_planes(step))))
        del own, words, of
        give_back()
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("shard", "block", "n", "raw", "packed"))})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, packed in zip(batch["raw"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                words = _words_of(packed, raw)
                for a in range(0, len(words), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in words[a : a + 10_000]], pa.string())], names=["word"])

    by_shard = stored(cells.select("shard", "block", "n", "raw", "packed").groupBy("shard").applyInPandas(merge, "shard int, block long, n int, raw long, packed binary"), "pieces-shards")
    discard(spark, of_cells)
    words = by_shard.filter("block is null").select("raw", "packed").mapInArrow(split, "word string")
    known = stored(merged_words(words, vocabulary, 4 * partitions, shards), "pieces-words")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        of: dict[bytes, int] = {}
        sizes, flat = [], []
        for n, m, raw, packed in zip(*(right[c].to_pylist() for c in ("n", "m", "raw", "packed")), strict=True):
            data = _expand(packed, 4 * (n + m) + raw)
            sizes.append(np.frombuffer(data, np.uint32, n))
            flat.append(np.frombuffer(data, np.uint32, m, 4 * n))
            for w in data[4 * (n + m) :].split(b"\xff"):
                of[w] = len(of)
        out, own = [], left.filter(pc.is_null(left["block"]))
        if own.num_rows:
            sizes, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
            at = np.fromiter(map(of.__getitem__, _words_of(own["packed"][0].as_py(), own["raw"][0].as_py())), np.int64)
            starts, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
            rest = left.filter(pc.is_valid(left["block"]))
            for shard, block, n, packed in zip(*(rest[c].to_pylist() for c in ("shard", "block", "n", "packed")), strict=True):
                number = np.cumsum(_from_planes(_expand(packed, 4 * n)), dtype=np.int64)
                ids = flat[runs(starts[number], sizes[number])]
                out.append((block, shard, n, len(ids), _squeeze(_planes(np.concatenate([sizes[number], ids])))))
        return pa.Table.from_batches([_batch(out, {"block": pa.int64(), "shard": pa.int32(), "n": pa.int32(), "m": pa.int32(), "packed": pa.binary()})])

    # Stored before the texts meet them, so that words are not on disk twice while the texts' numbers are.
    answers = stored(by_shard.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "block long, shard int, n int, m int, packed binary"), "pieces-answers")
    discard(spark, by_shard, known)
    schema = f"`{id_column}` {kind}, n_tokens long, ids binary"

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, flat = [], []
        right = right.sort_by("shard")
        for n, m, packed in zip(*(right[c].to_pylist() for c in ("n", "m", "packed")), strict=True):
            both = _from_planes(_expand(packed, 4 * (n + m)))
            sizes.append(both[:n])
            flat.append(both[n:])
        sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, np.int64)
        flat = np.concatenate(flat) if flat else np.empty(0, np.uint32)
        starts = np.cumsum(sizes) - sizes
        row = {c: left[c].to_pylist()[0] for c in ("raw", "packed", "ids", "sizes")}
        numbers = _from_planes(_expand(row["packed"], row["raw"]))
        out, at = [], 0
        for n in row["sizes"]:
            own = numbers[at : at + n]
            at += n
            out.append(flat[runs(starts[own], sizes[own])].astype("<u4").tobytes())
        return pa.table({id_column: pa.array(row["ids"], left.schema.field("ids").type.value_type), "n_tokens": pa.array([len(o) // 4 for o in out], pa.int64()), "ids": pa.array(out, pa.binary())})

    return texts.select("block", "raw", "packed", "ids", "sizes").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(gather, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, column: str = "text") -> DataFrame:
    """Rows of `encode` with the text of their ids: pieces joined, blanks put back, and the first blank left out."""
    plain = {i: t for t, (i, _) in vocabulary.plain.items()}
    number = {b: k for k, b in enumerate(vocabulary.bytes)}
    raw = [plain[i].replace(SPACE, " ").encode() if i in plain else bytes([number[i]]) if i in number else b"" for i in range(len(vocabulary.texts))]
    length = np.array([len(r) for r in raw], np.int64)
    blob, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "ids", 2_000_000):
            texts = []
            for ids in block["ids"].to_pylist():
                own = np.frombuffer(ids, "<u4")
                text = blob[runs(starts[own], length[own])].tobytes()
                texts.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(texts, pa.string())], names=[*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, `{column}` string")
