"""Packing against the tokenizer itself, archives by exact round trip, pieces against their own library."""

import base64
import hashlib
import struct
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wane.llm import packing, pieces, warc
from wane.llm.common import shared_folder

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["A short Text, with marks!", None, "", "  ", "a<|endoftext|>b", "x\ny\tz  w", "Ünïcödé İSTANBUL ẞ", "word " * 900, "long" * 3000, "it's 12 o'clock."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "repeated id", "x", 1), (3, "repeated id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, piece int")


def test_pack(spark, docs):
    out = packing.pack(docs, WORDS, capacity=64, open_bins=4, block=5).collect()
    model = Tokenizer.from_file(WORDS)
    want = []
    for r in docs.collect():
        ids = model.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want += [(r["doc_id"], k // 64, k, tuple(ids[k : k + 64])) for k in range(0, len(ids), 64)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = [(r["doc_id"], r["piece"], r["start"], struct.unpack(f"<{r['length']}I", r["ids"])) for r in out]
    assert sorted(got, key=key) == sorted(want, key=key)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_pack_of_nothing(spark, docs):
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_open_bins_keep_the_bound_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (9, 7, 6)] == [(0, 0), (1, 0), (2, 0)]
    assert bins.n_open == 2  # the one with 9 of 10 has closed
    assert bins.place(1) == (1, 7)
    assert bins.place(4) == (2, 6)


def test_best_fit_wastes_little():
    bins, lengths = packing.OpenBins(2048, 64), [(i * 7919) % 1500 + 1 for i in range(5000)]
    for n in lengths:
        bins.place(n)
    assert bins.made <= sum(lengths) / 2048 * 1.05


PAGES = [(5, "http://a/1", "same"), (2, "http://a/2\r\nX: 1", "same"), (7, None, None), (8, "u", ""), (9, "u", "é" * 50), (10, "u", "same"), (None, "u", "same"), (11, "u", "own")]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, address string")
    folder = shared_folder(spark, "test-warc")
    warc.write_archive(pages, folder)
    rows = {r["page"]: r for r in warc.read_archive(spark, folder).collect()}
    assert len(rows) == len(PAGES) and all(r["verified"] for r in rows.values())
    for page, _, html in PAGES:
        r, raw = rows[None if page is None else str(page)], (html or "").encode()
        assert r["sha1"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r["bytes"] == len(raw) and bytes(r["payload"]) == raw
        first = {"same": 2, "": 7}.get(html or "", page)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == page else ("revisit", str(first)))
        assert bytes(r["block"]) == (raw if first == page else b"")
        assert f"Content-Length: {len(r['block'])}\r\n\r\n".encode() in bytes(r["header"])
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in PAGES})
    assert "a/2%0D%0AX: 1" in rows["2"]["url"]


def test_short_payloads_are_responses_and_empty_tables_work(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for limit, table in ((5, pages), (0, pages.limit(0))):
        folder = shared_folder(spark, "test-warc")
        warc.write_archive(table, folder, min_bytes=limit)
        assert {r["record_type"] for r in warc.read_archive(spark, folder).collect()} <= {"response"}


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(PIECES)


def test_encode_and_decode(spark, docs, vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    more = spark.createDataFrame([(100, " lead  two ▁ trail ", "", 0), (101, "日本語😀\x00", "", 0), (102, "x" * 500 + "the" * 40, "", 0)], docs.schema)
    rows = docs.union(more)
    out = pieces.decode(pieces.encode(rows, vocabulary, block_bytes=2000), vocabulary).collect()
    want = sorted((r["doc_id"] or -1, tuple(model.encode(r["text"] or "")), (r["text"] or "").replace("▁", " ")) for r in rows.collect())
    assert sorted((r["doc_id"] or -1, struct.unpack(f"<{r['n_tokens']}I", r["ids"]), r["text"]) for r in out) == want
    assert pieces.encode(rows.limit(0), vocabulary).count() == 0


def test_best_path_is_the_largest_sum(spark, vocabulary):
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -1.2, "aba": -3.9, "c": -0.5}
    small = pieces.Vocabulary.__new__(pieces.Vocabulary)
    small.texts, small.bytes = [*scores], [1000 + b for b in range(256)]
    small.plain, small.longest, small.rank = {t: (i, s) for i, (t, s) in enumerate(scores.items())}, 3, dict.fromkeys(scores.values(), 0)
    words = ["abab", "abac", "bbaa", "a?b", "c", "abaab"]

    def best(w):
        if not w:
            return 0.0, ()
        ways = []
        for n in range(1, len(w) + 1):
            s = scores.get(w[:n], -100.0 if n == 1 else None)
            if s is not None:
                total, rest = best(w[n:])
                ways.append((s + total, ((small.plain[w[:n]][0],) if w[:n] in scores else tuple(1000 + b for b in w[:n].encode())) + rest))
        return max(ways, key=lambda x: x[0])

    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: tuple(r["ids"]) for r in pieces.encode_words(frame, small, pieces.best_path).collect()}
    value = lambda ids: sum(scores[small.texts[i]] if i < 1000 else -100.0 for i in ids)
    for w in words:
        assert abs(value(got[w]) - best(w)[0]) < 1e-9


def test_queue_and_fold_agree(spark, vocabulary):
    words = ["▁the", "▁unbelievable", "▁▁▁x", "\n", "zzzzzz", "▁ababababab", "▁Straße", "日本"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for r in pieces.encode_words(frame, vocabulary).collect():
        assert r["ids"] == pieces.merge_word(r["word"], vocabulary.plain, vocabulary.bytes)


def test_merging_along_edges_takes_the_highest_and_leftmost():
    rank = {"ab": 3, "ba": 3, "bb": 1, "abba": 2}
    word = "abbabab"
    edges = [(a * 64 + b - a) * 2**42 + rank.get(word[a:b], 0) * 2**21 + 7 for a in range(7) for b in range(a + 1, 8) if b - a == 1 or word[a:b] in rank]
    assert pieces.merge_edges(7, edges)[0] == [0, 4, 6, 7]
    assert pieces.merge_edges(3, []) == ([0, 1, 2, 3], {})


def test_what_is_not_read_again_leaves_the_disk(spark):
    from pathlib import Path

    from wane.llm.common import discard, stored, stored_apart

    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    shuffled = lambda: sum(f.stat().st_size for f in local.rglob("shuffle_*.data"))
    frame = spark.range(100_000).withColumn("word", F.sha2(F.col("id").cast("string"), 256))
    before = shuffled()
    assert stored(frame.repartition(3, "word"), "test").count() == 100_000
    assert shuffled() < before + 1_000_000
    few, rest, folder = stored_apart(frame, "test", F.col("id") < 10, "id", 3)
    assert (few.count(), rest.count()) == (10, 99_990)
    whole = stored(frame, "test")
    discard(spark, folder, whole)
    assert few.count() == 10
    for path in (folder, whole.inputFiles()[0].rpartition("/")[0]):
        assert sum(f.stat().st_size for f in Path(path.removeprefix("file:")).iterdir()) < 10_000
    empty, every, _ = stored_apart(frame, "test", F.lit(False), "id", 3)
    assert (empty.count(), every.count()) == (0, 100_000)


def test_crc_of_packed_ids_is_the_contract(spark):
    raw = struct.pack("<3I", 1, 70000, 0)
    assert spark.createDataFrame([(raw,)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(raw)


def test_every_letter_before_every_mark_has_the_ids_of_the_library():
    import sys

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from wane.llm.packing import Words, _known_rules

    path = public_tokenizers.path("word_bpe_49k.json")
    assert _known_rules(path) and not _known_rules(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    for mark in ".,;:!?":
        texts = ["a" + c + mark for c in letters]
        # CJK and Hangul alone are most of these: all of them before one mark, every tenth before the others
        texts = texts if mark == "?" else [t for k, t in enumerate(texts) if k < 8000 or k % 10 == 0]
        got = Words(library, True).of(pa.array(texts))
        for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == want.ids, text.encode("unicode_escape")
