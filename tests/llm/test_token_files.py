"""Token files against the tokenizer library, and the coder's round trips."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wane.llm import rans, tokenfiles
from wane.llm.common import shared_folder

FILE = public_tokenizers.path("byte_bpe_50k.json")
ATOMS = [" ", "\n", "a", "B", "é", ".", ",", "?", "'s", "'t", "12", "\t", "Ж", "α", "中", "<|endoftext|>", "\x00", "😀", "ß", "ſ", "́", "word", "-", "_", "İ", "ª", "²", "\xa0", "　", "don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_words_give_the_ids_of_the_library(library):
    r = random.Random(4)
    texts = [None, "", *("".join(r.choice(ATOMS) for _ in range(r.randint(0, 9))) for _ in range(20_000))]
    words = tokenfiles.ByteWords(FILE)
    assert words.by_words
    for text, ids in zip(texts, words.of(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_other_vocabularies_go_to_the_library_whole():
    other = public_tokenizers.path("word_bpe_49k.json")
    words, library = tokenfiles.ByteWords(other), Tokenizer.from_file(other)
    assert not words.by_words
    text = "Über  two\nlines, İ?"
    assert np.frombuffer(words.of(pa.array([text]))[0], np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_coder_round_trips_and_notices_changed_bytes():
    r = np.random.default_rng(1)
    shares = 1 / np.arange(1, 5001)
    ids = r.choice(5000, 200_000, p=shares / shares.sum()).astype(np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(ids)))
    step = rans.LANES * rans.EVERY
    blocks = [ids[:0], ids[:1], ids[: rans.LANES], ids[: step], ids[: step + 1], ids[: 3 * step - 5], ids[:70_000]]
    packed = coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode(packed), strict=True))
    entropy = -(shares / shares.sum() * np.log2(shares / shares.sum())).sum()
    assert 8 * len(packed[-1]) / 70_000 < entropy * 1.05
    broken = bytearray(packed[-1])
    broken[-9] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        coder.decode([bytes(broken)])
    with pytest.raises(ValueError, match="frequency table"):
        rans.Coder(rans.scaled([1, 0])).encode([np.array([1])])


def test_frequencies_fill_the_table():
    for counts in ([5], [1, 0, 10**12], [1] * 60_000, np.arange(50_000) ** 3):
        got = rans.scaled(counts)
        assert got.sum() == 1 << rans.SCALE and ((got > 0) == (np.asarray(counts) > 0)).all()
    assert rans.scaled([]).sum() == 0 and rans.scaled([0, 0]).sum() == 0


def rows_of(r):
    words = ["plain", "Wörter", "and", "12", "x."]
    rows = [(k * 3 % 101, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for k in range(300)]
    return rows + [(None, "first"), (None, None), (7, None), (7, ""), (7, ""), (8, "long " * 150_000), (9, "y" * 70_000), (6, "a\tb  c")]


@pytest.mark.parametrize("per_file", [8_000_000, 3_000])
def test_files_give_back_every_document_in_order(spark, library, per_file):
    rows = rows_of(random.Random(2))
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n int, file string, row int").repartition(3)
    folder = shared_folder(spark, "tokens-test")
    tokenfiles.write_tokens(docs, FILE, folder, end_id=2, ids_per_file=per_file)
    found = sorted(tokenfiles.read_tokens(spark, folder).collect(), key=lambda x: x["start"])
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    ids = [(x["doc_id"], np.frombuffer(x["ids"], "<u4").tolist()) for x in found]
    assert sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == want
    assert [i for i, _ in ids] == [i for i, _ in want]
    at = 0
    for x, (_, own) in zip(found, ids, strict=True):
        assert (x["start"], x["n_tokens"]) == (at, len(own))
        at += len(own)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.filter("split").count() > 2 and blocks.agg(F.max("n_ids")).first()[0] <= tokenfiles.BLOCK
    assert (blocks.select("file").distinct().count() > 1) == (per_file < 8_000_000)


def test_empty_table_and_text_ids(spark):
    for kind, rows in (("long", []), ("string", [("none", "a"), (">", None)])):
        folder = shared_folder(spark, "tokens-test")
        tokenfiles.write_tokens(spark.createDataFrame(rows, f"doc_id {kind}, text string"), FILE, folder)
        assert [(x["doc_id"], x["start"], x["n_tokens"]) for x in tokenfiles.read_tokens(spark, folder).orderBy("start").collect()] == (
            [(">", 0, 1), ("none", 1, 2)] if rows else [])
