"""Near-duplicates, repeated strings, suffix arrays and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from wane.llm import fingerprints, graph, neardup, substrings
from wane.llm.shingles import shingle_sets
from wane.llm.suffixes import suffix_arrays

WORDS = [f"w{i}" for i in range(300)]


def some_documents(seed=3, n=120):
    """Random texts, exact copies, near copies of several strengths, shared passages, and edge cases."""
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(r.randint(20, 60))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
            words[r.randrange(len(words))] = r.choice(WORDS)
        if i % 7 == 0:
            words += base[0][:30]
        rows.append((i * 3, " ".join(words)))
    rows += [(1, None), (2, ""), (4, " \t\n "), (5, "One"), (7, "one"), (8, "One two"), (10, "x " * 5000), (11, "ab" * 300), (13, "ab" * 301)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "c", 1) for r in some_documents()], "doc_id long, text string, class string, n long")


def shingles_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def components_of(rows, width, num=80, den=100):
    sets = {i: shingles_of(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("width,block", [(2, 256), (5, 256), (2, 3)])
def test_near_duplicates(spark, docs, width, block):
    got = {r[0]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width=width, block=block).collect()}
    assert got == components_of(some_documents(), width)


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "k l m n o p"), (9, "k l m n o p"), (9, "k l m n o p"), (3, None)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert len(out) == 6 and all(r["kept"] for r in out if r[0] is None)
    assert {r[0]: r["component_id"] for r in out if r[0] is not None} == {1: 1, 9: 1, 3: 3}
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_shingle_counts():
    texts = [t for _, t in some_documents()]
    for width in (1, 2, 5):
        _, cuts = shingle_sets(texts, width)
        assert np.diff(cuts).tolist() == [len(shingles_of(t, width)) for t in texts]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 175)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 150: 150, 175: 150, 200: 150}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_arrays():
    r = random.Random(1)
    for trial in range(150):
        k = r.choice([1, 2, 3, 26])
        texts = [[r.randint(1, k) for _ in range(r.randint(0, 40))] + [0] for _ in range(r.randint(1, 20))]
        if trial % 3 == 0:
            texts = [(t[:-1] * 3)[:60] + [0] for t in texts]
        starts = np.cumsum([0, *map(len, texts)])
        got = suffix_arrays(np.array(sum(texts, [])), starts)
        for t, a in zip(texts, starts, strict=False):
            assert (got[a : a + len(t)] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def removed_of(rows, length):
    """rows in order of (id, text)."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                mark[k : k + length] = True
            seen.add(b[k : k + length])
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
        out.append((i, len(b), [tuple(x) for x in edge.reshape(-1, 2).tolist()], np.frombuffer(b, np.uint8)[~mark].tobytes()))
    return out


@pytest.mark.parametrize("length,most_cells", [(100, 32), (24, 32), (24, 2), (7, 3)])
def test_repeated_strings(spark, docs, length, most_cells):
    got = substrings.remove_repeats(docs, length=length, most_cells=most_cells, shards=3, block_bytes=2000).collect()
    got = sorted((r[0], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got)
    assert got == removed_of(sorted(some_documents(), key=lambda x: x[0]), length)


def test_heavy_second_anchors_are_parted(spark):
    """Windows that reach into one passage share anchors and differ outside: no task holds them all, and the result stays exact."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passage = "q" + "zx" * 14 + "q"
    rows = [(i, " ".join([word() for _ in range(4)] + [passage] * (i % 3 != 0) + [word() for _ in range(4)])) for i in range(150)]
    rows += [(i, rows[i - 150][1]) for i in range(150, 170)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {i: spans for i, _, spans, _ in removed_of(rows, 30)}
    got = substrings.remove_repeats(docs, length=30, most_cells=2, shards=3, block_bytes=2000, most_windows=60).collect()
    assert {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"]] for x in got} == want

    n, same = 4000, np.uint64(7)
    one = np.random.default_rng(0).integers(0, 2**63, n // 2, np.uint64).repeat(2)
    kinds = np.random.default_rng(1).permutation(n)
    window = [x[kinds] for x in (one, one, np.arange(n), np.zeros(n, np.int64), np.full(n, same))]
    packed = [(0, n // 8, bytearray(substrings._pack(*(w[a : a + n // 8] for w in window)))) for a in range(0, n, n // 8)]
    windows = spark.createDataFrame(packed, "shard long, n int, packed binary")
    heavy = substrings._heavy(windows, 200)
    assert heavy == {7: 20} and substrings._heavy(windows, n) == {}
    parts = {x["part"]: x["n"] for x in substrings._parted(windows, heavy).groupBy("part").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert len(parts) == 20 and max(parts.values()) < 400 and sum(parts.values()) == n
    late = substrings._late_windows(windows, 30, 200).collect()
    assert sorted(x["doc"] for x in late) == list(range(1, n, 2))


def test_repeated_strings_edge_rows(spark):
    text = "é the quick brown fox jumps over the lazy dog " * 3
    rows = [(None, text), (2, text), (2, text), (1, "z" + text), (5, None)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string"), length=20).collect()
    want = removed_of(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), 20)
    assert sorted((r[0] or 0, r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in out) == sorted((i or 0, n, len(s), k) for i, n, s, k in want)
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_fingerprints(spark, docs):
    rows = sorted(some_documents(), key=lambda x: x[0])
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(docs, rows_per_part=7).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and hashlib.sha256(r["edited_text"].encode()).digest() == hashlib.sha256(edited.encode()).digest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        a, b, c = fingerprints.signature_sets([t, edited, after])
        assert r["near_edited"] == fingerprints.likeness(a, b) and r["near_next"] == fingerprints.likeness(a, c)
        assert r["edited_fingerprint"] == fingerprints.as_text(b)


def test_fingerprints_edge_rows(spark):
    rows = [(None, "and the house"), (1, None), (1, "of a big tree"), (1, "of a big tree")]
    out = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(r["n_chars"] for r in out) == [0, 13, 13, 13]
    only = fingerprints.fingerprint(spark.createDataFrame([(None, "the big cat")], "doc_id int, text string")).first()
    assert only["near_next"] == 1.0
    assert fingerprints.fingerprint(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    assert fingerprints.likeness(np.array([1, 2]), np.arange(100), least=0.5) == 0.0


def test_similar_classes(spark, docs):
    members, pairs = fingerprints.similar(docs, least=0.6)
    texts = dict(some_documents())
    sets = {i: set(s.tolist()) for i, s in zip(texts, fingerprints.signature_sets(list(texts.values())), strict=True)}
    klass = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert klass == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(a, b) for a in set(klass.values()) for b in set(klass.values()) if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
