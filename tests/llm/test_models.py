"""Learned operators: held-out accuracy, probabilities that sum to one, and search against brute force."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wane.llm import ann, language, lm, toxicity
from wane.llm.common import bucket_of, hashed_words, joined_bytes

FILLER = [f"word{i}" for i in range(200)]


def labelled(n=3000, seed=5):
    """Toxic only where an insult meets a group: neither is toxic alone."""
    r, rows = random.Random(seed), []
    for i in range(n):
        words = [r.choice(FILLER) for _ in range(r.randint(5, 30))]
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += ["vile"] * insult + ["tribe"] * group
        r.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_toxicity_learns_pairs(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    machine = toxicity.learn(docs.filter("doc_id % 3 != 1"), labels, rate=0.02, epochs=15, decay=1e-3)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    right = [(out[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 1]
    assert len(out) == len(rows) and np.mean(right) > 0.95


def test_toxicity_learns_from_given_documents_only(spark, monkeypatch):
    """Labels of other ids neither use up the sample nor count for the labels' shares."""
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(i, 1) for i in range(1000, 3000)], "doc_id long, toxic int")
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, y, weights, **_: got.append((y, weights)))
    toxicity.learn(docs, labels, per_label=10)
    y, weights = got[0]
    assert (y == 1).sum() == 10 and (y == 0).sum() == 10 and weights[y == 1].sum() == pytest.approx(10) and weights[y == 0].sum() == pytest.approx(30)


def test_toxicity_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    machine = toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "x" * 100_000), (1, "x")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, machine).collect())
    assert toxicity.score(empty, machine).count() == 0


def test_factors_by_definition():
    machine = toxicity.Machine(np.array([2, 5, 9]), 0.1, np.array([1.0, -2.0, 0.5]), np.array([[1.0, 0.0], [0.5, 2.0], [-1.0, 1.0]]))
    v = machine.factors
    want = 0.1 + 1.0 - 2.0 + 0.5 + v[0] @ v[1] + v[0] @ v[2] + v[1] @ v[2]
    assert machine.logits(np.array([2, 5, 9, 7]), np.zeros(4, int), 2).tolist() == pytest.approx([want, 0.1])


def test_language(spark):
    r = random.Random(2)
    kinds = {"aa": "bdgk ou", "bb": "ptfs ei", "cc": "éàç lm"}
    rows = [(i, "".join(r.choice(kinds[k]) for _ in range(r.randint(30, 900))), k) for i in range(400) for k in [r.choice([*kinds])]]
    rows += [(900, None, "aa"), (901, "123 ... ² !", "bb"), (902, "bdou" * 60, None)]
    docs = spark.createDataFrame([(*x, 0.0) for x in rows], "doc_id long, text string, lang string, lang_score double")
    network = language.learn(docs.filter("doc_id % 5 != 0"), epochs=6)
    out = {x["doc_id"]: x for x in language.identify(docs, network).collect()}
    assert np.mean([out[i]["lang_pred"] == k for i, _, k in rows if i % 5 == 0 and i < 900]) > 0.97
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[902]["lang_pred"] == "aa"
    assert all(0 <= x["lang_score"] <= 1 for x in out.values())


def test_language_without_examples(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    network = language.learn(docs)
    assert language.identify(docs, network).first()["lang_pred"] == "und" and language.identify(docs.limit(0), network).count() == 0


def test_network_tables_and_slopes():
    """The pair tables give the plain convolution, and slopes are those of the loss."""
    random_ = np.random.default_rng(3)
    net = language.Network(["a", "b"], (1, 2, 3, 4), 3, 20)
    x = random_.integers(0, language.KINDS, (6, 20)).astype(np.uint8)
    plain = np.concatenate([net._pooled(x, w).max(axis=1) for w in net.widths], axis=1)
    want = np.maximum(plain, 0) @ net.weights["out"] + net.weights["base"]
    assert np.allclose(net.logits(x, net.tables()), want, atol=1e-4)
    y = np.array([0, 1, 0, 1, 1, 0])

    def loss():
        z = (np.maximum(np.concatenate([net._pooled(x, w).max(axis=1) for w in net.widths], axis=1), 0) @ net.weights["out"] + net.weights["base"]).astype(float)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))

    slopes = net.step(x, y)
    for name in ("conv3", "out", "bias2"):
        at = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        was, small = net.weights[name][at], 1e-2
        net.weights[name][at] = was + small
        up = loss()
        net.weights[name][at] = was - small
        down = loss()
        net.weights[name][at] = was
        assert slopes[name][at] == pytest.approx((up - down) / (2 * small), rel=0.15, abs=1e-3)


def lm_rows(n=160):
    r = random.Random(4)
    vocabulary = [f"v{int(r.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(w for _ in range(r.randint(0, 25)) for w in ("The", r.choice(vocabulary)))) for i in range(n)]
    return rows + [(1000, None), (1001, " "), (1002, "neverseen NEVERSEEN"), (None, "The v1")]


def test_language_model_counts(spark):
    rows = lm_rows()
    docs = spark.createDataFrame([(*x, True) for x in rows], "doc_id long, text string, held boolean")
    out = lm.score(docs, bucket_of("doc_id", 7) == 2, contexts=32, shards=3, block_bytes=500).collect()
    words = lambda t: [*(t or "").lower().split(), None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    count = {}
    for i, t in rows:
        for w in words(t) if not held(i) else []:
            count[w] = count.get(w, 0) + 1
    total, known = sum(count.values()), len(count)
    text = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        own = words(text[r["doc_id"]])
        base = sum(math.log10((count.get(w, 0) + 1) / (total + known + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(w in count for w in own), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    tested = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)


def test_each_word_before_is_a_context(spark):
    """3,000 words, each always before the same other one: classes of several of them would share their chances."""
    n, times = 3000, 20
    rows = [(i, f"a{i} b{i} " * times) for i in range(n)] + [(n + i, f"a{i} b{i}") for i in range(0, n, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") >= n, shards=5, block_bytes=100_000).collect()}
    follows = (times - 0.8) / (times + 5)  # one table, without what the parent adds
    for i in range(n):  # each line has the pair so often
        assert out[i]["n_tokens"] == 2 * times + 1 and out[i]["train_tokens"] == n * (2 * times + 1)
        assert out[i]["score"] > times * math.log10(follows * 0.9) + (times - 1) * math.log10(0.9 * (times - 1 - 0.8) / (times + 5)) - 12


def test_frequent_words_are_dealt_by_pair(spark, monkeypatch):
    """No shard holds all pairs of the most frequent word, and scores keep their scale; shards follow the input."""
    r = random.Random(9)
    rows = [(i, " ".join(f"the w{int(r.paretovariate(0.6)) % 5000}" for _ in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = docs.select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("held"))
    the = hashed_words(*joined_bytes(["the"]))[0][0]
    assert the in lm._frequent(plain, 2, 1) and lm.END not in lm._frequent(plain, 1, 1)
    had = {}
    for most in (0, 2):
        kept = lm._shards(lm._dealt(plain, "bigint", None, 8, 20_000, lm._frequent(plain, most, 1))).filter("block is null").collect()
        pairs = []
        for k in kept:
            word, _, _, words, _ = lm._unzip(k["pairs"], *[("<u4", k["n"])] * 3, ("<u8", k["words"]), ("<u8", k["contexts"]))
            pairs.append(int((words[word] == the).sum()))
        had[most] = pairs
    assert sum(had[0]) == sum(had[2]) == max(had[0]) and max(had[2]) < 0.3 * sum(had[2])
    scores = [{x["doc_id"]: x for x in lm.score(docs, F.col("doc_id") % 5 == 0, shards=8, block_bytes=20_000, most_frequent=m).collect()} for m in (0, 2, 1000)]
    for other in scores[1:]:
        assert all((x["base_score"], x["n_known"], x["train_tokens"]) == (pytest.approx(other[i]["base_score"]), other[i]["n_known"], other[i]["train_tokens"]) for i, x in scores[0].items())
        assert np.mean([x["score"] for x in other.values()]) == pytest.approx(np.mean([x["score"] for x in scores[0].values()]), rel=0.02)
    asked = []
    dealt = lm._dealt
    monkeypatch.setattr(lm, "_dealt", lambda *a: asked.append(a[3]) or dealt(*a))
    monkeypatch.setattr(lm, "SHARD_BYTES", 1000)
    assert lm.score(docs, F.lit(False)).count() == 300 and asked[0] > 64


def test_chances_sum_to_one():
    """Over all known words and the unknown one, in every context."""
    contexts, words = 4, 30
    random_ = np.random.default_rng(1)
    word, context = (a.ravel() for a in np.meshgrid(np.arange(words), np.arange(contexts), indexing="ij"))
    count = random_.poisson(2.0, len(word)).astype(float) * (word > 2)
    model = lm.Model(contexts, (2.0, 1.5), (0.4, 0.7), 3, 1, 9)
    model.customers, model.known = np.bincount(context, count, contexts), int((np.bincount(word, count) > 0).sum())
    for _ in range(4):
        *_, (t, up, s) = model.replay(0, word, context, count)
        model.states.append((np.bincount(context, t, contexts), float(up.sum()), float(s.sum())))
        assert (t <= count).all() and ((t > 0) == (count > 0)).all() and (s <= up).all()
    chance = model.chances(0, word, context, count)
    seen = np.bincount(word, count) > 0
    for c in range(contexts):
        unknown = chance[(context == c) & ~seen[word]][0]
        assert chance[(context == c) & seen[word]].sum() + unknown == pytest.approx(1.0, abs=1e-9)


def test_seating_follows_the_restaurant():
    """The mean number of tables of n customers who all sit by strength and discount alone."""
    n, strength, discount = 200, 3.0, 0.4
    got = lm.tables_of(np.full(4000, float(n)), np.ones(4000), strength, discount, np.zeros(4000), np.random.default_rng(0)).mean()
    log_ratio = math.lgamma(strength + discount + n) + math.lgamma(strength) - math.lgamma(strength + n) - math.lgamma(strength + discount)
    assert got == pytest.approx(strength / discount * (math.exp(log_ratio) - 1), rel=0.03)


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty, F.lit(False)).count() == 0
    only = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(only, F.lit(True)).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"]) == (0, 0, 3)


def test_word_hashes():
    words = ["a", "b" * 64, "b" * 65, "b" * 66, "c" * 500, "A", "ab", "ba"]
    value, of = hashed_words(*joined_bytes([" \t".join(words), None, words[4]]))
    assert len(set(value[:8].tolist())) == 7 and value[0] == value[5] and value[8] == value[4] and of.tolist() == [0] * 8 + [2]


def test_nearest(spark):
    random_ = np.random.default_rng(8)
    points = random_.normal(size=(1500, 12))
    points[700:1000] = points[700]  # one very common vector
    rows = [(i, p.tolist(), "x") for i, p in enumerate(points)]
    rows += [(5000, None, "x"), (5001, [0.0] * 12, "x"), (5002, [float("nan")] * 12, "x"), (5003, [None] * 12, "x"), (None, [1.0] * 12, "x"), (5100, [1.0, 2.0], "x"), (5200, [1.0, 3.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = ann.nearest(table, F.col("vec_id") % 50 == 0, k=10, shard_size=300, query_block=7).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        assert [*got[q]] == sorted(got[q]) or sorted(got[q]) == list(range(1, 11))
        assert [s for _, s in (got[q][k] for k in range(1, 11))] == pytest.approx([d[v] for v, _ in (got[q][k] for k in range(1, 11))])
        hits += len({v for v, _ in got[q].values()} & set(want.tolist()))
        if 700 <= q < 1000:
            assert [v for v, _ in (got[q][k] for k in range(1, 11))] == want.tolist()
    assert hits >= 0.95 * 300
    assert got[5100] == {1: (5200, 1.0)} and got[5200] == {1: (5100, 1.0)} and set(got) == {*range(0, 1500, 50), 5100, 5200}
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0


def test_sweeps_leave_the_disk_before_the_texts_are_scored(spark):
    from pathlib import Path

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(200))) for i in range(60)], "doc_id long, text string")
    lm.score(docs.limit(0), F.lit(False)).count()  # names the shared folder
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(root.iterdir())
    scored = lm.score(docs, F.col("doc_id") % 7 == 2, block_bytes=4000)
    left = {f.name.rpartition("-")[0]: sum(x.stat().st_size for x in f.rglob("*.parquet")) for f in set(root.iterdir()) - before if f.name.startswith("lm-")}
    assert "lm-dealt" not in left and left["lm-contexts"] < 2000
    assert sorted((r["doc_id"], r["n_tokens"]) for r in scored.collect()) == [(i, 201) for i in range(60)]


def test_numbers_keep_their_bytes():
    import numpy as np

    arrays = [np.arange(300, dtype="<u4") ** 2, np.array([2**63 + 5, 1], np.uint64), np.array([-1, 2**40]), np.array([1e-9, -0.5]), np.empty(0, "<u4")]
    back = lm._unzip(lm._zip(*arrays), *((a.dtype.str, len(a)) for a in arrays))
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))
