"""The pipeline's stages one after another, each against what it should do with its own input."""

import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=700, seed=6):
    r = random.Random(seed)
    kinds = {"en": [f"the{x}" for x in "abcdefghijk"] + ["of", "and"], "de": [f"ung{x}" for x in "äöüßrst"] + ["der", "und"]}
    rows = []
    for i in range(n):
        lang = r.choice([*kinds])
        words = [r.choice(kinds[lang]) + str(r.randrange(50) if r.random() < 0.5 else "") for _ in range(r.randint(15, 80))]
        toxic = r.random() < 0.25
        if toxic:
            words[3:3] = ["scum", "moron"]
        rows.append((i, " ".join(words), lang, "s", toxic))
    passage = "this very passage stands in many documents and is longer than a hundred bytes so that it must be cut out everywhere but once"
    for i in range(n, n + 20):
        own = " ".join(r.choice(kinds["en"]) + str(r.randrange(9999)) for _ in range(40))
        rows.append((i, f"{own} {passage} {own[::-1]}", "en", "s", False))
    near = " ".join(r.choice(kinds["de"]) + str(r.randrange(9999)) for _ in range(90))
    rows += [(n + 100, near, "de", "s", False), (n + 101, near + " ende", "de", "s", False), (n + 102, near, "de", "s", False)]
    rows += [(n + 200, None, None, "s", False), (n + 201, "... 123 !!", "en", "s", False), (None, "an id is missing here", "en", "s", False)]
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = corpus()
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s, _ in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, int(y)) for i, *_, y in rows if i is not None and i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else docs.collect()
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    toxic = {i for i, *_, y in rows if y}
    kept = set(seen["toxicity"])
    assert len(toxic & kept) <= 0.05 * len(toxic) and len(kept) >= len(rows) - len(toxic) - 3
    assert set(seen["toxicity"]) - set(seen["language"]) <= {900, 901} and {900, 901} & set(seen["language"]) == set()
    gone = set(seen["language"]) - set(seen["near_duplicates"])
    assert {801, 802} <= gone and 800 not in gone and None in seen["near_duplicates"] and len(gone) <= 4
    texts = [r["text"] for r in seen["repeats"].values()]
    assert set(seen["repeats"]) == set(seen["near_duplicates"]) and sum(passage in t for t in texts) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in seen["repeats"].values())
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in sorted(seen["packing"], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"])):
        got[r["doc_id"]] = got.get(r["doc_id"], ()) + struct.unpack(f"<{r['length']}I", r["ids"])
    assert got == {i: (*model.encode(r["text"], add_special_tokens=False).ids, 0) for i, r in seen["repeats"].items()}


def test_run_on_given_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_unreadable_texts_go(spark):
    """The network rejects long texts of noise and scripts never learned; short ones and those without a label stay."""
    rows, _ = corpus()
    r = random.Random(8)
    made = {
        "letters": lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(500)),
        "keys": lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(500)),
        "script": lambda: "".join(r.choice("абвгдежзийклмнопрст   ") for _ in range(500)),
        "bytes": lambda: "".join(chr(r.randrange(0xA0, 0x250)) for _ in range(400)),
    }
    bad = [(5000 + i, make(), None, "s", False) for i, make in enumerate(m for m in made.values() for _ in range(10))]
    short = [(6000 + i, make()[:40], None, "s", False) for i, make in enumerate(made.values())]
    unlabelled = [(7000 + i, t, None, "s", False) for i, t, *_ in rows[:50]]
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s, _ in rows + bad + short + unlabelled], SCHEMA)
    kept = {x["doc_id"] for x in corpus_pipeline.drop_unknown_language(spark, docs, "").collect()}
    assert not kept & {b[0] for b in bad} and kept == {x[0] for x in rows + short + unlabelled} - {900, 901}


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "... 12", None, "s", 6), (3, None, "en", "s", 0)], SCHEMA)
    assert [x["doc_id"] for x in corpus_pipeline.drop_unknown_language(spark, docs, "").collect()] == [1]
