"""Document fingerprints by spot signatures.

A signature is a common word (the anchor) with the content words that follow it; common words are the same in boilerplate and
prose of a language but the chains after them are not. A document's fingerprint is the sorted set of its hashed signatures.
Sets of very different size cannot be alike, so comparisons stay within neighbouring partitions of set length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane.llm.common import byte_blocks, hashed_words, joined_bytes, mixed

#: Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "the of and to a in is it that was for on are as with be at by this from or an not have had but "
    "der die das und ein eine zu von mit den dem ist im nicht auf für als auch des sich es er sie wir "
    "le la les de des un une et est dans que qui pour par sur au aux du ne pas il elle ce en se "
    "el los las y o una que por con para del al lo su no como más se es son"
).split()
#: Letters, digits and bytes of longer characters stay; everything else separates words.
_KEEP = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_BYTES = np.where(_KEEP, np.arange(256), 32).astype(np.uint8)


def _hash_of(words: list[str]) -> np.ndarray:
    data, starts = joined_bytes(words)
    return hashed_words(data, starts)[0]


_ANCHOR_HASHES = np.unique(_hash_of(list(ANCHORS)))


def signature_sets(texts: list[str | None], chain: int = 2) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text.

    An anchor is followed by the next `chain` content words, as far as the text has them. In a text whose anchors give none,
    every word is an anchor; without content words each word is a signature, without words the non-blank text as a whole. Null,
    empty and blank texts have the empty set.
    """
    data, starts = joined_bytes(texts)
    word, doc = hashed_words(_BYTES[data], starts)
    common = np.isin(word, _ANCHOR_HASHES)
    content, content_doc = word[~common], doc[~common]
    nth = np.cumsum(~common)  # content words up to and including each word
    follows = np.append(content, np.uint64(0))
    owner = np.append(content_doc, -1)

    def chains(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, first = word[at], np.zeros(len(at), bool)
        for k in range(chain):
            i = np.minimum(nth[at] + k, len(content))
            same = owner[i] == doc[at]
            value = mixed(value * np.uint64(31) + np.where(same, follows[i], np.uint64(k + 1)))
            first = same if k == 0 else first
        return value[first], doc[at][first]

    value, of = chains(np.flatnonzero(common))
    has = np.zeros(len(texts), bool)
    has[of] = True
    more, more_of = chains(np.flatnonzero(~has[doc]))
    value, of = np.concatenate([value, more]), np.concatenate([of, more_of])
    has[more_of] = True
    rest = ~has[doc]
    value, of = np.concatenate([value, word[rest]]), np.concatenate([of, doc[rest]])
    has[doc] = True
    key = np.unique((of.astype(np.uint64) << np.uint64(32)) | (value >> np.uint64(32)))
    cuts = np.searchsorted(key, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(32))
    low = key.astype(np.uint32)
    out = [low[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i in np.flatnonzero(~has):
        if bare := (texts[i] or "").strip():
            out[i] = np.array([int.from_bytes(hashlib.sha256(bare.encode("utf-8", "surrogatepass")).digest()[:4], "big")], np.uint32)
    return out


def as_text(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a look at them if their sizes alone keep it below `least`.

    Two empty sets are equal: 1.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _in_order(docs: DataFrame, id_column: str, text_column: str, rows_per_part: int, most_parts: int) -> DataFrame:
    """Rows dealt to ranges of ids and sorted; each range also gets the row that follows its last one, marked `look`.

    The first id of every range is known beforehand from the ids alone, so the texts are shuffled once.
    """
    n = docs.select(id_column).count()
    parts = max(1, min(most_parts, math.ceil(n / rows_per_part)))
    shares = [k / parts for k in range(parts)]
    firsts = docs.agg(F.percentile_approx(id_column, shares, max(10_000, 20 * parts)), F.min(id_column)).first()
    starts = sorted({*(firsts[0] or []), *([firsts[1]] if firsts[1] is not None else [])})

    @F.pandas_udf("array<int>")
    def parts_of(ids: pd.Series) -> pd.Series:
        """Part, then the part that looks ahead at this row."""
        known, last = np.array(starts, dtype=object if not starts else None), max(len(starts) - 1, 0)
        out = []
        for x in ids.tolist():
            if x is None or x != x:
                out.append([last])
                continue
            k = int(np.searchsorted(known, x, side="right")) - 1
            out.append([k, k - 1 if k else last] if known[k] == x else [k])
        return pd.Series(out)

    return (
        docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
        .select("id", "text", F.posexplode(parts_of("id")).alias("look", "part"))
        .repartition("part").sortWithinPartitions("part", "look", F.col("id").asc_nulls_last(), "text")
    )


def fingerprint(
    docs: DataFrame, chain: int = 2, id_column: str = "doc_id", text_column: str = "text", rows_per_part: int = 1024, most_parts: int = 20_000,
) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness; also the likeness to the next text.

    Rows are in ascending order of id (nulls last, equal ids by text) and the first follows the last. The edited text has its last
    floor(n / 2) code points replaced by the first as many of the next text. Null texts are empty. Repeated rows follow
    each other like any others; a single row follows itself. An empty table gives no rows. Other columns are left out.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = None, None, None  # held: a row that waits for its successor; first: of the part

        def result(rows: list[tuple]) -> pa.RecordBatch:
            """rows: (id, text, signatures, next text, next signatures)."""
            edited = [r[1][: len(r[1]) - len(r[1]) // 2] + r[3][: len(r[1]) // 2] for r in rows]
            sets = signature_sets(edited, chain)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], kind_of), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(edited, pa.string()),
                    pa.array([as_text(r[2]) for r in rows], pa.string()), pa.array([as_text(s) for s in sets], pa.string()),
                    pa.array([likeness(r[2], s) for r, s in zip(rows, sets, strict=True)], pa.float64()),
                    pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
                ],
                names=[id_column, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        kind_of = pa.int64()
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for block in byte_blocks(iter([batch]), "text", 2_000_000):
                texts, out = block["text"].to_pylist(), []
                for row in zip(block["id"].to_pylist(), texts, signature_sets(texts, chain), block["look"].to_pylist(), block["part"].to_pylist(), strict=True):
                    if row[4] != part:
                        if held is not None:
                            out.append((*held[:3], *first[1:3]))
                        part, held, first = row[4], None, row
                        if row[3]:
                            continue
                    if held is not None:
                        out.append((*held[:3], *row[1:3]))
                    held = None if row[3] else row
                if out:
                    yield result(out)
        if held is not None:
            yield result([(*held[:3], *first[1:3])])

    return _in_order(docs, id_column, text_column, rows_per_part, most_parts).select("id", "text", "look", "part").mapInArrow(run, schema)


def length_partition(size: Column, least: float) -> Column:
    """Number of a set's length partition: sizes alike enough for `least` are in the same or in neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def similar(docs: DataFrame, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text", chain: int = 2) -> tuple[DataFrame, DataFrame]:
    """Membership (id, class_id) of equal fingerprints, and pairs (a, b, likeness) of classes at `least` or above.

    Equal fingerprints are one class, named by its smallest id, so copies are never paired. Two classes can only be alike if they
    share a signature among the first of both sets, in order of signature, and if their length partitions touch.
    Rows without id or without signatures are in no pair; an empty table gives two empty tables.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", 2_000_000):
            sets = signature_sets(block["text"].to_pylist(), chain)
            yield pa.RecordBatch.from_arrays([block["id"], pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "signatures"])

    known = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("id is not null")
    sets = known.mapInArrow(run, f"id {kind}, signatures array<long>").withColumn("key", F.sha2(F.concat_ws(",", "signatures"), 256))
    classes = sets.groupBy("key").agg(F.min("id").alias("class_id"), F.any_value("signatures").alias("signatures"))
    members = sets.select("id", "key").join(classes.select("key", "class_id"), "key").select(F.col("id").alias(id_column), "class_id")
    size = F.size("signatures")
    one = classes.filter(size > 0).select("class_id", "signatures", size.alias("n"), length_partition(size, least).alias("lane"))
    prefix = F.slice("signatures", 1, F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    keys = one.select("class_id", "n", "lane", F.explode(prefix).alias("signature"))
    left = keys.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "signature", F.explode(F.array("lane", F.col("lane") + 1)).alias("lane"), F.col("lane").alias("own"))
    right = keys.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "signature", "lane")
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * least - 1e-9) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    found = left.join(right, ["signature", "lane"]).filter(fits).select("a", "b").distinct()
    found = found.join(one.select(F.col("class_id").alias("a"), F.col("signatures").alias("sa")), "a").join(one.select(F.col("class_id").alias("b"), F.col("signatures").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    value = both / (F.size("sa") + F.size("sb") - both)
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), value.alias("likeness")).filter(F.col("likeness") >= least)
    return members, pairs
