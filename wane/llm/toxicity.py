"""Toxicity scores by a factorization machine over hashed terms.

logit = w0 + sum w_i + sum over pairs i < j of <v_i, v_j>, over the distinct terms of a text, so two terms can weigh more together
than apart. Terms are words, and the first letters of longer words, hashed to 24 bits; the machine keeps those of the sample that enough
documents have and whose share differs between the labels by more than chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wane.llm.common import byte_blocks, give_back, hashed_words, joined_bytes, mixed
from wane.llm.fingerprints import _BYTES

TERM_BITS = 24
#: Bytes of a word that stand for its inflected forms.
PREFIX = 5


def distinct_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Term and text number of each distinct term of each text, by text. A word that recurs in its text is one more term."""
    data, starts = joined_bytes(texts)
    word, doc, head = hashed_words(_BYTES[data], starts, PREFIX)
    word, doc = np.concatenate([word, head[head > 0]]), np.concatenate([doc, doc[head > 0]])
    drop, low = np.uint64(64 - TERM_BITS), np.uint64((1 << TERM_BITS) - 1)
    key, count = np.unique((doc.astype(np.uint64) << np.uint64(TERM_BITS)) | (word >> drop), return_counts=True)
    again = key[count > 1]
    key = np.unique(np.concatenate([key, (again & ~low) | (mixed(again & low) >> drop)]))
    return (key & low).astype(np.int64), (key >> np.uint64(TERM_BITS)).astype(np.int64)


class Machine:
    """Weights of the kept terms, in ascending order of term."""

    def __init__(self, terms: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.linear, self.factors = terms, bias, linear, factors

    def logits(self, term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if not len(self.terms):
            return out
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        at, doc = at[hit], doc[hit]
        out += np.bincount(doc, self.linear[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits(*distinct_terms(texts), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(
    rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, least_documents: int = 8, least_deviation: float = 4.0, factors: int = 4,
    epochs: int = 24, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7,
) -> Machine:
    """Minimize the weighted logistic loss by Adam. rows: the distinct terms of each document.

    A term is kept if at least `least_documents` have it and its shares in the two labels differ by `least_deviation` standard
    errors. Without documents of both labels the machine is constant.
    """
    share = float((labels * weights).sum() / max(weights.sum(), 1e-9)) if len(labels) else 0.0
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    seen, count = np.unique(np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32), return_counts=True)
    toxic = np.zeros(len(seen))
    if labels.any():
        own, times = np.unique(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y]), return_counts=True)
        toxic[np.searchsorted(seen, own)] = times
    n, n1 = len(labels), float(labels.sum())
    n0, p = max(n - n1, 1e-9), count / max(n, 1)
    gap = toxic / max(n1, 1e-9) - (count - toxic) / n0
    with np.errstate(divide="ignore", invalid="ignore"):
        deviation = np.abs(gap) / np.sqrt(p * (1 - p) * (1 / max(n1, 1e-9) + 1 / n0))
    terms = seen[(count >= least_documents) & (deviation >= least_deviation)]
    if not len(terms) or share in (0.0, 1.0):
        return Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, factors)))
    random = np.random.default_rng(seed)
    # Column 0 is linear, the others are factors.
    theta = np.concatenate([np.zeros((len(terms), 1)), random.normal(0, 0.01, (len(terms), factors))], axis=1)
    at = [i[terms[i] == r].astype(np.int32) for r in rows for i in [np.minimum(np.searchsorted(terms, r), len(terms) - 1)]]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    b_first = b_second = 0.0
    step = 0
    weights = weights / weights.mean()
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            term = np.concatenate([at[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), [len(at[i]) for i in pick])
            v = theta[term]
            total = np.stack([np.bincount(doc, v[:, f], len(pick)) for f in range(1 + factors)], axis=1)
            square = np.stack([np.bincount(doc, v[:, f] ** 2, len(pick)) for f in range(1, 1 + factors)], axis=1)
            z = bias + total[:, 0] + 0.5 * (total[:, 1:] ** 2 - square).sum(axis=1)
            error = weights[pick] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[pick]) / len(pick)
            used, back = np.unique(term, return_inverse=True)
            own = error[doc][:, None] * np.concatenate([np.ones((len(term), 1)), total[doc, 1:] - v[:, 1:]], axis=1)
            slope = np.stack([np.bincount(back, own[:, f], len(used)) for f in range(1 + factors)], axis=1) + decay * theta[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * slope
            second[used] = 0.999 * second[used] + 0.001 * slope**2
            pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            theta[used] -= pace * first[used] / (np.sqrt(second[used]) + 1e-8)
            b_first, b_second = 0.9 * b_first + 0.1 * error.sum(), 0.999 * b_second + 0.001 * error.sum() ** 2
            bias -= pace * b_first / (np.sqrt(b_second) + 1e-8)
    return Machine(terms, float(bias), theta[:, 0].copy(), theta[:, 1:].copy())


def learn(
    docs: DataFrame, labels: DataFrame, per_label: int = 6000, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    **settings,
) -> Machine:
    """Fit a machine to a sample of at most `per_label` labelled documents of each label, the first by hash of the id.

    Only their hashed terms reach the driver. Rows without id or label teach nothing, nor do labels of ids that
    `docs` lacks; an id with both labels counts as 1. The two samples are weighted to the shares of the labels in all labelled rows.
    """
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column)).cast("int").alias("y"))
    known = known.join(docs.select(F.col(id_column).alias("id")), "id", "left_semi")
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("id")
    sample = known.filter("y = 0").orderBy(order, "id").limit(per_label).union(known.filter("y = 1").orderBy(order, "id").limit(per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", 4_000_000):
            term, doc = distinct_terms(block["text"].to_pylist())
            cuts = np.searchsorted(doc, np.arange(block.num_rows + 1))
            packed = [term[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block["y"], pa.array(packed, pa.binary())], names=["y", "terms"])

    # Bounded by 2 * per_label rows of two numbers.
    joined = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(sample), "id").select("y", "text")
    got = joined.mapInArrow(run, "y int, terms binary").toArrow().sort_by([("y", "ascending"), ("terms", "ascending")])
    y = got["y"].to_numpy().astype(float)
    # one array for all documents, each a part of it
    sizes = pc.binary_length(got["terms"]).to_numpy() // 4
    terms, ends = np.frombuffer(b"".join(t.as_buffer() for t in got["terms"]), "<i4"), np.cumsum(sizes)
    del got
    rows = [terms[b - n : b] for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
    taken = {k: max(1.0, float((y == k).sum())) for k in (0, 1)}
    weights = np.array([share.get(int(k), 0) / taken[int(k)] for k in y])
    machine = fit(rows, y, weights, **settings)
    del rows, terms
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine, text_column: str = "text", column: str = "score") -> DataFrame:
    """All rows and columns with their score between 0 and 1. Null and empty texts get the score of a text without known terms.

    A column that has the new one's name is replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, text_column, 4_000_000):
            kept = [(n, c) for n, c in zip(block.schema.names, block.columns, strict=True) if n != column]
            scores = pa.array(machine.scores(block[text_column].to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), scores], names=[*(n for n, _ in kept), column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != column)
    return docs.mapInArrow(run, f"{fields}, `{column}` double")
