"""Language of texts by a convolutional network over bytes.

Filters of several widths slide over windows of a fixed number of bytes, each filter keeps its largest value in the window, and a
softmax over those gives the language. Trained in numpy. A text is cut into windows from end to end and their logits
are averaged. With windows of noise as one more class, the network also tells texts that cannot be read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wane.llm.common import byte_blocks, give_back

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Kinds of bytes: letters without case, digits, blanks, other ASCII, and each byte of longer characters by itself.
KINDS = 29 + 128
_KIND = np.array(
    [b - 128 + 29 if b > 127 else ord(chr(b).lower()) - 97 if chr(b).isalpha() else 26 if chr(b).isdigit() else 27 if chr(b).isspace() else 28 for b in range(256)],
    dtype=np.uint8,
)
_BLANK = 27
#: A text is unreadable from this probability on, if it has so many letters at least: less says too little.
UNREADABLE, LEAST_LETTERS = 0.9, 60
#: First characters of stretches of Unicode, from Latin-1 to private use.
_STRETCHES = (0x80, 0x100, 0x370, 0x400, 0x590, 0x600, 0x900, 0xE00, 0x3040, 0x4E00, 0xAC00, 0xE000)


def has_letter(text: str | None) -> bool:
    first = _LETTER.search(text) if text else None
    return first is not None and (first[0].isalpha() or any(c.isalpha() for c in text))  # numbers like ² also match


def windows(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes in windows that cover each text from end to end, the last filled up with blanks, and the text of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-len(r) // size)) for r in raw])
    data = b"".join(r.ljust(int(n) * size) for r, n in zip(raw, counts, strict=True))
    return _KIND[np.frombuffer(data, np.uint8)].reshape(-1, size), np.repeat(np.arange(len(raw)), counts)


def noise(x: np.ndarray, count: int, seed: int = 17) -> np.ndarray:
    """Windows that cannot be read, by turns: the bytes of one of x in any order, any letters, any characters of a stretch of Unicode."""
    random = np.random.default_rng(seed)
    size, out = x.shape[1], []
    for k in range(count):
        blank = random.random(size) < random.random() / 4
        if k % 3 == 0:
            out.append(random.permutation(x[random.integers(len(x))]))
        elif k % 3 == 1:
            out.append(np.where(blank, _BLANK, random.integers(0, 26 + random.integers(0, 2), size)).astype(np.uint8))
        else:
            first = random.choice(_STRETCHES) + random.integers(0, random.choice([32, 64, 128, 1024]), size)
            out.append(windows(["".join(" " if b else chr(c) for b, c in zip(blank, first, strict=True))], size)[0][0])
    return np.array(out, np.uint8).reshape(-1, size)


class Network:
    def __init__(self, languages: list[str], widths: tuple[int, ...], filters: int, size: int, seed: int = 5, rejects: bool = False):
        """rejects: one more class, of what cannot be read, comes after the languages."""
        random = np.random.default_rng(seed)
        self.rejects, self.bar = rejects, UNREADABLE
        self.languages, self.widths, self.filters, self.size = languages, widths, filters, size
        self.weights = {f"conv{w}": random.normal(0, 0.3, (w, KINDS, filters)).astype(np.float32) for w in widths}
        self.weights |= {f"bias{w}": np.zeros(filters, np.float32) for w in widths}
        self.weights |= {"out": random.normal(0, 0.1, (filters * len(widths), len(languages) + rejects)).astype(np.float32), "base": np.zeros(len(languages) + rejects, np.float32)}

    def _pooled(self, x: np.ndarray, w: int) -> np.ndarray:
        """Values of the filters of one width at every place of the windows."""
        e = self.weights[f"conv{w}"]
        n = x.shape[1] - w + 1
        return sum(e[j][x[:, j : j + n]] for j in range(w)) + self.weights[f"bias{w}"]

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        places, best = {}, []
        for w in self.widths:
            z = self._pooled(x, w)
            places[w] = z.argmax(axis=1)
            best.append(np.take_along_axis(z, places[w][:, None], axis=1)[:, 0])
        pooled = np.concatenate(best, axis=1)
        hidden = np.maximum(pooled, 0)
        logits = hidden @ self.weights["out"] + self.weights["base"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        slopes = {"out": hidden.T @ p, "base": p.sum(axis=0)}
        back = (p @ self.weights["out"].T) * (pooled > 0)
        column = np.arange(self.filters)
        for k, w in enumerate(self.widths):
            own = back[:, k * self.filters : (k + 1) * self.filters]
            slope = np.zeros_like(self.weights[f"conv{w}"])
            for j in range(w):
                np.add.at(slope[j], (np.take_along_axis(x, places[w] + j, axis=1), column[None, :]), own)
            slopes |= {f"conv{w}": slope, f"bias{w}": own.sum(axis=0)}
        return slopes

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        count = 0
        for _ in range(epochs):
            order = random.permutation(len(y))
            for k in range(0, len(order), batch):
                count += 1
                pick = order[k : k + batch]
                for name, slope in self.step(x[pick], y[pick]).items():
                    first[name] = 0.9 * first[name] + 0.1 * slope
                    second[name] = 0.999 * second[name] + 0.001 * slope**2
                    pace = rate * np.sqrt(1 - 0.999**count) / (1 - 0.9**count)
                    self.weights[name] = self.weights[name] - (pace * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """The filters as sums over pairs of neighbouring bytes: half as many look-ups at every place."""
        out = {}
        for w in self.widths:
            e = self.weights[f"conv{w}"]
            out[w] = [
                (e[j][:, None, :] + e[j + 1][None, :, :]).reshape(KINDS * KINDS, -1) if j + 1 < w else np.repeat(e[j], KINDS, axis=0)
                for j in range(0, w, 2)
            ]  # a last single byte is looked up by the pair that begins with it
            out[w][0] = out[w][0] + self.weights[f"bias{w}"]
        return out

    def logits(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        pooled = np.empty((len(x), self.filters * len(self.widths)), np.float32)
        for a in range(0, len(x), 64):  # as much as stays in the processor's cache
            part = x[a : a + 64]
            filled = np.concatenate([part, np.full((len(part), 1), _BLANK, np.uint8)], axis=1)
            pair = filled[:, :-1].astype(np.int32) * KINDS + filled[:, 1:]
            for k, w in enumerate(self.widths):
                n = part.shape[1] - w + 1
                z = tables[w][0].take(pair[:, :n], axis=0)
                for j, t in enumerate(tables[w][1:], 1):
                    z += t.take(pair[:, 2 * j : 2 * j + n], axis=0)
                pooled[a : a + 64, k * self.filters : (k + 1) * self.filters] = z.max(axis=1)
        return np.maximum(pooled, 0) @ self.weights["out"] + self.weights["base"]

    def predict(self, texts: list[str | None], tables: dict[int, list[np.ndarray]]) -> tuple[list[str], np.ndarray]:
        """Language and its probability. Null texts and texts without a letter are undetermined, with score 0.

        So are unreadable texts for a network that rejects, with the best language's score; short ones are never.
        """
        letters = np.array([has_letter(t) for t in texts], bool)
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(letters)
        if not len(at) or not self.languages:
            return names, score
        x, of = windows([texts[i] for i in at], self.size)
        z = self.logits(x, tables)
        number = np.bincount(of)
        mean = np.stack([np.bincount(of, z[:, c]) / number for c in range(z.shape[1])], axis=1)
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        unreadable = np.zeros(len(at), bool)
        if self.rejects:
            for k in np.flatnonzero(p[:, -1] >= self.bar):
                unreadable[k] = sum(c.isalpha() for c in texts[at[k]]) >= LEAST_LETTERS
            p = p[:, :-1]
        for i, c in zip(at[~unreadable], p[~unreadable].argmax(axis=1), strict=True):
            names[i] = self.languages[c]
        score[at] = p.max(axis=1)
        return names, score


def learn(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", per_language: int = 800,
    most_documents: int = 8000, windows_each: int = 3, size: int = 256, widths: tuple[int, ...] = (2, 3, 4), filters: int = 8, noise_share: float = 0.0, **settings,
) -> Network:
    """Train on a sample: up to `per_language` documents of each language and `most_documents` in all, first by hash of id and text,
    and `windows_each` windows spread over each whole text. Rows without text or language, or without a letter, teach nothing.
    With `noise_share`, so many windows of noise for each of these are a class of their own, and the network rejects what is like
    them. The bar is raised above nine tenths of the windows of every language, so that none is taken for noise as a whole.
    """
    rows = docs.select(F.col(language_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(id_column, text_column).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keys = rows.select("lang", "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= per_language)
    keys = keys.orderBy("n", "h", "lang").limit(most_documents).select("lang", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", 4_000_000):
            out = []
            for lang, text, h in zip(*(block[c].to_pylist() for c in ("lang", "text", "h")), strict=True):
                x, _ = windows([text], size)
                for k in np.unique(np.linspace(0, len(x) - 1, windows_each).astype(int)):
                    out.append((lang, h, x[k].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out]) for i in range(3)], names=["lang", "h", "window"])

    # Bounded by most_documents rows of a name and a number.
    got = rows.join(F.broadcast(keys), ["lang", "h"]).select("lang", "text", "h").mapInArrow(run, "lang string, h long, window binary").toArrow()
    got = got.sort_by([(c, "ascending") for c in got.column_names])
    names, raw = got["lang"].to_pylist(), b"".join(w.as_buffer() for w in got["window"])
    del got
    languages = sorted(set(names))
    network = Network(languages, widths, filters, size, rejects=noise_share > 0)
    if len(languages) > 1 or languages and network.rejects:
        number = {name: k for k, name in enumerate(languages)}
        x, y = np.frombuffer(raw, np.uint8).reshape(-1, size), np.array([number[n] for n in names])
        if network.rejects:
            more = noise(x, max(3, int(noise_share * len(x))))
            network.train(np.concatenate([x, more]), np.concatenate([y, np.full(len(more), len(languages))]), **settings)
            z = network.logits(x, network.tables()).astype(float)
            p = 1 / np.exp(z - z[:, -1:]).sum(axis=1)
            network.bar = max([UNREADABLE, *(float(np.quantile(p[y == k], 0.9)) for k in range(len(languages)))])
        else:
            network.train(x, y, **settings)
        give_back()
    return network


def identify(docs: DataFrame, network: Network, text_column: str = "text", language: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All rows and columns with predicted language and score. Columns that have the new ones' names are replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for block in byte_blocks(batches, text_column, 2_000_000):
            kept = [(n, c) for n, c in zip(block.schema.names, block.columns, strict=True) if n not in (language, score)]
            names, scores = network.predict(block[text_column].to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(n for n, _ in kept), language, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in (language, score))
    return docs.mapInArrow(run, f"{fields}, `{language}` string, `{score}` double")
