"""Word model of hierarchical Pitman-Yor processes, sampled by Gibbs in Chinese restaurants.

A word's context is the word before it (the begin of a text is a word). Each context has a restaurant, and all share one parent
restaurant of words without context, whose base is uniform over the known words and one unknown. A customer of a context either
joins a table of its dish or opens one, which sends a customer to the parent; contexts with few customers mostly follow the parent.

Each block of texts sends its distinct (word, context) pairs with their counts to shards by hash of the word, so counts, tables and
the parent's probabilities of a word are local. The most frequent words are dealt by pair instead, and their sums added up on
the driver: no shard holds more than a thousandth of the tokens for the sake of one word. Customers and tables of contexts are a table, dealt by context: after each
sweep shards send it what they hold, and it answers each shard with the sums. Only the parent's totals pass through the driver. A sweep
seats each dish of each restaurant anew given all others. Predictive probabilities are averaged over the samples and go back
to the blocks, in the order of their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wane.llm.common import byte_blocks, discard, hashed_words, joined_bytes, mixed, stored, stored_apart

#: Words of their own: the end of a text, and what stands before its first word.
END, BEGIN = np.uint64(0x51ED270B9A3C15D7), np.uint64(0x1B56C4E9A1D2F083)
#: Bytes of texts for each shard at most on average, and those in which frequent words are looked for.
SHARD_BYTES, SAMPLE_BYTES = 12_000_000, 8_000_000


def _zip(*arrays: np.ndarray) -> bytes:
    """Hashes as they are; of other numbers the lowest bytes of all first, then the next ones: these compress better."""
    flat = (a if a.dtype == np.uint64 else a.view(np.uint8).reshape(-1, a.itemsize).T for a in map(np.ascontiguousarray, arrays))
    return pa.compress(b"".join(a.tobytes() for a in flat), codec="zstd", asbytes=True)


def _unzip(raw: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize * n for k, n in kinds]
    data, out, at = pa.decompress(raw, decompressed_size=sum(sizes), codec="zstd", asbytes=True), [], 0
    for (k, n), s in zip(kinds, sizes, strict=True):
        part = np.frombuffer(data, np.uint8, s, at)
        kind = np.dtype(k)
        out.append(part.view(kind) if kind == np.uint64 else np.ascontiguousarray(part.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += s
    return out


def tokens(texts: list[str | None], contexts: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context and text of every token in order: the words of each text, then its end."""
    data, starts = joined_bytes(texts)
    word, doc = hashed_words(data, starts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    at = np.arange(len(word)) + doc  # one end after each earlier text
    out = np.full(len(word) + n, END, np.uint64)
    of = np.repeat(np.arange(n, dtype=np.int32), count + 1)
    out[at] = word
    last = np.cumsum(count + 1)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[np.concatenate(([0], last[:-1]))] = BEGIN
    before = mixed(before ^ BEGIN)
    return out, before if contexts is None else mixed(before % np.uint64(contexts)), of


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Number of the part that a hash is dealt to; it grows with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _frequent(docs: DataFrame, most: int, share: int) -> np.ndarray:
    """The `most` words with most tokens in one of `share` texts, ascending. They decide where pairs go, not what is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", 2_000_000):
            word, count = np.unique(tokens(block["text"].to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count.astype(np.int64))], names=["word", "n"])

    some = docs.filter(F.pmod(F.xxhash64("id", "text"), F.lit(share)) == 0).select("text")
    counts = some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()], np.int64).view(np.uint64))


def _dealt(docs: DataFrame, kind: str, contexts: int | None, shards: int, block_bytes: int, frequent: np.ndarray) -> DataFrame:
    """Distinct (word, context) pairs of blocks of texts with training counts, packed, by shard of the word, or of the pair if it is frequent.

    A row with shard -1 lists the block's texts, and packed the numbers of their tokens' pairs, ascending in each text, as steps (the first
    of a text from 0): those of the first shard come first. slot: the shard, or for texts one below 0 of the block's own.
    docs: (id, text, held).
    """
    schema = f"slot long, shard int, block long, n int, packed binary, ids array<{kind}>, held array<boolean>, sizes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, turn = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], []

        def packed() -> pa.RecordBatch:
            nonlocal turn
            word, context, of = tokens(texts, contexts)
            teaches = ~np.array(held)[of]
            order = np.lexsort((context, word))
            word, context, teaches = word[order], context[order], teaches[order]
            pair = np.ones(len(word), bool)
            pair[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
            pairs = np.flatnonzero(pair)
            taught = np.add.reduceat(teaches.astype(np.int64), pairs)
            number = np.empty(len(word), np.int64)
            number[order] = np.cumsum(pair) - 1
            word, context = word[pairs], context[pairs]
            shard = np.where(np.isin(word, frequent), _part(mixed(word ^ mixed(context)), shards), _part(word, shards))
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            number, word, context, taught = place[number], word[order], context[order], taught[order]
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            number = np.sort(of.astype(np.int64) << 32 | number) & 0xFFFFFFFF
            step, begins = np.diff(number, prepend=0), np.flatnonzero(np.diff(of, prepend=-1))
            step[begins] = number[begins]
            rows = [(-1, len(number), _zip(step.astype("<u4")), ids, held, np.bincount(of, minlength=len(texts)).tolist())]
            for s in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[s], cuts[s + 1]
                rows.append((s, b - a, _zip(word[a:b], context[a:b], taught[a:b].astype("<u4")), None, None, None))
            block = first + turn
            turn += 1
            columns = [pa.array([r[0] if r[0] >= 0 else -1 - block for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())]
            columns += [pa.array([r[3] for r in rows], pa.list_(id_kind)), pa.array([r[4] for r in rows], pa.list_(pa.bool_())), pa.array([r[5] for r in rows], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "block", "n", "packed", "ids", "held", "sizes"])

        size, id_kind = 0, pa.int64()
        for block in byte_blocks(batches, "text", 2_000_000):
            id_kind = block.schema.field(0).type
            ids += block["id"].to_pylist()
            texts += block["text"].to_pylist()
            held += block["held"].to_pylist()
            size += block["text"].nbytes
            if size >= block_bytes:
                yield packed()
                ids, texts, held, size = [], [], [], 0
        if ids:
            yield packed()

    return docs.mapInArrow(run, schema)


def _shards(dealt: DataFrame) -> DataFrame:
    """Of each shard one row of its distinct pairs (block null), and one for each block with the numbers of its pairs there. Rows of texts
    stay as they are.

    The pairs are packed as number of the word, number of the context and training count; the words and contexts follow. A block's
    numbers ascend and are packed as steps.
    """
    kind = dealt.schema["ids"].dataType.simpleString()
    schema = f"slot long, shard int, block long, n int, words int, contexts int, pairs binary, ids {kind}, held array<boolean>, sizes array<long>"

    def merge(table: pa.Table) -> pa.Table:
        like = table.schema
        if table["shard"][0].as_py() >= 0:
            shard, blocks, sizes = table["shard"][0].as_py(), table["block"].to_pylist(), table["n"].to_pylist()
            parts = [_unzip(raw, ("<u8", n), ("<u8", n), ("<u4", n)) for n, raw in zip(sizes, table["packed"].to_pylist(), strict=True)]
            word, context, taught = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((context, word))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (word[order][1:] != word[order][:-1]) | (context[order][1:] != context[order][:-1])
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(fresh) - 1
            at = order[fresh]
            words, of_word = np.unique(word[at], return_inverse=True)
            contexts, of_context = np.unique(context[at], return_inverse=True)
            pairs = _zip(of_word.astype("<u4"), of_context.astype("<u4"), np.bincount(number, taught).astype("<u4"), words, contexts)
            cuts = np.cumsum([0, *sizes])
            rows = [(shard, shard, None, len(at), len(words), len(contexts), pairs)]
            rows += [(shard, shard, b, n, 0, 0, _zip(np.diff(number[a : a + n], prepend=0).astype("<u4"))) for b, n, a in zip(blocks, sizes, cuts[:-1], strict=True)]
        else:
            rows = [(r["slot"], r["shard"], r["block"], r["n"], 0, 0, r["packed"]) for r in table.select(["slot", "shard", "block", "n", "packed"]).to_pylist()]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        for name in ("ids", "held", "sizes"):
            columns.append(pa.nulls(len(rows), like.field(name).type) if rows[0][1] >= 0 else table[name].combine_chunks())
        return pa.table(columns, names=["slot", "shard", "block", "n", "words", "contexts", "pairs", "ids", "held", "sizes"])

    return dealt.groupBy("slot").applyInArrow(merge, schema)


def tables_of(count: np.ndarray, rate: np.ndarray, strength: float, discount: float, others: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Tables of one dish in each restaurant when all its customers take seats one after another.

    rate: the parent's probability of the dish; others: the restaurant's tables of other dishes. A customer opens a table with weight
    (strength + discount * tables) * rate against (customers - discount * its tables). Long queues sit down in runs of a
    sixteenth of those seated, whose chances differ little: a binomial draw for each run.
    """
    t = (count > 0).astype(float)
    left = np.argsort(-count, kind="stable")
    sizes = count[left]
    n = 1.0
    while True:
        alive = int(np.searchsorted(-sizes, -n, side="left"))  # those with more than n customers
        if not alive:
            return t
        at = left[:alive]
        run = max(1.0, np.floor(n / 16))
        step = np.minimum(run, count[at] - n)
        opens = (strength + discount * (others[at] + t[at])) * rate[at]
        stays = np.maximum(n + (step - 1) / 2 - discount * t[at], 1e-9)
        t[at] += random.binomial(step.astype(np.int64), np.clip(opens / (opens + stays), 0, 1))
        n += run


class Model:
    """Totals of all restaurants after each sweep; a shard's own tables are drawn again from them with its seed."""

    def __init__(self, contexts: int, strengths: tuple[float, float], discounts: tuple[float, float], sweeps: int, burn_in: int, seed: int):
        self.contexts, self.strengths, self.discounts, self.sweeps, self.burn_in, self.seed = contexts, strengths, discounts, sweeps, burn_in, seed
        self.customers = np.zeros(contexts)
        self.known = 0
        self.states: list[tuple[np.ndarray, float, float]] = []  # tables of each context, the parent's customers and tables
        # Numbers of words that other shards have too, and their customers and tables at the parent in each state.
        self.shared, self.whole = np.empty(0, np.int64), []

    def replay(self, shard: int, word: np.ndarray, context: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """After the start and after each sweep known so far: tables of the pairs, customers and tables of the words at the parent.

        word: number of each pair's word, ascending.
        """
        random = np.random.default_rng((self.seed, shard))
        words = int(word[-1]) + 1 if len(word) else 0
        taught = count > 0
        t = taught.astype(float)
        up = np.bincount(word, t, words)
        s = (up > 0).astype(float)
        yield t, up, s
        for k, (tables, customers, parents) in enumerate(self.states):
            up, s = self.joined(k, up, s)
            rate = self.parent(up, s, customers, parents)[word]
            t = np.where(taught, tables_of(count, rate, self.strengths[1], self.discounts[1], np.maximum(tables[context] - t, 0), random), 0)
            up = np.bincount(word, t, words)
            s = tables_of(up, np.full(words, 1 / (self.known + 1)), self.strengths[0], self.discounts[0], np.maximum(parents - s, 0), random)
            yield t, up, s

    def joined(self, k: int, up: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the words at the parent in a state, with what other shards have."""
        if len(self.shared):
            up, s = up.copy(), s.copy()
            up[self.shared], s[self.shared] = self.whole[k]
        return up, s

    def parent(self, up: np.ndarray, s: np.ndarray, customers: float, parents: float) -> np.ndarray:
        strength, discount = self.strengths[0], self.discounts[0]
        return (np.maximum(up - discount * s, 0) + (strength + discount * parents) / (self.known + 1)) / (strength + customers)

    def chances(self, shard: int, word: np.ndarray, context: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of each pair's word in its context, averaged over the sweeps after burn-in."""
        total, n = np.zeros(len(word)), 0
        strength, discount = self.strengths[1], self.discounts[1]
        for k, (t, up, s) in enumerate(self.replay(shard, word, context, count)):
            if k < self.burn_in or k >= len(self.states):
                continue
            tables, customers, parents = self.states[k]
            up, s = self.joined(k, up, s)
            rate = self.parent(up, s, customers, parents)[word]
            here = self.customers[context]
            total += (np.maximum(count - discount * t, 0) + (strength + discount * tables[context]) * rate) / (strength + here)
            n += 1
        return total / max(n, 1)


class Totals:
    """The parent's customers, tables, known words and all training tokens after a sweep; customers, tables and tokens of frequent words."""

    def __init__(self, sums: np.ndarray, last: Totals | None, settings: tuple, shards: int, sweep: int):
        strengths, discounts, *_, seed = settings
        self.up, self.count = np.split(sums[4:], 2)
        self.known, self.tokens = int(sums[2] + (self.count > 0).sum()), int(sums[3])
        self.tables = (self.up > 0).astype(float)
        if last and len(self.up):
            others = np.maximum(last.parents - last.tables, 0)
            self.tables = tables_of(self.up, np.full(len(self.up), 1 / (self.known + 1)), strengths[0], discounts[0], others, np.random.default_rng((seed, shards, sweep)))
        self.customers, self.parents = float(sums[0] + self.up.sum()), float(sums[1] + self.tables.sum())


class Shard:
    """A shard's pairs, and the model as far as it is known: `answers` are rows (sweep, part, n, packed) of the contexts' table."""

    def __init__(self, row, answers: pd.DataFrame, totals: list[Totals], settings: tuple, parts: int, frequent: np.ndarray):
        n = row["n"]
        self.number = int(row["shard"])
        word, context, count, self.words, self.contexts = _unzip(row["pairs"], ("<u4", n), ("<u4", n), ("<u4", n), ("<u8", row["words"]), ("<u8", row["contexts"]))
        self.word, self.context, self.count = word.astype(np.int64), context.astype(np.int64), count.astype(float)
        self.cuts = np.searchsorted(_part(self.contexts, parts), np.arange(parts + 1))
        self.model = Model(len(self.contexts), *settings)
        tables = np.zeros((len(totals), len(self.contexts)))
        for sweep, part, m, raw in answers[["sweep", "part", "n", "packed"]].itertuples(index=False):
            customers, tables[sweep, self.cuts[part] : self.cuts[part + 1]] = _unzip(raw, ("<i8", m), ("<i8", m))
            self.model.customers[self.cuts[part] : self.cuts[part + 1]] = customers
        self.model.shared = np.flatnonzero(np.isin(self.words, frequent))
        self.among = np.searchsorted(frequent, self.words[self.model.shared])
        for k, x in enumerate(totals):
            self.model.known = x.known
            self.model.states.append((tables[k], x.customers, x.parents))
            self.model.whole.append((x.up[self.among], x.tables[self.among]))


#: What the contexts' table answers in place of a shard: sums for Totals.
_PARENT = -1


def _swept(shards: DataFrame, answers: DataFrame | None, totals: list[Totals], settings: tuple, parts: int, frequent: np.ndarray) -> DataFrame:
    """One more sweep, and the table of contexts after it: customers and tables, summed by context and sent to each shard that has it."""
    sent = "part int, shard int, n int, packed binary"
    sweep = len(totals)

    def seat(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = Shard(left.iloc[0], right, totals, settings, parts, frequent)
        for t, up, tables in s.model.replay(s.number, s.word, s.context, s.count):
            pass
        size = len(s.contexts)
        customers, own = (np.bincount(s.context, x, size).astype("<i8") for x in (s.count, t))
        count, shared = np.bincount(s.word, s.count), s.model.shared
        alone, sums = np.ones(len(s.words), bool), np.zeros(4 + 2 * len(frequent))
        alone[shared] = False
        sums[:4] = up[alone].sum(), tables[alone].sum(), (count[alone] > 0).sum(), s.count.sum()
        sums[4 + s.among], sums[4 + len(frequent) + s.among] = up[shared], count[shared]
        rows = [(_PARENT, s.number, len(sums), _zip(sums))]
        for p in np.flatnonzero(np.diff(s.cuts)):
            a, b = s.cuts[p], s.cuts[p + 1]
            rows.append((p, s.number, b - a, _zip(s.contexts[a:b], customers[a:b], own[a:b])))
        return pd.DataFrame(rows, columns=["part", "shard", "n", "packed"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] == _PARENT:
            sums = sum(_unzip(raw, ("<f8", n))[0] for n, raw in zip(pdf["n"], pdf["packed"], strict=True))
            rows = [(_PARENT, sweep, _PARENT, len(sums), _zip(sums))]
        else:
            got = [_unzip(raw, ("<u8", n), ("<i8", n), ("<i8", n)) for n, raw in zip(pdf["n"], pdf["packed"], strict=True)]
            _, number = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            customers, tables = (np.bincount(number, np.concatenate([g[i] for g in got])).astype("<i8")[number] for i in (1, 2))
            cuts = np.cumsum([0, *pdf["n"]])
            rows = [(shard, sweep, key[0], n, _zip(customers[a : a + n], tables[a : a + n])) for shard, n, a in zip(pdf["shard"], pdf["n"], cuts[:-1], strict=True)]
        return pd.DataFrame(rows, columns=["shard", "sweep", "part", "n", "packed"])

    pairs = shards.filter("block is null").select("slot", "shard", "n", "words", "contexts", "pairs")
    if answers is None:
        nothing = pd.DataFrame(columns=["sweep", "part", "n", "packed"])
        seated = pairs.groupBy("slot").applyInPandas(lambda pdf: seat((), pdf, nothing), sent)
    else:
        seated = pairs.groupBy("slot").cogroup(_by_slot(answers)).applyInPandas(seat, sent)
    return seated.groupBy("part").applyInPandas(add, _ANSWER)


def _by_slot(answers: DataFrame):
    """Answers to shards, to meet them where they are."""
    return answers.filter(F.col("shard") >= 0).withColumn("slot", F.col("shard").cast("long")).groupBy("slot")


_ANSWER = "shard int, sweep int, part int, n int, packed binary"


def score(
    docs: DataFrame, held_out, contexts: int | None = None, strengths: tuple[float, float] = (50.0, 5.0), discounts: tuple[float, float] = (0.5, 0.8),
    sweeps: int = 3, burn_in: int = 1, shards: int | None = None, block_bytes: int = 12_000_000, seed: int = 3, most_frequent: int = 1000, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    The model learns from the rows where `held_out` (a column) is not true. base_score is that of words alone with one added to every
    count. Each word before another is a context of its own; with `contexts`, they are merged into so many classes. Null and blank
    texts are one end. Null ids and repeated rows are scored like others. Without rows to learn from, every word is unknown. An
    empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Blocks send a row to every shard that has words of theirs: as many shards for small inputs, or that traffic grows faster than they do.
    shards = shards or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    frequent = _frequent(rows, most_frequent, max(1, size // SAMPLE_BYTES))
    # Texts and shards lie in buckets of their slots, and are not dealt again: only what is sent between them is.
    dealt = _shards(_dealt(rows, kind, contexts, shards, block_bytes, frequent))
    texts, by_shard, of_shards = stored_apart(dealt, "lm-shards", F.col("slot") < 0, "slot", shards)
    settings, answers = (strengths, discounts, sweeps, burn_in, seed), None
    totals: list[Totals] = []
    swept: list[DataFrame] = []
    for sweep in range(sweeps + 1):
        table = stored(_swept(by_shard, answers, totals, settings, shards, frequent), "lm-contexts")
        swept.append(table)
        answers = table if answers is None else answers.union(table)
        parent = table.filter(F.col("shard") == _PARENT).first()
        sums = _unzip(parent["packed"], ("<f8", parent["n"]))[0] if parent else np.zeros(4 + 2 * len(frequent))
        totals.append(Totals(sums, totals[-1] if totals else None, settings, shards, sweep))
    total = totals[-1].tokens
    unseen = 1.0 / (total + totals[-1].known + 1)

    def chances(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        alone = left["block"].isna()
        s = Shard(left[alone].iloc[0], right, totals, settings, shards, frequent)
        count = np.bincount(s.word, s.count)
        count[s.model.shared] = totals[-1].count[s.among]
        own, chance = count[s.word].astype("<i8"), s.model.chances(s.number, s.word, s.context, s.count)
        out = []
        for block, n, raw in left[~alone][["block", "n", "pairs"]].itertuples(index=False):
            pair = np.cumsum(_unzip(raw, ("<u4", n))[0], dtype=np.int64)
            out.append((int(block), s.number, n, _zip(own[pair], chance[pair])))
        return pd.DataFrame(out, columns=["block", "shard", "n", "packed"])

    # Blocks are numbered beyond what a double holds exactly; text keeps them whole next to nulls in pandas.
    named = by_shard.select("slot", "shard", F.col("block").cast("string").alias("block"), "n", "words", "contexts", "pairs")
    judged = stored(named.groupBy("slot").cogroup(_by_slot(answers)).applyInPandas(chances, "block long, shard int, n int, packed binary"), "lm-chances")
    discard(spark, of_shards, *swept)
    schema = f"`{id_column}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def gather(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, right = left.iloc[0], right.sort_values("shard")
        parts = [_unzip(raw, ("<i8", m), ("<f8", m)) for m, raw in zip(right["n"], right["packed"], strict=True)]
        own, chance = (np.concatenate([p[i] for p in parts]) for i in range(2))
        step, = _unzip(row["pairs"], ("<u4", row["n"]))
        sizes = np.asarray(row["sizes"])
        starts = np.cumsum(sizes) - sizes
        ends = np.cumsum(step, dtype=np.int64)
        pair = ends - np.repeat(ends[starts] - step[starts], sizes)
        base, score, known = (np.add.reduceat(x[pair], starts) for x in (np.log10((own + 1) * unseen), np.log10(chance), (own > 0).astype(np.int64)))
        return pd.DataFrame({id_column: pd.Series(list(row["ids"]), dtype=object), "held_out": list(row["held"]), "n_tokens": sizes, "n_known": known, "train_tokens": total, "base_score": base, "score": score})

    texts = texts.select("slot", "n", "pairs", "ids", "held", "sizes")
    return texts.groupBy("slot").cogroup(judged.withColumn("slot", -1 - F.col("block")).groupBy("slot")).applyInPandas(gather, schema)
