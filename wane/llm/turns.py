"""Repair of conversations whose turns are blank, repeated, cut off or out of turn.

The cheapest edits are found as one integer. Its high digits are the cost, its low digits the edits' letters in order, one digit of
three bits each and zeros behind the last, so that of two repairs of one cost the smaller integer has the smaller audit. A place in the
repair is a row number and a state of the pattern `(s?(ua)+)?`; from the last row to the first each place takes the least integer that
its edits offer. An edit puts its letter before the audit of what follows: the digits behind move down by one place only for an
insertion, since consuming a row leaves one place more.

Texts are never brought together: a conversation's rows reach the solver as one character each, and the repaired text is hashed
row by row as it streams by in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wane.llm.common import stored

DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"
#: Costs of the edits, and of leaving a truncated row.
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: What was written so far: nothing, the system's turn, a user's turn, an assistant's turn. For each, initial -> next state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
BITS = 3
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits. Two characters stand for each row: its role's initial (s, u, a, or - for another) and
    its fault (x: must go, t: truncated, or -)."""
    n = len(rows) // 2
    # Deleting all costs 2 a row, so no cheapest repair inserts more than this.
    digits = n + 2 * n // COSTS[INSERT] + 2
    unit = 1 << (BITS * digits)
    low = unit - 1

    def before(value: int | None, edit: int, extra: int, left: int) -> int | None:
        """The edit's letter at the front of an audit that has `left` digits with it."""
        return None if value is None else value + (COSTS[edit] + extra) * unit + (edit << (BITS * (left - 1)))

    def inserted(best: list, left: int) -> list:
        """Each state's best, or an insertion and then the best of the state behind it."""
        out = list(best)
        for q, steps in enumerate(NEXT):
            for initial, p in steps.items():
                if initial in ROLES and best[p] is not None:
                    value = best[p]
                    moved = (value & ~low) | ((value & low) >> BITS)
                    out[q] = least(out[q], before(moved, INSERT, 0, left))
        return out

    def least(a: int | None, b: int | None) -> int | None:
        return b if a is None else a if b is None else min(a, b)

    left = digits - n
    best = [0 if q in ACCEPTED else None for q in range(4)]
    for i in range(n, -1, -1):
        if i < n:
            left += 1
            initial, fault = rows[2 * i], rows[2 * i + 1]
            extra = TRUNCATED if fault == "t" else 0
            now = []
            for q, steps in enumerate(NEXT):
                value = before(best[q], DELETE, 0, left)
                if fault != "x":
                    if initial in steps:
                        value = least(value, before(best[steps[initial]], KEEP, extra, left))
                    for role, p in steps.items():
                        if role in ROLES:
                            value = least(value, before(best[p], REROLE, extra, left))
                now.append(value)
            best = now
        # Two insertions side by side can always be left out, or replaced by a deletion; more need not be looked at.
        best = inserted(inserted(best, left), left)
    value, audit = best[0], []
    for k in range(digits - 1, -1, -1):
        digit = (value & low) >> (BITS * k) & 7
        if digit:
            audit.append(LETTERS[digit])
    return value >> (BITS * digits), "".join(audit)


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone) with planted faults, chosen by crc32 of `conv:turn` modulo 20: 0 drops the row, 1 empties its text,
    2 takes its full stops, exclamation and question marks, 3 repeats it, 4 gives it to the user. Nulls in role, text and the hashed key
    count as one space. A dropped row stays, marked gone."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank)).cast("binary")) % 20
    of, says = F.coalesce(F.col(role), blank), F.coalesce(F.col(text), blank)
    return turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(of).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(says, "[.!?]", "")).otherwise(says).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Rows with their place, initial, fault and whether their pair with the row before is out of turn."""
    in_order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    of_conversation = Window.partitionBy("conv", "gone").orderBy(*in_order)
    # The same partitioning serves both windows: rows of a conversation are together already.
    alike = Window.partitionBy("conv", "gone", "role", "text").orderBy("place")
    letters = F.regexp_replace("text", "[\\x20\\x09-\\x0D]", "")
    initial = F.substring("role", 1, 1)
    return (
        rows.withColumn("place", F.row_number().over(of_conversation)).withColumn("initial", initial)
        .withColumn("pair", F.concat(F.lag("initial").over(of_conversation), "initial"))
        .withColumn("seen", F.row_number().over(alike) > 1)
        .withColumn("fault", F.when(letters == "", "b").when(F.col("seen"), "d").when(~letters.rlike("[.!?]\\z"), "t").otherwise("-"))
    )


def _hashed(stream: DataFrame, schema: str) -> DataFrame:
    """For each conversation of a sorted stream, its marks and the hash of its repaired rows. The row at place 0 brings the marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []

        class Repair:
            """One conversation being written: the audit is followed letter by letter."""

            def __init__(self, marks: dict):
                self.marks, self.audit, self.at, self.state, self.hash, self.first = marks, marks["audit"], 0, 0, hashlib.sha256(), True

            def write(self, role: str, text: str) -> None:
                self.hash.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                self.first = False
                self.state = NEXT[self.state][role[:1]]

            def due(self) -> str:
                return next(c for c in NEXT[self.state] if c in ROLES)

            def insertions(self) -> None:
                while self.audit[self.at : self.at + 1] == "I":
                    self.write(ROLES[self.due()], "")
                    self.at += 1

            def row(self, role: str, text: str) -> None:
                self.insertions()
                edit = self.audit[self.at]
                self.at += 1
                if edit != "D":
                    self.write(role if edit == "K" else ROLES[self.due()], text)

            def end(self) -> dict:
                self.insertions()
                return self.marks | {"repaired_sha256": self.hash.hexdigest()}

        names = None

        def packed() -> pa.RecordBatch:
            columns = [pa.array([d[c] for d in done], kind) for c, kind in names]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c for c, _ in names])

        for batch in batches:
            names = names or [(f.name, f.type) for f in batch.schema if f.name not in ("place", "role", "text")] + [("repaired_sha256", pa.string())]
            marks = [c for c, _ in names[:-1]]
            for k, (place, role, text) in enumerate(zip(*(batch[c].to_pylist() for c in ("place", "role", "text")), strict=True)):
                if place == 0:
                    if held:
                        done.append(held.end())
                    held = Repair({c: batch[c][k].as_py() for c in marks})
                    if len(done) >= 5_000:
                        yield packed()
                else:
                    held.row(role, text)
        if held:
            done.append(held.end())
        if done:
            yield packed()

    return stream.mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) from rows (conv, turn, role, text, gone).

    Rows of a conversation are taken by turn, null turns first, equal turns by role and text; rows marked gone only keep their
    conversation in the result. Null conversations are one conversation. Other columns are left out. A conversation without rows has zeros,
    an empty audit and the hash of no text; an empty table gives no rows. Roles are told by their first character; those with another than
    s, u and a are kept by no repair. Repeated rows are repeats of a turn, so all but the first are duplicates.

    One task follows each conversation in order, since its edits and hash depend on all rows before; it holds no text, and two characters
    for each row.
    """
    found = stored(_faults(rows.select("conv", "turn", "role", "text", "gone")), "turns")
    there = ~F.col("gone")
    count = lambda what: F.count(F.when(there & what, 1))
    numbered = F.when(there, F.col("turn"))
    sign = F.concat(
        F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-"),
        F.when(F.col("fault").isin("b", "d"), "x").otherwise(F.col("fault")))
    marks = found.groupBy("conv").agg(
        F.coalesce(F.max(numbered) - F.min(numbered) + 1 - F.count_distinct(numbered), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == c).cast("long").alias(name) for c, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
        count(F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).cast("long").alias("illegal"),
        F.array_sort(F.collect_list(F.when(there, F.struct("place", sign.alias("sign"))))).alias("signs"),
    ).withColumn("signs", F.array_join(F.transform("signs", lambda x: x["sign"]), ""))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str]] = {}
        for batch in batches:
            signs = batch["signs"].to_pylist()
            if len(known) > 50_000:
                known.clear()
            for s in {*signs} - known.keys():
                known[s] = cheapest(s)
            both = [known[s] for s in signs]
            rest = batch.drop_columns(["signs"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array([c for c, _ in both], pa.int64()), pa.array([a for _, a in both], pa.string())],
                names=[*rest.schema.names, "cost", "audit"])

    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    heads = marks.mapInArrow(solved, schema)
    stream = heads.withColumn("place", F.lit(0)).unionByName(found.filter(there).select("conv", "place", "role", "text"), allowMissingColumns=True)
    return _hashed(stream.repartition("conv").sortWithinPartitions("conv", "place"), schema + ", repaired_sha256 string")


def repair_damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    return repair(damage(turns, conv, turn, role, text)).withColumnRenamed("conv", conv)

