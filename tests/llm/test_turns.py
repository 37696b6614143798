"""Conversation repair against an exhaustive search and stated cases."""

import hashlib
import itertools
import random
import re
import zlib

from wane.llm import turns

PATTERN = re.compile("(s?(ua)+)?")


def exhaustive(rows):
    """Least (cost, audit) over all edits of a few rows, at most two insertions at a place."""
    choices = []
    for initial, fault in rows:
        extra = 5 if fault == "t" else 0
        own = [("D", 2, "")]
        if fault != "x":
            own += [("K", extra, initial), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        choices.append(own)
    best = None
    inserts = [("".join(p)) for k in range(3) for p in itertools.product("ua", repeat=k)]
    for picked in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", ""
            for k in range(len(rows) + 1):
                cost, audit, out = cost + 5 * len(put[k]), audit + "I" * len(put[k]), out + put[k]
                if k < len(rows):
                    letter, c, initial = picked[k]
                    cost, audit, out = cost + c, audit + letter, out + initial
            if PATTERN.fullmatch(out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_cheapest_edits_equal_exhaustive_search():
    kinds = [i + f for i in "sua-" for f in "xt-"]
    cases = [[], *([k] for k in kinds), *itertools.product(kinds, repeat=2)]
    cases += [[random.Random(k).choice(kinds) for _ in range(3)] for k in range(12)]
    for case in cases:
        assert turns.cheapest("".join(case)) == exhaustive([tuple(k) for k in case]), case


def test_long_conversations_keep_one_integer_each():
    cost, audit = turns.cheapest("s-" + "u-a-" * 1500 + "u-")
    assert (cost, len(audit)) == (2, 3002) and audit.count("D") == 1
    assert turns.cheapest("u-" * 7)[0] == 5  # three new roles, and the last turn goes
    assert turns.cheapest("ux" * 40) == (80, "D" * 40)


ROWS = [
    (1, 1, "user", "Hello."), (1, 2, "assistant", "Yes!"),
    (2, None, None, None), (2, 3, "", "x."), (2, 3, "user", " \t"), (2, 9, "system", "Be kind."),
    (None, 1, "user", "a."), (None, 2, "user", "a."), (3, 1, "user", "word " * 40_000),
    (4, 5, "assistant", "ok.\n"), (4, 5, "assistant", "ok.\n"), (5, 2, "Übung", "."),
]


def plain(rows):
    """The same answers row by row, damage included."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        by.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        numbers, seen, sign, count = [t for t, *_ in found if t is not None], set(), "", {"b": 0, "d": 0, "t": 0, "-": 0}
        for _, role, text in found:
            bare = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
            count[fault] += 1
            sign += (role[:1] if role[:1] in ("s", "u", "a") else "-") + ("x" if fault in "bd" else fault)
        cost, audit = turns.cheapest(sign)
        left, lines, state = list(found), [], ""
        for letter in audit:
            due = "a" if state == "u" else "u"
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[due])
                state = due
                continue
            _, role, text = left.pop(0)
            if letter != "D":
                role = role if letter == "K" else {"u": "user", "a": "assistant"}[due]
                lines.append(f"{role}:{text}")
                state = role[:1]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(found)]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count["b"], count["d"], count["t"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair_of_odd_rows(spark):
    r = random.Random(5)
    rows = ROWS + [(100 + r.randrange(150), r.randrange(6), r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", "", "c!", "d?"])) for _ in range(900)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "conv_id long, turn long, role string, text string, place string, conv int")
    got = {x["conv_id"]: tuple(x)[1:] for x in turns.repair_damaged(df).collect()}
    assert got == plain(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert turns.repair_damaged(empty).collect() == []
    gone = spark.createDataFrame([("c", 1, "user", "x.", True)], "conv string, turn int, role string, text string, gone boolean")
    assert [tuple(x) for x in turns.repair(gone).collect()] == [("c", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
