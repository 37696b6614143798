"""Suffix arrays of many short texts at once by Lyndon grouping, in numpy.

Every suffix belongs to the group of its longest Lyndon prefix. Groups are found from the highest to the lowest: when a
group is final, each of its members extends the prefix of the nearest earlier suffix in a lower group (its previous smaller
suffix), and the suffixes so extended move up into groups of their own, the more copies they absorb the higher. One pass over
the sorted suffixes, from the lowest, then writes each group's order: the previous smaller suffixes of a sorted suffix's
predecessor take the next free places of their groups. Nothing is renamed and nothing recursive is solved. All texts of a
batch take their n-th step together, so the steps are array operations.
"""

from __future__ import annotations

import numpy as np

from wane.llm.common import runs


def suffix_arrays(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sorted suffix positions of each text, one text after another.

    text: small integers, each text ending in 0, which occurs nowhere else in it; starts: where texts begin, and the total length.
    """
    n = len(text)
    begin, ends = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
    of = np.repeat(np.arange(len(begin)), ends - begin)
    floor = begin[of]
    order = np.argsort(of * (int(text.max()) + 1 if n else 1) + text, kind="stable")  # suffixes by group
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (text[order[1:]] != text[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    heads = np.flatnonzero(fresh)
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    group = np.empty(n, np.int64)  # where the group of each suffix begins in order
    group[order] = np.repeat(heads, size[heads])
    before = np.arange(n) - 1  # previous smaller suffix, as far as known
    moved = np.zeros(n, bool)

    cursor = ends.copy()
    active = np.flatnonzero(cursor > begin)
    while len(active):
        top = group[order[cursor[active] - 1]]
        member = order[runs(top, cursor[active] - top)]
        level, low = group[member], floor[member]
        p = before[member]
        while True:
            go = np.flatnonzero((p >= low) & (group[np.maximum(p, 0)] >= level))
            if not len(go):
                break
            p[go] = before[p[go]]
        before[member] = p
        cursor[active] = top
        active = active[top > begin[active]]
        p = np.sort(p[p >= low])
        if not len(p):
            continue
        first = np.ones(len(p), bool)
        first[1:] = p[1:] != p[:-1]
        at = np.flatnonzero(first)
        p, copies = p[at], np.diff(np.append(at, len(p)))
        by = np.lexsort((copies, group[p]))
        p, copies, old = p[by], copies[by], group[p[by]]
        new_old = np.ones(len(p), bool)
        new_old[1:] = old[1:] != old[:-1]
        at = np.flatnonzero(new_old)
        count = np.diff(np.append(at, len(p)))
        g = old[at]
        tail = g + size[g] - count
        slots = runs(tail, count)
        moved[p] = True
        out = order[slots]
        out = out[~moved[out]]
        free = place[p]
        free = free[free < np.repeat(tail, count)]
        moved[p] = False
        # Both lists run group by group with equal numbers in each.
        free = free[np.argsort(free, kind="stable")]
        order[free], place[out] = out, free
        order[slots], place[p] = p, slots
        size[g] -= count
        new = new_old.copy()
        new[1:] |= copies[1:] != copies[:-1]
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(p)))
        size[slots[at]] = length
        group[p] = np.repeat(slots[at], length)

    sorted_at = np.full(n, -1, np.int64)
    done = np.zeros(n, bool)
    front = np.arange(n)
    sorted_at[begin] = ends - 1
    done[ends - 1] = True
    longest = int((ends - begin).max()) if len(begin) else 0
    turn = np.argsort(begin - ends, kind="stable")  # longest first
    begin, length, alive = begin[turn], (ends - begin)[turn], len(turn)
    for r in range(longest):
        while length[alive - 1] <= r:
            alive -= 1
        i = sorted_at[begin[:alive] + r]
        low = begin[:alive]
        j = i - 1
        while True:
            keep = (j >= low) & ~done[np.maximum(j, 0)]
            if not keep.any():
                break
            j, low = j[keep], low[keep]
            done[j] = True
            g = group[j]
            sorted_at[front[g]] = j
            front[g] += 1
            j = before[j]
    return sorted_at
