"""Word shingles as 64-bit hashes and tensored minhash keys, in numpy."""

from __future__ import annotations

import numpy as np

from wane.llm.common import hashed_words, joined_bytes, mixed


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the start of each text in them (one more at the end).

    A text of fewer words than `width` has one shingle, the whole sequence; a text without words has none.
    """
    data, starts = joined_bytes(texts)
    word, doc = hashed_words(data, starts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    begin = np.cumsum(count) - count
    if not len(word):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    value = np.zeros(len(word), np.uint64)
    left = (begin + count)[doc] - np.arange(len(word))  # words from here to the end of the text
    for k in range(width):
        shifted = np.roll(word, -k)
        value = np.where(left > k, mixed(value * np.uint64(0x100000001B3) + shifted), value)
    keep = (left >= width) | ((count < width)[doc] & (left == count[doc]))
    value, of = value[keep], doc[keep]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[fresh], of[fresh]
    return value, np.searchsorted(of, np.arange(n + 1))


def collections(value: np.ndarray, cuts: np.ndarray, number: int, size: int, seed: int = 97) -> np.ndarray:
    """`number` collections of `size` minhashes for each text, one hash each; rows of texts without shingles are 0."""
    n = len(cuts) - 1
    out = np.zeros((n, number), np.uint64)
    full = np.flatnonzero(np.diff(cuts) > 0)
    if not len(full):
        return out
    odd = np.random.default_rng(seed).integers(1, 2**63, (number, size, 2), dtype=np.uint64) | np.uint64(1)
    at = cuts[:-1][full]
    for i in range(number):
        joint = np.full(len(full), np.uint64(i + 1))
        for j in range(size):
            least = np.minimum.reduceat((value ^ odd[i, j, 1]) * odd[i, j, 0], at)
            joint = mixed(joint * np.uint64(0x100000001B3) + least)
        out[full, i] = joint
    return out


def set_digest(value: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the mixed members of each set: equal sets have equal digests."""
    sums = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mixed(value ^ salt), dtype=np.uint64)))
        sums.append(total[cuts[1:]] - total[cuts[:-1]])
    return sums[0], sums[1]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
