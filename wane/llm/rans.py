"""Static range asymmetric numeral coding of integer ids, in numpy.

One frequency table, shared by all blocks, sums to a power of two. A block holds `LANES` interleaved coders: id number k goes to
lane k % LANES at step k // LANES. All lanes of a block write into one stream of 32-bit words in the order in which the decoder
asks for them. A checkpoint every `EVERY` steps keeps the lanes' states and the place in the stream, so decoding can begin there:
blocks and the stretches between checkpoints are decoded side by side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, EVERY, SCALE = 64, 256, 20
#: States stay in [LOW, LOW << 32).
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
#: magic, lanes, steps between checkpoints, ids, checkpoints, crc32 of the ids, crc32 of what follows.
HEADER = "<4sHHIIII"
HEAD = struct.calcsize(HEADER)
MAGIC = b"rAN1"


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each id that occurs and 0 for the others."""
    counts = np.asarray(counts, np.int64)
    used, total = int((counts > 0).sum()), 1 << scale
    if used > total:
        raise ValueError(f"{used} different ids do not fit a table of {total}")
    if not used:
        return np.zeros(len(counts), np.int64)
    share = counts / counts.sum()
    out = np.where(counts > 0, 1 + np.floor(share * (total - used)).astype(np.int64), 0)
    out[int(np.argmax(counts))] += total - int(out.sum())
    return out


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, frequencies: np.ndarray, scale: int = SCALE):
        self.scale, self.freq = np.uint64(scale), np.asarray(frequencies, np.uint64)
        self.below = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """The bytes of each block of ids."""
        order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
        steps = np.array([-(-len(blocks[k]) // LANES) for k in order], np.int64)
        longest, filler = int(steps.max(initial=0)), int(np.argmax(self.freq)) if len(self.freq) else 0
        ids = np.full((longest, len(blocks), LANES), filler, np.uint32)
        for at, k in enumerate(order):
            whole = np.full(steps[at] * LANES, filler, np.uint32)
            whole[: len(blocks[k])] = blocks[k]
            ids[: steps[at], at] = whole.reshape(-1, LANES)
        if longest and not self.freq[ids].all():
            raise ValueError("an id has no place in the frequency table")
        state = np.full((len(blocks), LANES), LOW, np.uint64)
        words, writes = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
        marks: dict[int, np.ndarray] = {}
        most = np.uint64(63) - self.scale
        active = np.searchsorted(-steps, -np.arange(longest), side="left")
        for t in range(longest - 1, -1, -1):
            m = int(active[t])
            sym, x = ids[t, :m], state[:m]
            f = self.freq[sym]
            full = x >= (f << most)
            words[t, :m], writes[t, :m] = x, full
            x = np.where(full, x >> WORD, x)
            q = x // f
            state[:m] = (q << self.scale) + (x - q * f) + self.below[sym]
            if t % EVERY == 0:
                marks[t] = state[:m].copy()
        out = [b""] * len(blocks)
        for at, k in enumerate(order):
            used = writes[: steps[at], at]
            starts = range(0, int(steps[at]), EVERY)
            before = np.concatenate(([0], np.cumsum(used.sum(1))))
            body = b"".join(
                [*(struct.pack("<I", int(before[t])) + marks[t][at].astype("<u8").tobytes() for t in starts), words[: steps[at], at][used].astype("<u4").tobytes()])
            own = zlib.crc32(np.ascontiguousarray(blocks[k], "<u4"))
            out[k] = struct.pack(HEADER, MAGIC, LANES, EVERY, len(blocks[k]), len(starts), own, zlib.crc32(body)) + body
        return out

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        """The ids of each block; bytes that do not match their checksums are an error."""
        heads, streams, rows, at_word = [], [], [], 0
        for k, raw in enumerate(blocks):
            magic, lanes, every, n, marks, own, rest = struct.unpack_from(HEADER, raw)
            if (magic, lanes, every) != (MAGIC, LANES, EVERY) or zlib.crc32(memoryview(raw)[HEAD:]) != rest:
                raise ValueError("a block of ids does not match its checksum")
            size = 4 + 8 * LANES
            first = HEAD + marks * size
            for j in range(marks):
                place = HEAD + j * size
                steps = min(EVERY, -(-n // LANES) - j * EVERY)
                rows.append((steps, k, at_word + struct.unpack_from("<I", raw, place)[0], np.frombuffer(raw, "<u8", LANES, place + 4)))
            streams.append(np.frombuffer(raw, "<u4", -1, first))
            at_word += len(streams[-1])
            heads.append((n, own))
        found = [np.empty(0, np.uint32) for _ in blocks]
        if rows:
            order = sorted(range(len(rows)), key=lambda r: -rows[r][0])
            steps = np.array([rows[r][0] for r in order])
            at = np.array([rows[r][2] for r in order], np.int64)
            state = np.array([rows[r][3] for r in order], np.uint64)
            words = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
            ids = np.zeros((int(steps[0]), len(rows), LANES), np.uint32)
            low = np.uint64((1 << int(self.scale)) - 1)
            active = np.searchsorted(-steps, -np.arange(int(steps[0])), side="left")
            for t, m in enumerate(active.tolist()):
                x = state[:m]
                slot = x & low
                sym = ids[t, :m] = self.symbol[slot]
                x = self.freq[sym] * (x >> self.scale) + slot - self.below[sym]
                reads = x < LOW
                rank = np.cumsum(reads, axis=1)
                word = words[at[:m, None] + rank - reads]
                state[:m] = np.where(reads, (x << WORD) | word, x)
                at[:m] += rank[:, -1]
            parts: list[list] = [[] for _ in blocks]
            place = {r: k for k, r in enumerate(order)}
            for r, (n, k, *_) in enumerate(rows):
                parts[k].append(ids[:n, place[r]].ravel())
            found = [np.concatenate(p)[: heads[k][0]] if p else found[k] for k, p in enumerate(parts)]
        for one, (_, own) in zip(found, heads, strict=True):
            if zlib.crc32(np.ascontiguousarray(one, "<u4")) != own:
                raise ValueError("decoded ids do not match their checksum")
        return found
