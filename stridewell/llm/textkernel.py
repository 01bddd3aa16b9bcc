"""Words, shingles and hashes of many texts at once, as numpy passes over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

MASK = 2**64 - 1
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)
#: Bytes hashed at once; longer inputs are hashed piece by piece.
PIECE = 1 << 19

#: The bytes between words, space and the controls 9 to 13.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64: n of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        have = np.full(m, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each span data[start:end]; spans are in order and do not overlap. Equal spans have equal hashes.

    With prefixes: a row more for each length, of the spans' first bytes (0 for a span that is not longer).
    """
    out = np.zeros((1 + len(prefixes), len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        seg = data[base : ends[j - 1]]
        if len(seg) > 4 * PIECE:  # one very long span
            out[0, i] = _long_hash(seg)
            for k, size in enumerate(prefixes, 1):
                out[k, i] = _long_hash(seg[:size])
        else:
            sums = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(seg))[: len(seg)], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            back, before = powers(UNBASE, len(seg))[s], sums[s]
            out[0, i:j] = (sums[e] - before) * back
            for k, size in enumerate(prefixes, 1):
                out[k, i:j] = np.where(e - s > size, (sums[np.minimum(s + size, e)] - before) * back, 0)
        i = j
    return np.where(out == 0, out, mix(out)) if prefixes else mix(out[0])


def _long_hash(seg: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    p = powers(BASE, PIECE)[:PIECE]
    for k in range(0, len(seg), PIECE):
        part = seg[k : k + PIECE].astype(np.uint64) + np.uint64(1)
        total = (total + scale * int((part * p[: len(part)]).sum(dtype=np.uint64))) & MASK
        scale = scale * pow(BASE, PIECE, 2**64) & MASK
    return np.uint64(total)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words `[^\\x20\\x09-\\x0D]+`; no word crosses a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:]
    end = solid
    end[:-1] &= ~solid[1:] | first[1:]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, "right") - 1


class Words:
    """The words of a block of rows. hash: of the word in lower case (A-Z only)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.lower = LOWER[data]
        self.start, self.end, self.row = word_spans(data, offsets)
        self.hash = span_hashes(self.lower, self.start, self.end)
        #: Word ranges of the rows.
        self.first = np.searchsorted(self.row, np.arange(self.n + 1), "left")

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every run of k words, and their rows; a row of 1 to k - 1 words gives all its words as one."""
        h, n = self.hash, len(self.hash)
        if not n:
            return h, self.row
        run = h.copy()
        for j in range(1, k):
            run[: n - j] = run[: n - j] * np.uint64(BASE) + h[j:]
        keep = np.zeros(n, bool)
        if n >= k:
            keep[: n - k + 1] = self.row[: n - k + 1] == self.row[k - 1 :]
        run, row = mix(run[keep]), self.row[keep]
        few = np.flatnonzero((self.counts() > 0) & (self.counts() < k))
        if len(few):
            extra = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                more = self.first[few] + j < self.first[few + 1]
                at = np.minimum(self.first[few] + j, n - 1)
                extra = np.where(more, extra * np.uint64(BASE) + h[at], extra)
            extra = mix(extra ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            run, row = np.concatenate([run, extra]), np.concatenate([row, few])
            order = np.argsort(row, kind="stable")
            run, row = run[order], row[order]
        return run, row


def distinct_by_row(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in increasing order; row is in order."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
