"""Burrows-Wheeler transforms of shards of aligned strings, merged by iterative interleave refinement.

Strings are aligned at a core that those of a group have in common: `left` stands before it, `right` after it. The
suffixes that start at the core are put into lexicographic order, with the common prefix of each with the one before
it; what stands before them in that order is their transform. A shard's suffixes are sorted once. Shards are merged
without sorting again: the interleave, which at first only knows the groups, is refined round by round by the next
symbols of its suffixes; a boundary that a round finds gives a common prefix, and a block with suffixes of one shard
only is done, as the shard has their order and common prefixes.

From there each step of the last-to-first map puts one symbol more before all suffixes at once: stable in the symbols,
so that the order stays lexicographic, and a common prefix is the least of those between the two places it now joins.
Neighbours that share a whole window are a repeated interval. Suffixes that are alone with what stands before them leave.
"""

from __future__ import annotations

import numpy as np

#: Suffixes of a shard.
SHARD = 4096


def packed(right: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows of symbols as rows of numbers in the same order, and the symbols in each number: 8 bytes, or 1 word."""
    if right.dtype != np.uint8:
        return right, 1
    m, e = right.shape
    wide = np.zeros((m, -(-e // 8) * 8), np.uint8)
    wide[:, :e] = right
    return wide.view(">u8").astype(np.uint64), 8


def _alike(x: np.ndarray, y: np.ndarray, per: int) -> np.ndarray:
    """How many symbols two different numbers have in common from the start."""
    if per == 1:
        return np.zeros(len(x), np.int64)
    return (per - 1) - np.floor(np.log2((x ^ y).astype(np.longdouble))).astype(np.int64) // 8


def transform(rows: np.ndarray, core: np.ndarray, symbols: np.ndarray, after: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard: its rows in the order of (core, right, its length), and each one's common prefix with the one before it.

    symbols: the packed right sides; after: their lengths. The first of a core has the common prefix -1.
    """
    of = symbols[rows]
    order = rows[np.lexsort((after[rows], *of.T[::-1], core[rows]))]
    x, y = symbols[order[1:]], symbols[order[:-1]]
    if x.shape[1] == 0:
        shared = np.zeros(len(x), np.int64)
    else:
        unlike = x != y
        at = unlike.argmax(1)
        some = unlike[np.arange(len(x)), at]
        shared = np.full(len(x), 1 << 30)
        k = np.flatnonzero(some)
        shared[k] = at[k] * per + _alike(x[k, at[k]], y[k, at[k]], per)
    return order, _bounded(order, np.append(-1, shared), core, after)


def _bounded(order: np.ndarray, shared: np.ndarray, core: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Common prefixes end with the shorter string and do not cross cores."""
    if len(order):
        shared[1:] = np.minimum(shared[1:], np.minimum(after[order[1:]], after[order[:-1]]))
        shared[1:][core[order[1:]] != core[order[:-1]]] = -1
        shared[0] = -1
    return shared


def merge(shards: list[tuple[np.ndarray, np.ndarray]], core: np.ndarray, symbols: np.ndarray, after: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of all rows from those of the shards."""
    if len(shards) == 1:
        return shards[0]
    at, shared = (np.concatenate(x) for x in zip(*shards, strict=True))
    of = np.repeat(np.arange(len(shards)), [len(s[0]) for s in shards])
    z = np.argsort(core[at], kind="stable")
    at, shared, of = at[z], shared[z], of[z]
    new = np.append(True, core[at[1:]] != core[at[:-1]])
    depth = symbols.shape[1]
    for r in range(depth + 1):
        start = np.flatnonzero(new)
        mixed = np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)
        block = np.cumsum(new) - 1
        k = np.flatnonzero(mixed[block])
        if not len(k):
            break
        block = block[k]
        s = symbols[at[k], r] if r < depth else after[at[k]]
        z = np.lexsort((s, block))
        head = np.flatnonzero(new[k])
        edge = shared[k[head]]  # of a block with the one before it: it stays where it is
        at[k], shared[k], of[k], s = at[k[z]], shared[k[z]], of[k[z]], s[z]
        shared[k[head]] = edge
        cut = np.flatnonzero((s[1:] != s[:-1]) & (block[1:] == block[:-1]))
        new[k[1 + cut]] = True
        shared[k[1 + cut]] = r * per + _alike(s[1 + cut], s[cut], per) if r < depth else 1 << 30
    else:  # what is still mixed is equal
        start = np.flatnonzero(new)
        mixed = np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)
        shared[mixed[np.cumsum(new) - 1] & ~new] = 1 << 30
    return at, _bounded(at, shared, core, after)


class _Least:
    """The least of any range of an array, from those of all ranges of 1, 2, 4, ... places."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << (len(self.rows) - 1) <= len(x):
            last, w = self.rows[-1], 1 << (len(self.rows) - 1)
            y = last.copy()
            y[: len(x) - w] = np.minimum(last[: len(x) - w], last[w:])
            self.rows.append(y)
        self.rows = np.stack(self.rows)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = np.log2(last - first + 1).astype(np.int64)
        return np.minimum(self.rows[k, first], self.rows[k, last + 1 - (1 << k)])


def repeats(order: np.ndarray, shared: np.ndarray, left: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the least and the largest j whose window another row has (1 << 30 and -1: none has).

    A window is the last j symbols before the core, the core, and the first e - j after it, e being the width of left.
    """
    m, e = left.shape
    low, high = np.full(m, 1 << 30), np.full(m, -1)
    least = _Least(shared.astype(np.int32))
    p, d = np.arange(m), shared.copy()  # places in the order at the core; what each shares with the one now before it
    new = d < 0
    for j in range(e + 1):
        hit = order[p[np.maximum(d, np.append(d[1:], -1)) >= e - j]]
        high[hit] = j
        low[hit] = np.minimum(low[hit], j)
        if j == e:
            break
        block, was = np.cumsum(new), np.append(-1, p[:-1])
        stay = before[order[p]] > j
        if not stay.all():
            p, d, block, was = p[stay], d[stay], block[stay], was[stay]
        if not len(p):
            break
        s = left[order[p], e - 1 - j]
        inside = np.append(False, block[1:] == block[:-1])
        unlike = np.flatnonzero(inside[1:] & (s[1:] != s[:-1]))
        new = ~inside
        if len(unlike):
            split = np.zeros(block[-1] + 1, bool)
            split[block[1 + unlike]] = True
            k = np.flatnonzero(split[block])
            z = k[np.lexsort((s[k], block[k]))]
            p[k], d[k], was[k], s = p[z], d[z], was[z], s[z]
            new[k[1:]] |= s[1:] != s[:-1]
        together = ~(new & np.append(new[1:], True))
        p, d, was, new = p[together], d[together], was[together], new[together]
        now = np.append(-1, p[:-1])
        k = np.flatnonzero((now != was) & ~new)
        d[k] = least(now[k] + 1, p[k])
        d[new] = -1
    return low, high


def repeated(core: np.ndarray, left: np.ndarray, before: np.ndarray, right: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """repeats() of rows of left (held to its end) and right (to its start), by merged transforms of shards of rows."""
    symbols, per = packed(right)
    shards = [transform(np.arange(i, min(i + SHARD, len(core))), core, symbols, after, per) for i in range(0, len(core), SHARD)]
    return repeats(*merge(shards, core, symbols, after, per), left, before)
