"""Language-model scoring: online logistic mixing of hashed-context bit predictors.

A text is its words in lower case (A-Z) and one end. Words that make up 2**-COMMON or more of the training tokens, the
end and an escape have Huffman codes; any other word is an escape and then, with the share of training tokens that Good
and Turing's rule gives to new words, its bytes, each with a Huffman code, and a stop, or else its share of the counts
of rare words. Every bit of a code is predicted from several hashed contexts (for words: the code so far, without and
with the word before; for bytes: with one to four bytes before). A predictor's counts give a log odds; a gate, by how
often the contexts were seen, picks the weights that mix them; an adaptive table refines the mix. All is learned online:
each chunk is predicted, then moves the weights, then joins the counts. Words learn from all training texts, spellings
from all different training words. Tasks learn side by side; counts add up, weights are averaged by the bits they saw.

The mixers' tables have fixed sizes, so what is broadcast does not grow. What grows with the corpus are the counts of
all its words and of all its runs of two and three tokens: they travel as a part for each block of texts and shard of
hashes, and come back as counts of just the block's words and runs. A token's probability is the mixers' one, a run of
two's and a run of three's shares of their contexts' counts, each let in by a gate: the chance that these counts speak,
by how often the context was seen and whether the last two tokens' runs of three were known. Gates are fitted to a
block's training texts. A training text's own occurrence of a run is taken off the run's counts, so that these show
what the rest of the corpus has: a text that occurs once gains nothing from itself, one that occurs twice does.

Words are known by 64-bit hashes, runs by as many bits as keep a false match under about one in a thousand.

Defined results: a null text is empty and has its end alone; equal rows of a block are scored alike, those of different
blocks by their own block's gates; null ids count as training texts. Without training texts all counts are 0.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, learning, textkernel as tk

BLOCK_BYTES, SHARD_BYTES = 4_000_000, 12_000_000
COMMON, BITS, GATES, BINS, SLICES = 14, 18, 16, 33, 8
ORDERS, BYTE_ORDERS = 2, 4
#: Bits of a run's key beyond those that number the corpus's bytes; levels of a context's count; times gates are fitted.
SPARE_BITS, LEVELS, FITS = 7, 24, 2
#: Tokens, and words to spell, that are learned from or scored at once.
CHUNK, SPELL = 64_000, 12_000
#: What a context starts with for either bit, and how far the adaptive table is trusted.
START, TRUST = 0.4, 0.5
END, ESCAPE = 0, 1


def huffman(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Code of each symbol: its first place in, and its length of, `node` (inner node, counted from 0) and `bit`."""
    n = len(weights)
    heap = [(float(w) + 0.5, i) for i, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    parent, side = np.full(2 * n, -1), np.zeros(2 * n, np.uint8)
    nxt = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = nxt
        side[j] = 1
        heapq.heappush(heap, (a + b, nxt))
        nxt += 1
    size, node, bit = np.zeros(n, np.int64), [], []
    for s in range(n):
        path, at = [], s
        while parent[at] >= 0:
            path.append((int(parent[at]) - n, int(side[at])))
            at = int(parent[at])
        size[s] = len(path)
        node += [p for p, _ in reversed(path)]
        bit += [b for _, b in reversed(path)]
    return {"first": np.cumsum(size) - size, "size": size, "node": np.array(node, np.int64), "bit": np.array(bit, np.uint8)}


class Mixer:
    """Bit predictors of several contexts, their mixing weights and the adaptive table, learned online."""

    def __init__(self, orders: int, state: dict[str, np.ndarray] | None = None):
        self.k = orders
        self.counts = state["counts"] if state else np.zeros((orders, 2 << BITS), np.int32)  # of a 0 and a 1 in turn
        self.weights = state["weights"] if state else np.full((GATES, orders), 1.0 / orders + 0.15)
        self.refine = state["refine"] if state else np.zeros((GATES * BINS, 2))
        self.seen = np.zeros(GATES)
        self.hess = np.tile(np.eye(orders) * 50.0, (GATES, 1, 1))
        self.refresh()

    def refresh(self) -> None:
        """Makes what is looked up from what is counted."""
        pair = self.counts.reshape(self.k, -1, 2).astype(np.float32)
        self.odds = np.log((pair[..., 1] + np.float32(START)) / (pair[..., 0] + np.float32(START)))
        n = pair[..., 0] + pair[..., 1]
        self.level = (n >= 2).astype(np.uint8) + (n >= 12) + (n >= 100)
        self.w = self.weights.astype(np.float32)
        total = self.refine.sum(1)
        adapted = (self.refine[:, 1] + 0.5) / (total + 1)
        trust = TRUST * total / (total + 200)
        self.keep, self.lift = (1 - trust).astype(np.float32), (trust * adapted).astype(np.float32)

    def _mix(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Log odds of each context, the gate, and their mix."""
        odds = [self.odds[i][s] for i, s in enumerate(slots)]
        gate = self.level[-1][slots[-1]] * np.uint8(4) + self.level[-2][slots[-2]]
        dot = odds[0] * self.w[:, 0][gate]
        for i in range(1, self.k):
            dot += odds[i] * self.w[:, i][gate]
        return odds, gate, np.clip(dot, -12, 12, out=dot)

    @staticmethod
    def _cell(gate: np.ndarray, dot: np.ndarray) -> np.ndarray:
        return gate.astype(np.int32) * BINS + np.rint((dot + np.float32(12)) * np.float32((BINS - 1) / 24)).astype(np.int32)

    def logs(self, slots: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        """log10 of each bit's probability."""
        _, gate, dot = self._mix(slots)
        cell = self._cell(gate, dot)
        p = self.keep[cell] / (1 + np.exp(-dot)) + self.lift[cell]
        p = np.where(bit, p, 1 - p)
        return np.log10(np.clip(p, 1e-6, 1 - 1e-6, out=p))

    def learn(self, slots: list[np.ndarray], bit: np.ndarray) -> None:
        if not len(bit):
            return
        odds, gate, dot = self._mix(slots)
        cell = self._cell(gate, dot)
        p = 1 / (1 + np.exp(-dot))
        order = np.argsort(gate, kind="stable")
        ends = np.cumsum(np.bincount(gate, minlength=GATES))
        s, err, var = np.stack(odds)[:, order], (bit - p)[order], (p * (1 - p))[order]
        for g, (a, z) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):  # a damped Newton step for each gate
            if z > a:
                self.hess[g] += (s[:, a:z] * var[a:z]) @ s[:, a:z].T
                self.weights[g] += np.linalg.solve(self.hess[g], s[:, a:z] @ err[a:z])
        self.seen += np.diff(ends, prepend=0)
        self.refine += np.bincount(cell * 2 + bit, minlength=2 * GATES * BINS).reshape(-1, 2)
        for i, x in enumerate(slots):
            self.counts[i] += np.bincount(x * 2 + bit, minlength=2 << BITS).astype(np.int32)


def _slot(context: np.ndarray | None, node: np.ndarray) -> np.ndarray:
    if context is None:  # inner nodes have places of their own
        return node & ((1 << BITS) - 1)
    mixed = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= context
    mixed *= np.uint64(tk.BASE)
    return (mixed >> np.uint64(64 - BITS)).view(np.int64)


class Words:
    """Codes and mixer for words."""

    def __init__(self, vocab: np.ndarray, code: dict[str, np.ndarray], state: dict | None = None):
        self.vocab, self.code, self.mixer = vocab, code, Mixer(ORDERS, state)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """2 and more for the common words, else ESCAPE."""
        if not len(self.vocab):
            return np.full(len(h), ESCAPE)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 2, ESCAPE)

    def bits(self, symbol: np.ndarray, one: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Slots, bits and tokens of the codes of symbols, after the words one."""
        size = self.code["size"][symbol]
        at = tk.flat_ranges(self.code["first"][symbol], size)
        of = np.repeat(np.arange(len(symbol)), size)
        node = self.code["node"][at]
        return [_slot(None, node), _slot(one[of], node)], self.code["bit"][at], of


class Spelling:
    """Codes and mixer for the bytes of words."""

    def __init__(self, code: dict[str, np.ndarray], state: dict | None = None):
        self.code, self.mixer = code, Mixer(BYTE_ORDERS, state)

    def bits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Slots, bits and words of the spellings data[start:end], each with a stop (symbol 256)."""
        size = end - start + 1
        pos = tk.flat_ranges(np.zeros(len(size), np.int64), size)
        word = np.repeat(np.arange(len(size)), size)
        at = start[word] + pos
        symbol = np.where(pos == size[word] - 1, 256, data[np.minimum(at, len(data) - 1)].astype(np.int64))
        context, contexts = np.zeros(len(at), np.uint64), []
        for k in range(1, BYTE_ORDERS + 1):
            before = np.where(pos >= k, data[np.maximum(at - k, 0)].astype(np.int64) + 1, 0).astype(np.uint64)
            context = context * np.uint64(263) + before
            contexts.append(tk.mix(context + np.uint64(k << 40)))
        n = self.code["size"][symbol]
        code = tk.flat_ranges(self.code["first"][symbol], n)
        of = np.repeat(np.arange(len(at)), n)
        node = self.code["node"][code]
        return [_slot(x[of], node) for x in contexts], self.code["bit"][code], word[of]

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        k, step = 0, 2000
        while k < len(start):
            self.mixer.refresh()
            slots, bit, _ = self.bits(data, start[k : k + step], end[k : k + step])
            self.mixer.learn(slots, bit)
            k, step = k + step, min(2 * step, SPELL)

    def logs(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start))
        for k in range(0, len(start), SPELL):
            z = slice(k, k + SPELL)
            slots, bit, of = self.bits(data, start[z], end[z])
            out[z] = np.bincount(of, self.mixer.logs(slots, bit), minlength=len(out[z]))
        return out


class Tokens:
    """The tokens of a block of texts: words, and an end after each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = tk.Words(data, offsets)
        self.w, self.n = w, w.counts() + 1
        last = np.cumsum(self.n) - 1
        self.is_end = np.zeros(int(self.n.sum()), bool)
        self.is_end[last] = True
        self.hash = np.full(len(self.is_end), 1, np.uint64)
        self.hash[~self.is_end] = w.hash
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        pos = np.arange(len(self.hash)) - np.repeat(last - self.n + 1, self.n)
        self.one, self.two = np.zeros_like(self.hash), np.zeros_like(self.hash)
        self.one[1:] = np.where(pos[1:] >= 1, self.hash[:-1], 0)
        self.two[2:] = np.where(pos[2:] >= 2, self.hash[:-2], 0)

    def runs(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the run of two and of three that each token ends; a text begins after two tokens 0."""
        two = tk.mix(self.hash + self.one * np.uint64(tk.BASE))
        three = tk.mix(two + self.two * np.uint64(tk.BASE) + np.uint64(1))
        return two >> np.uint64(64 - bits), three >> np.uint64(64 - bits)

    def different(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different words' hashes in order, each word's number among them, and a place of each."""
        uniq, which = np.unique(self.w.hash, return_inverse=True)
        example = np.zeros(len(uniq), np.int64)
        example[which[::-1]] = np.arange(len(which))[::-1]
        return uniq, which, example


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.ascontiguousarray(x)), "zstd", asbytes=True) if x.size else b""


def _unzip(raw: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _zip_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0, as planes of their bytes, of which high ones that are all zero are left out."""
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + _zip(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _unzip_numbers(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : raw[0]] = _unzip(raw[1:], np.uint8, n * raw[0]).reshape(raw[0], n).T
    return out.view("<u8").ravel()


def _zip_keys(keys: np.ndarray) -> bytes:
    """Increasing keys: the first, and the steps between them."""
    return keys[:1].tobytes() + _zip_numbers(np.diff(keys, prepend=keys[:1]))


def _unzip_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unzip_numbers(raw[8:], n), dtype=np.uint64) + np.frombuffer(raw[:8], np.uint64) if n else np.zeros(0, np.uint64)


def _typed(names: str, rows: list[dict]) -> pa.Table:
    """Rows as a table of the columns that names lists as Spark does."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in names.split(", ")])
    return pa.Table.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


BLOCKS = "block long, ids binary, texts binary, size long"
#: A block's words of a shard, in order of hash: their bytes, sizes and training counts. A row without a shard has the
#: block's training tokens and texts.
PACKED = "block long, shard int, size long, tokens long, ends long, bytes binary, sizes binary, counts binary, words long"
#: A block's runs of a shard, in order: their keys and training counts, or the whole corpus's.
RUNS = "block long, shard int, twos binary, two_counts binary, n_twos long, threes binary, three_counts binary, n_threes long"


def _block(t: pa.Table, block: int) -> pa.RecordBatch:
    data, offsets = common.utf8(common.one(t.column("text")))
    held = np.array([bool(x) for x in t.column("held").to_pylist()])
    ids = t.column("doc_id").to_pylist()
    pack = learning.pack({"v": np.array([x or 0 for x in ids], np.int64), "null": np.array([x is None for x in ids], bool), "offsets": offsets, "held": held})
    return _typed(BLOCKS, [{"block": block, "ids": pack, "texts": _zip(data), "size": len(data)}]).to_batches()[0]


def _shard_cuts(hashes: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's part of increasing hashes of so many bits begins."""
    return np.searchsorted((hashes >> np.uint64(bits - 24)).astype(np.int64) * shards >> 24, np.arange(shards + 1))


def _packed(row: dict, shards: int) -> pa.RecordBatch:
    data, ids = _unzip(row["texts"], np.uint8, row["size"]), learning.unpack(row["ids"])
    held, block = ids["held"], row["block"]
    tok = Tokens(data, ids["offsets"])
    uniq, which, example = tok.different()
    count = np.bincount(which[~held[tok.w.row]], minlength=len(uniq)).astype(np.uint32)
    start, size = tok.w.start[example], (tok.w.end - tok.w.start)[example]
    rows = [{"block": block, "tokens": int(tok.n[~held].sum()), "ends": int((~held).sum())}]
    cut = _shard_cuts(uniq, 64, shards)
    for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            text = tok.w.lower[tk.flat_ranges(start[a:b], size[a:b])]
            rows.append({"block": block, "shard": s, "size": len(text), "bytes": _zip(text), "sizes": _zip(size[a:b].astype(np.uint32)), "counts": _zip(count[a:b]), "words": b - a})
    return _typed(PACKED, rows).to_batches()[0]


def _runs(row: dict, shards: int, bits: int) -> pa.RecordBatch:
    ids = learning.unpack(row["ids"])
    tok = Tokens(_unzip(row["texts"], np.uint8, row["size"]), ids["offsets"])
    learned = ~ids["held"][tok.row]
    parts = [{"block": row["block"], "shard": s} for s in range(shards)]
    for name, keys in zip(("two", "three"), tok.runs(bits), strict=True):
        both = np.sort(keys * np.uint64(2) + learned)  # keys have 63 bits at most
        keys = both >> np.uint64(1)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        runs, n = keys[at], np.add.reduceat(both & np.uint64(1), at)
        cut = _shard_cuts(runs, bits, shards)
        for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            parts[s] |= {f"{name}s": _zip_keys(runs[a:b]), f"{name}_counts": _zip_numbers(n[a:b]), f"n_{name}s": b - a}
    return _typed(RUNS, [p for p in parts if p["n_twos"] or p["n_threes"]]).to_batches()[0]


class ShardWords:
    """A shard's words of all blocks: bytes, spans, and which of the different words each is."""

    def __init__(self, t: pa.Table):
        texts, sizes, counts = [], [], []
        for r in t.select(["bytes", "sizes", "counts", "words", "size"]).to_pylist():
            texts.append(_unzip(r["bytes"], np.uint8, r["size"]))
            sizes.append(_unzip(r["sizes"], np.uint32, r["words"]))
            counts.append(_unzip(r["counts"], np.uint32, r["words"]))
        self.data = np.concatenate(texts)
        self.end = np.cumsum(np.concatenate(sizes).astype(np.int64))
        self.start = self.end - np.concatenate(sizes)
        self.uniq, first, self.which = np.unique(tk.span_hashes(self.data, self.start, self.end), return_index=True, return_inverse=True)
        self.first = first
        self.total = np.bincount(self.which, np.concatenate(counts), minlength=len(self.uniq)).astype(np.int64)
        self.cut = np.cumsum([0, *map(len, sizes)])


PARTS = "part int, counts binary, other binary"


def _parts(mixer: Mixer) -> list[tuple]:
    """What a mixer has learned, in SLICES rows."""
    if not mixer.seen.any():
        return []
    other = learning.pack({"w": mixer.weights * mixer.seen[:, None], "seen": mixer.seen, "refine": mixer.refine})
    return [(s, _zip(x), None if s else other) for s, x in enumerate(np.split(mixer.counts, SLICES, axis=1))]


def _parts_table(parts: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([p[i] for p in parts], k) for i, k in enumerate(kinds)], names=["part", "counts", "other"])


def _merged(parts: DataFrame, orders: int) -> dict[str, np.ndarray]:
    """The state of all tasks' mixers together; of a fixed size."""
    n = orders * (2 << BITS) // SLICES

    def add(t: pa.Table) -> pa.Table:
        total = sum(_unzip(x, np.int32, n).astype(np.int64) for x in t.column("counts").to_pylist())
        got = [learning.unpack(x) for x in t.column("other").to_pylist() if x]
        other = learning.pack({k: sum(g[k] for g in got) for k in got[0]}) if got else None
        return _parts_table([(t.column("part")[0].as_py(), _zip(np.minimum(total, 2**31 - 1).astype(np.int32)), other)])

    rows = {r["part"]: r for r in parts.groupBy("part").applyInArrow(add, PARTS).collect()}
    blank = Mixer(orders)
    if not rows:
        return {"counts": blank.counts, "weights": blank.weights, "refine": blank.refine}
    other = learning.unpack(bytes(rows[0]["other"]))
    seen = other["seen"][:, None]
    counts = np.concatenate([_unzip(bytes(rows[s]["counts"]), np.int32, n).reshape(orders, -1) for s in range(SLICES)], 1)
    return {"counts": counts, "weights": np.where(seen > 0, other["w"] / np.maximum(seen, 1), blank.weights), "refine": other["refine"]}


def _run_totals(t: pa.Table) -> pa.Table:
    """A shard's rows of RUNS with the whole corpus's training counts and without keys."""
    rows = [{k: r[k] for k in ("block", "shard", "n_twos", "n_threes")} for r in t.select(["block", "shard", "n_twos", "n_threes"]).to_pylist()]
    for name in ("two", "three"):
        n = t.column(f"n_{name}s").to_pylist()
        keys = np.concatenate([_unzip_keys(x, m) for x, m in zip(t.column(f"{name}s").to_pylist(), n, strict=True)])
        uniq, which = np.unique(keys, return_inverse=True)
        here = np.concatenate([_unzip_numbers(x, m) for x, m in zip(t.column(f"{name}_counts").to_pylist(), n, strict=True)])
        total = np.bincount(which, here, minlength=len(uniq)).astype(np.uint64)[which]
        for r, x in zip(rows, np.split(total, np.cumsum(n)[:-1]), strict=True):
            r[f"{name}_counts"] = _zip_numbers(x)
    return _typed(RUNS, rows)


COUNTED = "block long, shard int, counts binary, spelled binary, words long, distinct long, once long, hashes binary"


def _counted(t: pa.Table, least: float, spelling: Spelling) -> pa.Table:
    """Total counts and spelling scores of each block's words; the row of block -1 has the common words."""
    w = ShardWords(t)
    shard = t.column("shard")[0].as_py()
    spelled = spelling.logs(w.data, w.start[w.first], w.end[w.first]).astype(np.float32)
    rows = []
    for b, x, y in zip(t.column("block").to_pylist(), w.cut[:-1].tolist(), w.cut[1:].tolist(), strict=True):
        at = w.which[x:y]
        rows.append({"block": b, "shard": shard, "counts": _zip(w.total[at]), "spelled": _zip(spelled[at]), "words": y - x})
    often = w.total >= max(least, 1)
    rows.append({"block": -1, "shard": shard, "counts": w.total[often].tobytes(), "words": int(often.sum()), "distinct": int((w.total > 0).sum()), "once": int((w.total == 1).sum()), "hashes": w.uniq[often].tobytes()})
    return _typed(COUNTED, rows)


def _learn_block(model: Words, row: dict, step: int) -> int:
    """Learns from a block's training texts; step is the size of the next chunk."""
    data, ids = _unzip(row["texts"], np.uint8, row["size"]), learning.unpack(row["ids"])
    keep = np.flatnonzero(~ids["held"])
    offsets = ids["offsets"]
    size = offsets[keep + 1] - offsets[keep]
    tok = Tokens(data[tk.flat_ranges(offsets[keep], size)], np.concatenate([[0], np.cumsum(size)]))
    symbol = np.full(len(tok.hash), END)
    symbol[~tok.is_end] = model.symbols(tok.w.hash)
    k = 0
    while k < len(symbol):
        z = slice(k, k + step)
        model.mixer.refresh()
        slots, bit, _ = model.bits(symbol[z], tok.one[z])
        model.mixer.learn(slots, bit)
        k, step = k + step, min(2 * step, CHUNK)
    return step


def _gated(log_p: np.ndarray, shares: list[np.ndarray], cells: list[np.ndarray], learned: np.ndarray) -> np.ndarray:
    """Natural logs of a probability with, in turn, each order's shares let in by a gate for each cell.

    Cell 0 has no counts: its gate is shut. Gates are fitted to the learned tokens, first chunk by chunk, then to what
    all chunks together ask for, from a prior of 1 in 10 tokens.
    """
    m, orders = 1 + 4 * LEVELS, range(len(shares))
    gates, p0 = [np.full(m, 0.1) for _ in orders], np.exp(log_p)
    for turn in range(FITS):
        spoken, asked = np.ones((len(gates), m)), np.full((len(gates), m), 10.0)
        for i in range(0, len(log_p), CHUNK):
            keep = i + np.flatnonzero(learned[i : i + CHUNK])
            at, q, low, opened = [c[keep].astype(np.intp) for c in cells], [x[keep] for x in shares], [p0[keep]], []
            for k in orders:
                opened.append(np.where(at[k] > 0, gates[k][at[k]], 0))
                low.append(low[k] + opened[k] * (q[k] - low[k]))
            left = np.ones(len(keep))  # the chance that no higher order spoke
            for k in reversed(orders):
                spoke = left * opened[k] * q[k] / np.maximum(low[k + 1], 1e-300)
                spoken[k] += np.bincount(at[k], spoke, minlength=m)
                asked[k] += np.bincount(at[k], left, minlength=m)
                left -= spoke
            if not turn:
                gates = list(spoken / asked)
        gates = list(spoken / asked)
    out = np.empty(len(log_p))
    for i in range(0, len(log_p), CHUNK):
        z = slice(i, i + CHUNK)
        rest, given = 1.0, 0.0
        for g, x, c in zip(gates, shares, cells, strict=True):
            opened = np.where(c[z] > 0, g[c[z]], 0)
            rest, given = rest * (1 - opened), given * (1 - opened) + opened * x[z]
        p = rest * p0[z] + given
        # no float holds the probability of a long spelling
        out[z] = np.where(p > 1e-200, np.log(np.maximum(p, 1e-200)), log_p[z] + np.log(rest))
    return out


def _with_runs(tok: Tokens, log_p: np.ndarray, c: np.ndarray, twos: np.ndarray, threes: np.ndarray, ends: int, learned: np.ndarray) -> np.ndarray:
    """Natural logs of the tokens' probabilities with runs: c, twos and threes are training counts of each token, of the
    run of two and of the run of three that it ends."""
    if not len(c):
        return log_p
    first = np.zeros(len(c), bool)
    first[np.cumsum(tok.n) - tok.n] = True
    last = np.zeros(len(c), bool)  # whether the token before ended a known run of three
    last[1:] = (threes > learned)[:-1] & ~first[1:]
    recent = last * np.uint8(2)
    recent[1:] += last[:-1] & ~first[1:]
    shares, cells = [], []
    for seen, context, begin in ((twos, c, ends), (threes, twos, 0)):
        share, cell = np.zeros(len(c), np.float32), np.zeros(len(c), np.uint8)
        for i in range(0, len(c), CHUNK):
            z = slice(i, min(i + CHUNK, len(c)))
            before = np.where(first[z], begin, context[np.arange(z.start - 1, z.stop - 1)]) - learned[z]  # below 1: no counts
            known = np.maximum(before, 1)
            share[z] = np.where(before > 0, np.clip((seen[z] - learned[z]) / known, 0, 1), 0)
            level = np.minimum(LEVELS - 1, np.log2(known).astype(np.uint8))
            cell[z] = np.where(before > 0, 1 + 4 * level + recent[z], 0)
        shares.append(share)
        cells.append(cell)
    return _gated(log_p, shares, cells, learned)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, spelling_score double"


def _score_block(model: Words, row: dict, counts: np.ndarray, spelled: np.ndarray, twos: np.ndarray, threes: np.ndarray, bits: int, n: int, v: int, ends: int, rare: int, new: float) -> pa.RecordBatch:
    data, ids = _unzip(row["texts"], np.uint8, row["size"]), learning.unpack(row["ids"])
    offsets = ids["offsets"]
    tok = Tokens(data, offsets)
    uniq, which, _ = tok.different()
    symbols = model.symbols(uniq)
    # a rare word is one of the known ones, by its count, or a new one, by its spelling
    with np.errstate(divide="ignore"):  # in logs, as no float holds the probability of a long spelling
        escaped = np.logaddexp(np.log((1 - new) * counts / max(1, rare)), np.log(new) + spelled * math.log(10)) / math.log(10)
    symbol = np.full(len(tok.hash), END)
    symbol[~tok.is_end] = symbols[which]
    score = np.zeros(len(symbol))
    score[~tok.is_end] = np.where(symbols == ESCAPE, escaped, 0)[which]
    for k in range(0, len(symbol), CHUNK):
        z = slice(k, k + CHUNK)
        slots, bit, of = model.bits(symbol[z], tok.one[z])
        score[z] += np.bincount(of, model.mixer.logs(slots, bit), minlength=len(symbol[z]))
    c = np.full(len(symbol), float(ends))
    c[~tok.is_end] = counts[which]
    m = len(offsets) - 1
    runs = [total[np.unique(keys, return_inverse=True)[1]].astype(np.int64) for total, keys in zip((twos, threes), tok.runs(bits), strict=True)]
    score = _with_runs(tok, score * math.log(10), c, *runs, ends, ~ids["held"][tok.row]) / math.log(10)
    spelling = np.zeros(len(symbol))
    spelling[~tok.is_end] = np.where(counts == 0, spelled, 0)[which]
    base = np.bincount(tok.row, np.log10((c + 0.1) / (n + 0.1 * (v + 1))), minlength=m)
    known = np.bincount(tok.row, c > 0, minlength=m).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids["v"], pa.int64(), mask=ids["null"]), pa.array(ids["held"]), pa.array(tok.n), pa.array(known), pa.array(np.full(m, n)), pa.array(base), pa.array(np.bincount(tok.row, score, minlength=m)), pa.array(np.diff(offsets)), pa.array(np.bincount(tok.row, spelling, minlength=m))], names=[c.split()[0] for c in SCORED.split(", ")])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte occurs in words, each word once a block; 256: words."""
    total = np.zeros(257, np.int64)
    for b in batches:
        for raw, size, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[:256] += np.bincount(_unzip(raw, np.uint8, size), minlength=256)
            total[256] += n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(257)), pa.array(total)], names=["byte", "n"])


def mixing_scores(docs: DataFrame, held: str = "held", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SCORED for every text: sizes, the score of smoothed word counts (base_score) and of the mixing model, both log10.

    spelling_score is the part of score that spells words which no training text has; base_score gives all such words
    one probability whatever their spelling, so score - spelling_score is what compares with it. held: a boolean column, true for texts that nothing is learned from. Bits per byte are -score * log2(10) / n_bytes.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    src = common.plain(docs, doc_id=doc_id, text=text, held=held).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held", F.lit(False)).alias("held"))
    _, size = common.input_bytes(src)
    shards = int(1 + size // SHARD_BYTES)
    bits = min(63, max(32, size.bit_length() + SPARE_BITS))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(common.gathered(batches, BLOCK_BYTES)):
            yield _block(t, (TaskContext.get().partitionId() << 32) + k)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield _packed(b.slice(k, 1).to_pylist()[0], shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield _runs(b.slice(k, 1).to_pylist()[0], shards, bits)

    texts = common.stored(src.mapInArrow(common.trimmed(block), BLOCKS), "blocks", sweep=True)
    parts: list[str] = []  # discarded once they are counted
    packed = common.stored(texts.mapInArrow(common.trimmed(pack), PACKED), "parts", parts, sweep=True)
    words = packed.where("shard is not null").drop("tokens", "ends")
    sums = packed.where("shard is null").agg(F.sum("tokens").alias("n"), F.sum("ends").alias("e")).first()
    n, ends = int(sums["n"] or 0), int(sums["e"] or 0)
    histogram = np.zeros(257, np.int64)
    for r in words.select("bytes", "size", "words").mapInArrow(common.trimmed(_histogram), "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        histogram[r["byte"]] = r["n"]
    byte_code = huffman(histogram)

    def spell(t: pa.Table) -> pa.Table:
        w, model = ShardWords(t), Spelling(byte_code)
        at = w.first[w.total > 0]
        model.learn(w.data, w.start[at], w.end[at])
        return _parts_table(_parts(model.mixer))

    spelling = spark.sparkContext.broadcast(_merged(words.drop("block").groupBy("shard").applyInArrow(spell, PARTS), BYTE_ORDERS))
    kept: dict[str, object] = {}
    least = n / (1 << COMMON)

    def count(t: pa.Table) -> pa.Table:
        if "spelling" not in kept:
            kept["spelling"] = Spelling(byte_code, spelling.value)
        return _counted(t, least, kept["spelling"])

    counted = common.stored(words.groupBy("shard").applyInArrow(count, COUNTED), "counts", sweep=True)
    common.discard(spark, parts)
    totals = common.stored(texts.mapInArrow(common.trimmed(run), RUNS).groupBy("shard").applyInArrow(_run_totals, RUNS), "runs", sweep=True)
    # at most 2**COMMON words are that common, which bounds what the driver gets
    tops = counted.where("block = -1").select("distinct", "once", "hashes", "counts").collect()
    hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in tops] or [np.zeros(0, np.uint64)])
    often = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in tops] or [np.zeros(0, np.int64)])
    order = np.argsort(hashes)
    hashes, often = hashes[order], often[order]
    v = sum(r["distinct"] for r in tops) + (ends > 0)
    rare = max(0, n - ends - int(often.sum()))
    new = min(1.0, (sum(r["once"] for r in tops) + 1) / (rare + 1))  # Good and Turing's share of new words
    word_code = huffman(np.concatenate([[ends, rare], often]))
    given = spark.sparkContext.broadcast((hashes, word_code))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, step = Words(*given.value), CHUNK // 16
        for b in batches:
            for k in range(b.num_rows):
                step = _learn_block(model, b.slice(k, 1).to_pylist()[0], step)
        yield from _parts_table(_parts(model.mixer)).to_batches()

    learned = spark.sparkContext.broadcast(_merged(texts.select("ids", "texts", "size").mapInArrow(common.trimmed(learn), PARTS), ORDERS))
    known: dict[str, Words] = {}

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if "words" not in known:
            known["words"] = Words(*given.value, learned.value)
        rows = sorted(right.to_pylist(), key=lambda r: r["shard"])
        mine = [r for r in rows if r["words"] is not None]
        counts = np.concatenate([_unzip(r["counts"], np.int64, r["words"]) for r in mine] or [np.zeros(0, np.int64)])
        spelled = np.concatenate([_unzip(r["spelled"], np.float32, r["words"]) for r in mine] or [np.zeros(0, np.float32)])
        runs = [np.concatenate([_unzip_numbers(r[f"{k}_counts"], r[f"n_{k}s"]) for r in rows if r["words"] is None] or [np.zeros(0, np.uint64)]) for k in ("two", "three")]
        return pa.Table.from_batches([_score_block(known["words"], r, counts, spelled, *runs, bits, n, v, ends, rare, new) for r in left.to_pylist()])

    back = counted.where("block >= 0").select("block", "shard", "counts", "spelled", "words").unionByName(totals.drop("twos", "threes"), allowMissingColumns=True)
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, SCORED)
