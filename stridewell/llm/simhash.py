"""SimHash near-dedup: fingerprints of 4-word shingles, linked at few differing bits by generalised pigeonhole.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's shingles. Bits that go together (by
their correlation over all fingerprints) are put into the same chunk of 8 bits, chunks into parts. For thresholds t of
parts with ``sum(t + 1) > most`` two fingerprints within `most` bits differ by at most t bits in some part (-1: the part
is not looked at). Thresholds, and the number of parts, are those of least cost by dynamic programming: probes, which
are exact, and candidate pairs, which are estimated from the chunks' distances over all fingerprints. Each fingerprint
is indexed by its parts and probes every value within t bits; candidates share a value and are verified by all bits.

Different fingerprints are one row each, so that equal texts are no pairs. Keys of at most KEY_ROWS rows are tested as
they are, and leave as a forest. Of a larger one, all rows are first held against the fingerprint of most documents;
only rows that are then in another component than it meet the others, block by block.

Defined results: a text without words (null, empty) has fingerprint zero and links like any other; rows of repeated ids
are documents of their own; a null id is never a component's id, unless a component has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, textkernel as tk

#: Words of a shingle and the hash's seed.
SHINGLE, SEED = 4, 42
BITS, CHUNK = 64, 8
#: Hashes whose bits are counted at once, and pairs that are tested at once.
HASHES, PAIRS = 1 << 16, 1 << 18
#: A probe costs as much as so many candidate pairs.
PROBE = 64
#: Rows of a key that are tested as a whole, and rows of a worker's group, about.
KEY_ROWS, GROUP_ROWS = 4096, 16384


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of every run of SHINGLE lower-cased words joined by spaces, repeats included; all words if there are fewer."""
    words = text.lower().split()  # both know ASCII alone: A-Z, and space and the controls 9 to 13
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]


def bits_of(values: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each word, the highest first."""
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each row, whose hashes lie one after another."""
    ones = np.zeros((len(sizes), BITS), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(0, len(hashes), HASHES):
        r = row[i : i + HASHES]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        ones[r[first]] += np.add.reduceat(bits_of(hashes[i : i + HASHES]), first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row of docs (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = common.utf8(b.column(1))
            for i, j in common.cuts(offsets, 1 << 19):
                each = [np.array(shingle_hashes(data[x:y].tobytes()), np.uint64) for x, y in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                fp = majority(np.concatenate(each), np.array([len(x) for x in each], np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(common.trimmed(run), "doc_id long, fp long")


# statistics over all fingerprints --------------------------------------------------------------------------------------
def _summed(fps: DataFrame, count) -> list:
    """Rows x, y, c: the sums over all fingerprints of what count(words) gives as a matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                now = count(b.column(0).to_numpy().view(np.uint64))
                total = now if total is None else total + now
        if total is not None:
            x, y = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(total[x, y])], names=["x", "y", "c"])

    return fps.select("fp").mapInArrow(run, "x int, y int, c long").groupBy("x", "y").agg(F.sum("c").alias("c")).collect()


def _matrix(rows: list, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for r in rows:
        out[r["x"], r["y"]] = r["c"]
    return out


def _together(words: np.ndarray) -> np.ndarray:
    bits = bits_of(words).astype(np.float32)
    return np.rint(bits.T @ bits).astype(np.int64)


def chunks_of(both: np.ndarray, n: int) -> list[list[int]]:
    """The bits in chunks of CHUNK that go together: both[i, j] is how many of n words have bits i and j."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    while left:
        mine = [max(left, key=lambda i: (corr[i, left].max(), -i))]
        while len(mine) < CHUNK:
            mine.append(max((i for i in left if i not in mine), key=lambda i: (corr[i, mine].sum(), -i)))
        out.append(mine)
        left = [i for i in left if i not in mine]
    return out


def _cells(words: np.ndarray, chunks: list[list[int]]) -> np.ndarray:
    """How many words have each value of each chunk."""
    bits = bits_of(words)
    return np.stack([np.bincount(np.packbits(bits[:, c], axis=1)[:, 0], minlength=1 << CHUNK) for c in chunks]).astype(np.int64)


def distances(cells: np.ndarray) -> np.ndarray:
    """For each chunk the share of pairs of words that differ by 0, 1, ... CHUNK of its bits."""
    apart = np.bitwise_count(np.arange(1 << CHUNK)[:, None] ^ np.arange(1 << CHUNK)[None, :]).ravel()
    share = cells / np.maximum(cells.sum(1, keepdims=True), 1)
    return np.stack([np.bincount(apart, np.outer(p, p).ravel(), CHUNK + 1) for p in share])


def allocate(apart: np.ndarray, n: int, most: int) -> list[tuple[list[int], int]]:
    """Parts (lists of chunks) and their thresholds, of least estimated cost, such that sum(t + 1) > most.

    Distances of the chunks of a part are taken as independent.
    """
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, len(apart) + 1):
        parts = [list(map(int, x)) for x in np.array_split(np.arange(len(apart)), m)]
        # cheapest[s]: cost and thresholds of the parts so far with sum(t + 1) = s
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            share = np.ones(1)
            for c in part:
                share = np.convolve(share, apart[c])
            width, now = CHUNK * len(part), {}
            for t in range(-1, min(most, width) + 1):
                cost = 0.0 if t < 0 else PROBE * n * sum(math.comb(width, k) for k in range(t + 1)) + n * (n - 1) / 2 * share[: t + 1].sum()
                for s, (before, chosen) in cheapest.items():
                    to = min(s + t + 1, most + 1)
                    if to not in now or before + cost < now[to][0]:
                        now[to] = (before + cost, [*chosen, t])
            cheapest = now
        if most + 1 in cheapest and cheapest[most + 1][0] < best[0]:
            best = (cheapest[most + 1][0], list(zip(parts, cheapest[most + 1][1], strict=True)))
    return best[1]


def masks_of(chunks: list[list[int]], plan: list[tuple[list[int], int]]) -> list[tuple[int, list[int]]]:
    """For each part that is looked at: its bits as a mask, and what a probe flips (0, the part itself, first)."""
    out = []
    for part, t in plan:
        if t >= 0:
            bits = [1 << (BITS - 1 - i) for c in part for i in chunks[c]]
            out.append((sum(bits), [0] + _flips(bits, t)))
    return out


def _flips(bits: list[int], t: int) -> list[int]:
    out, last = [], [(0, 0)]
    for _ in range(t):
        last = [(f | bits[i], i + 1) for f, at in last for i in range(at, len(bits))]
        out += [f for f, _ in last]
    return out


# links ---------------------------------------------------------------------------------------------------------------
def _entries(fps: DataFrame, masks: list[tuple[int, list[int]]]) -> DataFrame:
    """key, fp, own: each fingerprint at its own value of every part (own), and at the values that it probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for k, (mask, flips) in enumerate(masks):
                salt = tk.mix(np.array([k + 1], np.uint64))[0]
                for i in range(0, len(flips), 64):
                    some = np.array(flips[i : i + 64], np.uint64)
                    key = tk.mix(((fp & np.uint64(mask))[:, None] ^ some) ^ salt)
                    own = np.zeros(key.shape, bool)
                    own[:, 0] = i == 0
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp.view(np.int64), len(some))), pa.array(own.ravel())], names=["key", "fp", "own"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, own boolean")


class _Forest:
    """Labels of words that links join, and the links that made them."""

    def __init__(self, n: int):
        self.label, self.a, self.b = np.arange(n), [], []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        new = np.flatnonzero(x != y)
        if not len(new):
            return
        pairs, at = np.unique(np.column_stack([np.minimum(x, y)[new], np.maximum(x, y)[new]]), axis=0, return_index=True)
        up = {}

        def top(i: int) -> int:
            while i in up:
                i = up[i]
            return i

        for (p, q), k in zip(pairs.tolist(), new[at].tolist(), strict=True):
            p, q = top(p), top(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                self.a.append(int(a[k]))
                self.b.append(int(b[k]))
        if up:
            to = np.arange(len(self.label))
            for i in up:
                to[i] = top(i)
            self.label = to[self.label]


def tied(key: np.ndarray, fp: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what shares a key, one of them its own, and differs by at most `most` bits: a forest."""
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    words, node = np.unique(fp[order], return_inverse=True)
    partners = np.searchsorted(key, key, "right") - np.arange(len(key)) - 1
    upto, forest, i = np.cumsum(partners), _Forest(len(words)), 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
        p, q = np.repeat(np.arange(i, j), partners[i:j]), tk.flat_ranges(np.arange(i, j) + 1, partners[i:j])
        may = own[p] | own[q]
        p, q = node[p[may]], node[q[may]]
        near = np.bitwise_count(words[p] ^ words[q]) <= most
        forest.join(p[near], q[near])
        i = j
    return words[forest.a], words[forest.b]


def across(side: np.ndarray, fp: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same between the rows with side 0 and those with side 1."""
    words, node = np.unique(fp, return_inverse=True)
    left, right, forest = np.flatnonzero(side == 0), np.flatnonzero(side == 1), _Forest(len(words))
    step = max(1, PAIRS // max(1, len(right)))
    for i in range(0, len(left), step):
        p, q = np.repeat(left[i : i + step], len(right)), np.tile(right, len(left[i : i + step]))
        may = own[p] | own[q]
        p, q = node[p[may]], node[q[may]]
        near = np.bitwise_count(words[p] ^ words[q]) <= most
        forest.join(p[near], q[near])
    return words[forest.a], words[forest.b]


def _column(t: pa.Table, name: str) -> np.ndarray:
    return common.one(t.column(name)).to_numpy(zero_copy_only=False)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def _of_large(hot: DataFrame, most: int, held: list[str]) -> DataFrame:
    """Links of keys with many rows: hot has key, fp, own, n and head, the key's fingerprint of most documents."""
    star = common.stored(hot.where("fp <> head").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= most).select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct(), "star", held)
    of = graph.components(star)
    marked = hot.join(common.shuffled(of.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    marked = marked.join(common.shuffled(of.select(F.col("node").alias("head"), F.col("root").alias("far"))), "head", "left").withColumn("rest", F.col("root") != F.coalesce("far", "head"))
    marked = common.stored(marked.select("key", "fp", "own", "n", "rest"), "marked", held)
    some = marked.groupBy("key").agg(F.count_if("rest").alias("r")).where("r > 0")
    marked = marked.join(some, "key").withColumns({"rb": F.ceil(F.col("r") / F.lit(KEY_ROWS)).cast("int"), "ab": F.ceil(F.col("n") / F.lit(KEY_ROWS)).cast("int")})

    def spot(blocks: str) -> F.Column:
        return F.pmod(F.xxhash64("fp"), F.col(blocks)).cast("int")

    def every(blocks: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = marked.where("rest").select("key", "fp", "own", F.lit(0).alias("side"), spot("rb").alias("x"), every("ab").alias("y"))
    right = marked.select("key", "fp", "own", F.lit(1).alias("side"), every("rb").alias("x"), spot("ab").alias("y"))

    def run(t: pa.Table) -> pa.Table:
        return _pairs(*across(_column(t, "side"), _column(t, "fp").view(np.uint64), _column(t, "own"), most))

    return star.union(left.union(right).groupBy("key", "x", "y").applyInArrow(run, "a long, b long"))


def links(fps: DataFrame, masks: list[tuple[int, list[int]]], n: int, most: int, held: list[str]) -> DataFrame:
    """a, b: links that join all fingerprints of fps (fp, copies; different ones, n) that differ by at most `most` bits."""
    entries = _entries(fps, masks)
    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("k")).where("n > 1 and k > 0")
    both = common.stored(entries.join(common.shuffled(keys), "key").select("key", "fp", "own", "n"), "candidates", held)
    groups = F.lit(max(1, both.count() // GROUP_ROWS))

    def run(t: pa.Table) -> pa.Table:
        return _pairs(*tied(_column(t, "key"), _column(t, "fp").view(np.uint64), _column(t, "own"), most))

    few = both.where(F.col("n") <= KEY_ROWS).select(F.pmod("key", groups).alias("part"), "key", "fp", "own")
    out = few.groupBy("part").applyInArrow(run, "a long, b long")
    large = both.where(F.col("n") > KEY_ROWS)
    if not large.isEmpty():
        heads = large.where("own").join(common.shuffled(fps.select("fp", "copies")), "fp").groupBy("key").agg(F.max(F.struct("copies", "fp"))["fp"].alias("head"))
        out = out.union(_of_large(common.stored(large.join(heads, "key"), "large", held), most, held))
    return common.stored(out, "near", held, n)


def simhash_components(docs: DataFrame, most: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable by links, itself included).

    Links join texts whose fingerprints differ by at most `most` bits.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    held: list[str] = []
    src = common.plain(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = common.stored(fingerprints(src), "fingerprints")
    fps = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    n = fps.count()
    chunks = chunks_of(_matrix(_summed(fps, _together), (BITS, BITS)), n)
    apart = distances(_matrix(_summed(fps, lambda words: _cells(words, chunks)), (BITS // CHUNK, 1 << CHUNK)))
    masks = masks_of(chunks, allocate(apart, n, most))
    near = links(fps, masks, n, most, held)
    found = graph.components(near, near.count())
    common.discard(spark, held)

    # fingerprints that are linked, or that several documents have; all others are their document's own
    of = fps.join(common.shuffled(found.withColumnRenamed("node", "fp")), "fp", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "fp"))
    of = of.join(common.shuffled(of.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("fp", "component_id")
    out = rows.join(common.shuffled(of), "fp", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return common.compact(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), rows.count())
