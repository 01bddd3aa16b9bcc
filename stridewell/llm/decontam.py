"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased runs of letters and digits. Every SEED-word run of a test item is counted over all texts; all
runs that occur, overlapping and frequent ones too, are its seeds. A text is compared with an item wherever it holds
one of its seeds, in a window around the seed that is half an item longer on either side than the item. The item's
words that the window holds bound the score, so windows of frequent phrases that cannot reach the threshold are spared
the alignment, and none that can. Smith-Waterman (match 2, mismatch -1, gap -1) scores the best local alignment; its score divided by that of
the whole item is the likeness, so edited, cut and paraphrased copies count by what is left of them. A text is
contaminated by an item from `threshold` on.

Items (usually few) are indexed by hash. Where there are more than MOST_INDEXED runs, they are dealt to parts by item,
and each part passes over the texts; no part of the work is left out.

A copy that keeps no SEED words of its item in a row is not seen, whatever its likeness (say a word put in after every
two).

Defined results: null or empty items and texts match nothing; an item of fewer than SEED words is one seed, and matches
only whole; repeated ids are texts of their own and may give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkernel as tk

SEED, THRESHOLD = 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK, MOST_INDEXED = 1 << 19, 2_000_000

KEEP = np.zeros(256, bool)
KEEP[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and their rows."""
    low = tk.LOWER[data]
    solid = KEEP[low]
    n = len(low)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | first[1:]
    end[:-1] &= ~solid[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return tk.span_hashes(low, s, e), np.searchsorted(offsets, s, "right") - 1


def runs(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words, and where they start; none crosses a row."""
    if len(h) < k:
        return h[:0], np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
    x = np.zeros(len(at), np.uint64)
    for j in range(k):
        x = x * np.uint64(tk.BASE) + h[at + j]
    return tk.mix(x), at


class Items:
    """Test items: their words, and all their runs, sorted."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [(i, t.encode()) for i, t in items]
        self.ids, self.words = [], []
        for i, b in raw:
            h, _ = words(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
            if len(h):
                self.ids.append(i)
                self.words.append(h)
        found = []  # run, item, place
        for n, h in enumerate(self.words):
            x, at = runs(h, np.zeros(len(h), np.int64), min(SEED, len(h)))
            found += [(int(a), n, int(p), min(SEED, len(h))) for a, p in zip(x.tolist(), at.tolist(), strict=True)]
        found.sort()
        self.run = np.array([f[0] for f in found], np.uint64)
        self.item = np.array([f[1] for f in found], np.int64)
        self.place = np.array([f[2] for f in found], np.int64)
        self.size = np.array([f[3] for f in found], np.int64)
        self.uniq = np.unique(self.run)

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the item runs found in a block (an index into uniq), and where."""
        out = []
        for k in range(1, SEED + 1):
            if not (self.size == k).any():
                continue
            x, at = runs(h, row, k)
            low = FILTER_BITS - 1
            if not hasattr(self, "filter"):
                self.filter = np.zeros(1 << FILTER_BITS, bool)
                self.filter[(self.uniq & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            maybe = np.flatnonzero(self.filter[(x & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]) if low else at
            x, at = x[maybe], at[maybe]
            i = np.minimum(np.searchsorted(self.uniq, x), len(self.uniq) - 1)
            ok = self.uniq[i] == x
            out.append((i[ok], at[ok]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def choose(self, count: np.ndarray) -> None:
        """Keeps as seeds the runs that occur."""
        keep = count[np.searchsorted(self.uniq, self.run)] > 0
        self.run, self.item, self.place, self.size = (x[keep] for x in (self.run, self.item, self.place, self.size))
        self.uniq = np.unique(self.run)
        if hasattr(self, "filter"):
            del self.filter


FILTER_BITS = 20


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two rows of words: score, and the first and last (exclusive) word of text in it.

    A row of the table at a time; gaps along the row by a running maximum.
    """
    n = len(text)
    steps = np.arange(n + 1) * -GAP
    prev, since = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diag = prev[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        now = np.zeros(n + 1, np.int64)
        now[1:] = np.maximum(np.maximum(diag, up), 0)
        begin = np.arange(n + 1)
        begin[1:] = np.where(now[1:] == 0, np.arange(1, n + 1), np.where(diag >= up, since[:-1], since[1:]))
        lift = now + steps  # a gap from column j to i costs (i - j) * -GAP
        top = np.maximum.accumulate(lift)
        first = np.maximum.accumulate(np.where(lift == top, np.arange(n + 1), 0))
        gap = top - steps
        better = gap > now
        now = np.where(better, gap, now)
        begin = np.where(better, begin[first], begin)
        end = int(now.argmax())
        if now[end] > best[0]:
            best = (int(now[end]), int(begin[end]), end)
        prev, since = now, begin
    return best


def _matches(h: np.ndarray, row: np.ndarray, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """Row, item, likeness, first and last word of each contaminated row of a block."""
    which, at = items.hits(h, row)
    if not len(which):
        return []
    ends = np.searchsorted(items.run, items.uniq[which], "right")
    starts = np.searchsorted(items.run, items.uniq[which], "left")
    f = tk.flat_ranges(starts, ends - starts)
    of = np.repeat(np.arange(len(which)), ends - starts)
    r, item, begin = row[at[of]], items.item[f], at[of] - items.place[f]  # where the item would start
    first = np.searchsorted(row, np.arange(row[-1] + 2))
    out = []
    order = np.lexsort((begin, item, r))
    i = 0
    while i < len(order):
        x = order[i]
        size = len(items.words[item[x]])
        j, last = i + 1, begin[x]
        # seeds close to each other share a window
        while j < len(order) and r[order[j]] == r[x] and item[order[j]] == item[x] and begin[order[j]] - last <= size:
            last = begin[order[j]]
            j += 1
        a = max(first[r[x]], begin[x] - size // 2)
        z = min(first[r[x] + 1], last + size + size // 2 + 1)
        i = j
        if np.isin(items.words[item[x]], h[a:z]).sum() < threshold * size:  # no score is above that of these words
            continue
        score, s, e = align(h[a:z], items.words[item[x]])
        like = score / (MATCH * size)
        if like >= threshold:
            out.append((int(r[x]), int(item[x]), like, int(a + s - first[r[x]]), int(a + e - first[r[x]])))
    best: dict[tuple[int, int], tuple] = {}
    for m in out:
        if m[:2] not in best or m[2] > best[m[:2]][2]:
            best[m[:2]] = m
    return list(best.values())


FOUND = "item_id long, likeness double, first_word int, last_word int"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, likeness, first_word, last_word (exclusive): a row for each text and item that it holds."""
    spark = docs.sparkSession
    common.small_batches(spark)
    src = common.plain(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    tests = common.plain(benchmark, item_id=item_id, text=item_text).where("text is not null").withColumn("item_id", F.col("item_id").cast("long"))
    words_in_all = tests.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("w")).first()["w"]
    parts = 1 + int(words_in_all) // MOST_INDEXED
    found = None
    for part in range(parts):  # one, unless the benchmark is very large
        mine = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else tests
        items = Items([(r["item_id"], r["text"]) for r in mine.distinct().orderBy("item_id", "text").collect()])
        if not items.ids:
            continue
        shared = spark.sparkContext.broadcast(items)  # of at most MOST_INDEXED words or so

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value.uniq), np.int64)
            for b in batches:
                data, offsets = common.utf8(b.column(0))
                for i, j in common.cuts(offsets, BLOCK):
                    h, row = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    total += np.bincount(shared.value.hits(h, row)[0], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["run", "n"])

        counts = np.zeros(len(items.uniq), np.int64)
        for r in src.select("text").mapInArrow(common.trimmed(count), "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).collect():
            counts[r["run"]] = r["n"]
        items.choose(counts)
        seeds = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = common.utf8(b.column(1))
                for i, j in common.cuts(offsets, BLOCK):
                    h, row = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    got = _matches(h, row, seeds.value, threshold)
                    if got:
                        at, item, like, a, z = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i + x for x in at])), pa.array([seeds.value.ids[x] for x in item], pa.int64()), pa.array(like), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["doc_id", "item_id", "likeness", "first_word", "last_word"])

        these = src.mapInArrow(common.trimmed(find), f"doc_id {kind}, {FOUND}")
        found = these if found is None else found.union(these)
    return found if found is not None else spark.createDataFrame([], f"doc_id {kind}, {FOUND}")
