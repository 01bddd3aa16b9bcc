"""Repeated substrings: merged Burrows-Wheeler transforms find each string of LENGTH symbols that starts anywhere else too.

Symbols are a text's bytes, or its words. Anchors cut the problem into parts that any number of tasks can take: in every
window of LENGTH symbols the string of `anchor` symbols with the smallest hash is an anchor, so equal windows have equal
anchors at equal places. An anchor's windows fall into two classes, by where they start; all windows of a class contain
its core (232 of 400 bytes). A core with what is around it (168 bytes on either side, or up to the text's end) is a
stretch. Windows of different cores differ, so cores that occur once are done. Equal stretches are counted, not kept. A
core's different stretches, aligned at the core, are dealt to shards whose transforms are merged by interleave
refinement; last-to-first steps through the merged transform leave the repeated windows as intervals of suffixes with a
common prefix of a window (bwt.py). A core with more than MOST stretches is first split into two longer cores with less
around them, until few enough differ; with nothing around, all are equal. So no task holds more than MOST stretches of
a core.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; every row of an id that occurs twice
counts as a text of its own and gets its own result. Matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, common, textkernel as tk

MOST, PART, BLOCK = 8192, 8192, 1 << 18
#: Bytes of spans that may be broadcast, after adding them up; more are joined by shuffle.
MOST_BROADCAST = 16 << 20
#: Rows of places of stretches that may be broadcast (of 40 bytes each), after counting them.
MOST_LISTED = 20_000


class Unit(NamedTuple):
    """What a symbol is. length: of a window; anchor: of an anchor, odd as length is or even as it is."""

    name: str
    length: int
    anchor: int

    @property
    def around(self) -> int:
        return (self.length - self.anchor) // 2

    @property
    def core(self) -> int:
        return self.length - self.around

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.name == "bytes":
            return data, offsets
        start, end, row = tk.word_spans(data, offsets)
        return tk.span_hashes(data, start, end), np.searchsorted(row, np.arange(len(offsets)))


def of_bytes(length: int) -> Unit:
    """Windows of bytes; their anchors have 64, or less in short windows."""
    anchor = min(64, length // 3)
    return Unit("bytes", length, anchor - (length - anchor) % 2)


def of_words(length: int) -> Unit:
    """Windows of words, whatever stands between them; upper and lower case differ."""
    anchor = max(1, length // 5)
    return Unit("words", length, anchor - (length - anchor) % 2 or 2)


def _prefix(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tk.powers(tk.BASE, len(data))[: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tk.mix((sums[b] - sums[a]) * tk.powers(tk.UNBASE, len(sums))[a] + (b - a).astype(np.uint64))


def _sliding(x: np.ndarray, w: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over x[i : i + w] for each i, in two running passes."""
    n = len(x)
    p = np.full(-(-(n + w) // w) * w, fill, x.dtype)
    p[:n] = x
    q = p.reshape(-1, w)
    ahead = pick.accumulate(q, 1).reshape(-1)
    behind = pick.accumulate(q[:, ::-1], 1)[:, ::-1].reshape(-1)
    return pick(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(sums: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors, and their rows: for each window of each row, all its anchors, those of smallest hash."""
    n = len(sums) - 1
    size = np.diff(offsets)
    length, wide = unit.length, unit.anchor
    w = length - wide + 1
    if not n or size.max(initial=0) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = np.uint32(0xFFFFFFFF)
    h = np.full(n, top, np.uint32)
    m = max(0, n - wide + 1)
    full = sums[wide:] - sums[:m]
    full *= tk.powers(tk.UNBASE, m)[:m]
    full *= np.uint64(0x9FB21C651E98DF25)
    full >>= np.uint64(32)
    h[:m] = full
    short, none = np.zeros(n, bool), np.zeros(n, bool)  # where no anchor, and no window, fits
    some = offsets[1:][size > 0]
    for k in range(1, wide):
        short[np.maximum(some - k, offsets[:-1][size > 0])] = True
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    none = np.cumsum(edge[:-1]) > 0
    h[short] = top
    low = _sliding(h, w, np.minimum, 0xFFFFFFFF)
    low[none] = 0
    # the largest of the minima of the windows around p: p is an anchor if that is its own hash
    high = _sliding(low[::-1], w, np.maximum, 0)[::-1]
    found = np.flatnonzero((h == high) & ~short & (high > 0))
    return found, np.searchsorted(offsets, found, "right") - 1


def stretches(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Of each anchor and class: row, start of the core, symbols before and after it, hashes of core and of stretch."""
    sums = _prefix(data)
    p, row = anchors(sums, offsets, unit)
    around, core = unit.around, unit.core
    # a core may belong to two anchors: to one as its first class, to the other as its second
    c, first = np.unique(np.concatenate([p, p - around]), return_index=True)
    row = np.concatenate([row, row])[first]
    a = np.minimum(around, c - offsets[row])
    b = np.minimum(around, offsets[row + 1] - c - core)
    ok = (a >= 0) & (b >= 0) & (a + b >= around)
    c, a, b, row = c[ok], a[ok], b[ok], row[ok]
    return row, c, a, b, _hashes(sums, c, c + core), _hashes(sums, c - a, c + core + b) ^ tk.mix(a.astype(np.uint64) + np.uint64(99))


def _joined(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals that overlap or touch."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    a, z = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > z[:-1]
    at = np.flatnonzero(new)
    return a[at], z[np.append(at[1:], len(a)) - 1]


OCCURS = "doc long, key long, same long, count int, start long, before int, after int"


def _occurrences(docs: DataFrame, unit: Unit) -> DataFrame:
    """A row for each different stretch of a text: its core's and its own hash, how often (2: twice or more), and where.

    Rows without a key are spans [start, start + before) of stretches that one text has twice or more, which are
    repeated whole.
    """
    core = unit.core

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OCCURS.split(", ")]
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in common.cuts(offsets, BLOCK):
                d, offs = unit.symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(d):
                    continue
                r, c, a, b, key, same = stretches(d, offs, unit)
                order = np.lexsort((c, same, key, r))
                r, c, a, b, key, same = (x[order] for x in (r, c, a, b, key, same))
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (key[1:] != key[:-1]) | (same[1:] != same[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(r)))
                many = np.repeat(count > 1, count)
                s, z = _joined(c[many] - a[many], c[many] + core + b[many])  # rows lie apart, as no stretch crosses them
                of = np.searchsorted(offs, s, "right") - 1
                # touching spans of neighbouring rows are cut at the rows' ends
                last = np.searchsorted(offs, z, "left") - 1
                k = last - of + 1
                of2 = np.repeat(of, k) + tk.flat_ranges(np.zeros(len(k), np.int64), k)
                s2 = np.maximum(np.repeat(s, k), offs[of2])
                z2 = np.minimum(np.repeat(z, k), offs[of2 + 1])
                m, t = len(at), len(of2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + r[at]]), pa.array(key[at].view(np.int64)), pa.array(same[at].view(np.int64)), pa.array(np.minimum(count, 2).astype(np.int32)), pa.array(c[at] - offs[r[at]]), pa.array(a[at].astype(np.int32)), pa.array(b[at].astype(np.int32))], names=names)
                if t:
                    z0 = pa.nulls(t, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + of2]), z0, z0, pa.nulls(t, pa.int32()), pa.array(s2 - offs[of2]), pa.array((z2 - s2).astype(np.int32)), pa.nulls(t, pa.int32())], names=names)

    return docs.mapInArrow(common.trimmed(run), OCCURS)


PIECES = "key long, same long, left binary, right binary, around int, shift int, count long, doc long, start long, root_key long, root_same long"


def _cut_out(docs: DataFrame, wanted: DataFrame, few: bool, unit: Unit) -> DataFrame:
    """wanted (doc, start, before, after, key, same, count) with the symbols before and after the core (PIECES).

    few: whether wanted has at most MOST_LISTED rows.
    """
    core, around = unit.core, unit.around
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "before", "after", "key", "same", "count")).alias("w"))
    joined = docs.join(F.broadcast(lists) if few else lists, "doc").select("text", "w", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(0))
            ends = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            w, doc = batch.column(1).flatten(), batch.column(2)
            for i, j in common.cuts(offsets, BLOCK):
                d, offs = unit.symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                x, y = int(ends[i]), int(ends[j])
                if x == y:
                    continue
                part, wide, raw = w.slice(x, y - x), d.itemsize, d.tobytes()  # pyarrow never lets go of views that it makes arrays of
                start, before, after, key, same, count = (part.field(f) for f in range(6))
                row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                c = start.to_numpy() + offs[row]
                z = c + core
                left = [raw[p:q] for p, q in zip(((c - before.to_numpy()) * wide).tolist(), (c * wide).tolist(), strict=True)]
                right = [raw[p:q] for p, q in zip((z * wide).tolist(), ((z + after.to_numpy()) * wide).tolist(), strict=True)]
                m = y - x
                yield pa.RecordBatch.from_arrays([
                    key, same, pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(np.full(m, around, np.int32)), pa.array(np.zeros(m, np.int32)),
                    count, doc.slice(i, j - i).take(pa.array(row)), start, key, same,
                ], names=NAMES)

    return joined.mapInArrow(common.trimmed(run), PIECES)


NAMES = [c.split()[0] for c in PIECES.split(", ")]
FOUND = "root_key long, root_same long, low int, high int"


def _sides(column: pa.ChunkedArray, e: int, kind: type, at_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of e symbols with those of a binary column at their end or start, and how many each has."""
    data, offsets = common.utf8(common.one(column).cast(pa.large_binary()))
    data, offsets = np.ascontiguousarray(data).view(kind), offsets // np.dtype(kind).itemsize
    size = np.diff(offsets)
    m = len(size)
    out = np.zeros(m * e, kind)
    out[tk.flat_ranges(np.arange(m) * e + (e - size if at_end else 0), size)] = data
    return out.reshape(m, e), size


def _by_transform(t: pa.Table, kind: type) -> pa.Table:
    """Of the stretches of some cores: the first and last window, counted back from the first core's start, that repeat."""
    found = []
    around = t.column("around").to_numpy()
    for e in np.unique(around).tolist():  # cores that were split have less around them
        mine = t.filter(pa.array(around == e))
        left, before = _sides(mine.column("left"), e, kind, True)
        right, after = _sides(mine.column("right"), e, kind, False)
        core = np.unique(mine.column("key").to_numpy(), return_inverse=True)[1]
        low, high = bwt.repeated(core, left, before, right, after)
        got = np.flatnonzero(high >= 0)
        some, shift = mine.take(pa.array(got)), mine.column("shift").to_numpy()[got]
        found.append(pa.table({"root_key": some.column("root_key"), "root_same": some.column("root_same"), "low": pa.array((low[got] + shift).astype(np.int32)), "high": pa.array((high[got] + shift).astype(np.int32))}))
    out = pa.concat_tables(found)
    del mine, left, right, some
    common.give_back()  # the worker lives on beside later stages
    return out


def _split(rows: DataFrame, wide: int) -> DataFrame:
    """Each stretch as two with longer cores: for the windows that start in the nearer half, and in the farther."""
    def named(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(len(x).to_bytes(4, "little") + x for x in parts), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                e = r["around"]
                half, left, right = (e - e // 2) * wide, r["left"], r["right"]
                now = e // 2
                for cut in (0, half):  # the core grows to the right, or to the left
                    if len(left) < cut or len(right) < half - cut:
                        continue
                    more = left[len(left) - cut :] or right[:half]
                    l, g = left[: len(left) - cut], right[half - cut :]
                    l, g = l[max(0, len(l) - now * wide) :], g[: now * wide]
                    if len(l) + len(g) < now * wide:
                        continue
                    key = named(r["key"].to_bytes(8, "little", signed=True), more, bytes([cut > 0, now % 256]))
                    step = cut // wide
                    out.append(r | {"key": key, "same": named(key.to_bytes(8, "little", signed=True), l, g), "left": l, "right": g, "around": now, "shift": r["shift"] + step, "start": r["start"] - step})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    return rows.mapInArrow(common.trimmed(run), PIECES)


def _merged(rows: DataFrame, total: int, kind: type) -> DataFrame:
    """FOUND for pieces of cores that have MOST at most; total: rows, or more."""
    return rows.groupBy(F.pmod("key", F.lit(max(1, total // PART))).alias("_part")).applyInArrow(lambda t: _by_transform(t, kind), FOUND)


def _different(docs: DataFrame, wanted: DataFrame, unit: Unit, held: list[str]) -> DataFrame:
    """FOUND for cores of several stretches, by merged transforms, after splitting the cores of too many.

    wanted: as for _cut_out.
    """
    kind = np.uint8 if unit.name == "bytes" else np.uint64
    wide = np.dtype(kind).itemsize
    total = wanted.count()
    large = common.stored(wanted.groupBy("key").count().where(F.col("count") > MOST).select("key"), "large", held, total // MOST)
    pieces = _cut_out(docs, wanted, total <= MOST_LISTED, unit)
    if large.isEmpty():
        return common.stored(_merged(pieces, total, kind), "repeats", held, 20 * total)
    pieces = common.stored(pieces, "pieces", held)
    found = common.stored(_merged(pieces.join(large, "key", "left_anti").select(NAMES), total, kind), "repeats", held, 20 * total)
    rows = pieces.join(large, "key", "left_semi").select(NAMES)
    is_many = F.col("kinds") > MOST
    while True:
        halves = common.stored(_split(rows, wide), "halves", held)
        apart = halves.groupBy("key", "same", "doc", "start").agg(F.max("count").alias("count"), F.min(F.struct("root_key", "root_same")).alias("first"))
        alike = apart.groupBy("key", "same").agg(F.sum("count").alias("all"), F.min("first").alias("first"))
        marked = common.stored(halves.join(alike, ["key", "same"]), "alike", held)
        # equal stretches repeat whole: all windows that fit
        fits = F.col("around") - F.length("right") / F.lit(wide)
        whole = marked.where("all > 1").select("root_key", "root_same", (F.greatest(fits, F.lit(0)) + F.col("shift")).cast("int").alias("low"), (F.length("left") / F.lit(wide) + F.col("shift")).cast("int").alias("high"))
        found = found.union(whole)
        one = marked.where((F.col("first.root_key") == F.col("root_key")) & (F.col("first.root_same") == F.col("root_same"))).dropDuplicates(["key", "same"])
        kinds = one.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        sized = common.stored(one.join(kinds, "key").withColumn("count", F.col("all")).select(*NAMES, "kinds"), "sized", held)
        n = sized.agg(F.count(F.when(~is_many, 1)).alias("few"), F.count(F.when(is_many, 1)).alias("many")).first()
        if n["few"]:
            found = found.union(common.stored(_merged(sized.where(~is_many).select(NAMES), n["few"], kind), "repeats", held))
        if not n["many"]:
            return found
        rows = sized.where(is_many).select(NAMES)


def repeated_spans(docs: DataFrame, unit: Unit) -> DataFrame:
    """doc, spans (array of [first, last) symbols, apart and in order) of the texts that have symbols in repeats.

    docs: doc (a long that no other row has), text. The result is stored.
    """
    around, held = unit.around, []
    occurs = common.stored(_occurrences(docs, unit), "occurs", held)
    keyed = occurs.where("key is not null")
    n = occurs.count()
    cores = keyed.groupBy("key").agg(F.sum("count").alias("every"), (F.min("same") != F.max("same")).alias("several")).where("every > 1")
    again = common.stored(keyed.join(cores.select("key", "several"), "key"), "again", held, n)  # all that follows is of these
    alike = again.groupBy("key", "same", "several").agg(F.sum("count").alias("all"), F.min(F.struct("doc", "start", "before", "after")).alias("one"))
    alike = common.stored(alike, "alike", held, n)
    # one text for each different stretch of a core that has several
    wanted = alike.where("several").select(F.col("one.doc").alias("doc"), F.col("one.start").alias("start"), F.col("one.before").alias("before"), F.col("one.after").alias("after"), "key", "same", F.col("all").alias("count"))
    found = _different(docs, wanted, unit, held)
    whole = alike.where("all > 1").select(F.col("key").alias("root_key"), F.col("same").alias("root_same"), (F.lit(around) - F.col("one.after")).alias("low"), F.col("one.before").alias("high"))
    reach = found.union(whole.select("root_key", "root_same", F.col("low").cast("int"), F.col("high").cast("int"))).groupBy("root_key", "root_same").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hits = again.join(reach, (F.col("key") == F.col("root_key")) & (F.col("same") == F.col("root_same")))
    spans = hits.select("doc", (F.col("start") - F.col("high")).alias("first"), (F.col("start") - F.col("low") + unit.length).alias("last"))
    spans = spans.union(occurs.where("key is null").select("doc", F.col("start").alias("first"), (F.col("start") + F.col("before")).alias("last")))
    out = common.stored(_unions(spans), "spans", rows=n)
    common.discard(docs.sparkSession, held)
    return out


def _unions(spans: DataFrame) -> DataFrame:
    """doc, spans: the spans of each doc, joined where they overlap or touch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            inner = lists.flatten()
            first, last = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = []
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                a, z = _joined(first[x:y], last[x:y])
                out.append([{"first": p, "last": q} for p, q in zip(a.tolist(), z.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], names=["doc", "spans"])

    lists = spans.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return lists.mapInArrow(common.trimmed(run), "doc long, spans array<struct<first:bigint,last:bigint>>")


MEASURES = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _with_spans(docs: DataFrame, units: list[Unit], doc_id: str, text: str) -> DataFrame:
    """docs with a last column more for each unit: what repeats of each text (null: nothing).

    Texts are told apart by doc_id; where an id is null or occurs twice, rows are numbered first.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    full, key = common.keyed(docs, doc_id)
    texts = full.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out, names = full, list(docs.columns)
    for unit in units:
        spans = repeated_spans(texts, unit)
        size = spans.agg(F.coalesce(F.sum(16 * F.size("spans") + 24), F.lit(0)).alias("bytes")).first()["bytes"]
        added = common.fresh(out, f"_spans_{unit.name}")
        spans = spans.select(F.col("doc").alias(key), F.col("spans").alias(added))
        out, names = out.join(F.broadcast(spans) if size <= MOST_BROADCAST else spans, key, "left"), [*names, added]
    return out.select(names)


def _in_bytes(raw: bytes, spans: list[dict] | None, unit: Unit) -> list[tuple[int, int]]:
    """Byte ranges of the spans of a text, apart and in order; a word goes with what stands before the next one."""
    if not spans:
        return []
    first, last = _joined(np.array([s["first"] for s in spans], np.int64), np.array([s["last"] for s in spans], np.int64))
    if unit.name == "words":
        start = np.append(tk.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], len(raw))
        first, last = start[first], start[last]
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    if not gone:
        return raw
    ends = [0, *(x for span in gone for x in span), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True))


def measure_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are left).

    passage: also passage_bytes, the bytes in runs of so many words or more that occur anywhere else too.
    """
    src = common.plain(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    units = [of_bytes(length)] + ([of_words(passage)] if passage else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [(t or "").encode() for t in b.column(1).to_pylist()]
            gone = [[_in_bytes(raw, s, u) for raw, s in zip(raws, b.column(2 + k).to_pylist(), strict=True)] for k, u in enumerate(units)]
            kept = [_kept(raw, g) for raw, g in zip(raws, gone[0], strict=True)]
            columns = [
                b.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([len(r) - len(k) for r, k in zip(raws, kept, strict=True)], pa.int64()),
                pa.array([len(g) for g in gone[0]], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ]
            columns += [pa.array([sum(y - x for x, y in g) for g in more], pa.int64()) for more in gone[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_bytes"][: len(columns)])

    return _with_spans(src, units, "doc_id", "text").mapInArrow(common.trimmed(run), f"doc_id {kind}, {MEASURES}{', passage_bytes long' if passage else ''}")


def cut_repeats(docs: DataFrame, unit: Unit = of_bytes(400), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the repeats in their texts; other columns are passed on, null texts stay null.

    Where a cut falls inside a character, what is left of the character goes too.
    """
    joined = _with_spans(docs, [unit], doc_id, text)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(at).to_pylist(), b.column(len(names)).to_pylist()
            left = [t if not s or t is None else _kept(raw := t.encode(), _in_bytes(raw, s, unit)).decode(errors="ignore") for t, s in zip(texts, spans, strict=True)]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(common.trimmed(run), docs.schema)
