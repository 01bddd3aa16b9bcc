"""N-gram Jaccard join: token-combination prefixes, then verification.

A text is the set of its distinct k-word shingles (64-bit hashes); a text of fewer words is one shingle of them all.
Two texts link when ``den * |A & B| >= num * |A | B|``. Shingles are ordered, rare ones first. At most
``t = |A| - ceil(num * |A| / den)`` shingles of A are missing from a partner, so a prefix that holds more than t
"guarantees" must share one with the partner's prefix. A rare shingle is a guarantee by itself and is indexed alone.
Frequent shingles are dealt to cells by hash; the second and later ones of a cell are guarantees, since two of them are
then shared, and all pairs of a cell are indexed. Prefixes grow until they hold enough.

Candidates are the sets that share an index key, of compatible sizes and places. First each key's sets are held against
the one with the fewest shingles of its own before the key. Keys whose sets are then in different components are dealt
to workers, which test the pairs that are left by sizes, places and counts of shingles in CELLS cells; only pairs whose
counts allow a link leave a worker. All pairs that are linked have been verified exactly. Frequency comes from a count
sketch over all shingles, of 2**SKETCH_BITS places; it only decides order and class, never what links.

Defined results: texts without words (or null) have no shingles, link with nothing and are their own component; equal
sets are one set; repeated ids count as one document each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph, textkernel as tk

SKETCH_BITS, SLICES, BLOCK = 21, 16, 1 << 19
#: Sets of fewer than 2**LEAST_CELLS shingles index every shingle alone. A set of 2**g has 2**g / PER_CELL cells.
LEAST_CELLS, PER_CELL, SALTS = 6, 8, 64
#: Cells of the counts that bound what two sets share.
CELLS = 192
#: Ids (8 bytes each) that may be broadcast, after counting them; more are joined by shuffle.
MOST_BROADCAST = 500_000
#: Sets of a key that a worker tests as a whole; those of a larger one are dealt to blocks, and pairs of blocks to workers.
KEY_ROWS = 2048
#: Rows of a worker's group, about, and pairs that it tests at once.
GROUP_ROWS, PAIRS = 16384, 1 << 18

SETS = "doc_id long, n long, sid long, slice int, counts binary"


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their rows, each row's size, and a hash of each row's set."""
    n = len(offsets) - 1
    h, row = tk.distinct_by_row(*tk.Words(data, offsets).shingles(k))
    size = np.bincount(row, minlength=n).astype(np.int64)
    total = np.zeros(n, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        total[full] = np.add.reduceat(tk.mix(h ^ np.uint64(0x1234567)), (np.cumsum(size) - size)[full])
    return h, row, size, tk.mix(total ^ size.astype(np.uint64)).view(np.int64)


def _measure(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document, and each task's part of the sketch in SLICES rows (doc_id null, slice set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n", "sid", "slice", "counts"]
        for b in batches:
            data, offsets = common.utf8(b.column(1))
            for i, j in common.cuts(offsets, BLOCK):
                h, _, size, sid = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                place, count = np.unique((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                sketch[place] += count.astype(np.uint32)
                m = j - i
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, m), pa.array(size), pa.array(sid), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if sketch.any():
            parts = sketch.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return docs.mapInArrow(common.trimmed(run), SETS)


def _sketch(measured: DataFrame) -> np.ndarray:
    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in t.column("counts").to_pylist())
        return pa.table({"slice": t.column("slice")[:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    parts = measured.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint32)
    for p in parts:
        out[p["slice"]] = np.frombuffer(p["counts"], np.uint32)
    return out.reshape(-1)


def index_keys(h: np.ndarray, row: np.ndarray, size: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, their rows, places and whether hot, of a block's sets (h distinct, rows in order).

    A place counts shingles of the row that a partner cannot have, unless it shares an earlier rare one and so a key of
    that: all before a rare shingle, and the rare ones before a pair.
    """
    load = sketch.sum(dtype=np.uint64) / len(sketch)
    bar = load + 6 * np.sqrt(load) + 12
    high = load + 16 * (bar - load)  # from here on a key is salted
    count = sketch[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    often = count > bar
    order = np.lexsort((h, count, row))
    h, row, often, count = h[order], row[order], often[order], count[order]
    keys, rows, places, hots = [], [], [], []
    exponent = np.zeros(len(size), np.int64)
    exponent[size > 0] = np.floor(np.log2(size[size > 0])).astype(np.int64)
    exponent[(1 << exponent) > np.maximum(size, 1)] -= 1
    for more in (0, 1):  # a set's partners may be in the next class of sizes
        g = exponent + more
        mine = size > 0 if not more else (size > 0) & (den * size >= num * (1 << g))
        on = mine[row]
        t, r, of = h[on], row[on], often[on]
        if not len(t):
            continue
        cnt = count[on]
        first = np.searchsorted(r, np.arange(len(size)))
        pos = np.arange(len(r)) - first[r]
        cells = np.maximum(1, (1 << g) // PER_CELL)[r]
        single = ~of | (g[r] < LEAST_CELLS)
        cell = np.where(single, -1 - pos, (tk.mix(t ^ np.uint64(0x77)) >> np.uint64(33)).astype(np.int64) % cells)
        # rank among its cell's, in order
        by = np.lexsort((pos, cell, r))
        new = np.ones(len(by), bool)
        new[1:] = (r[by][1:] != r[by][:-1]) | (cell[by][1:] != cell[by][:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - start
        sure = (single | (rank > 0)).astype(np.int64)
        held = np.cumsum(sure)
        held -= (held - sure)[first[r]]  # guarantees up to here
        need = size - -(-num * size // den) + 1
        within = held - sure < need[r]
        alone = np.cumsum(single) - single
        alone -= alone[first[r]]  # rare shingles before this one
        salt = tk.mix(g.astype(np.uint64) * np.uint64(2) + np.uint64(1))[r]
        s = np.flatnonzero(within & single)
        keys.append(tk.mix(t[s] ^ salt[s]))
        rows.append(r[s])
        places.append(pos[s])
        hots.append(cnt[s] > high)
        deep = int(rank[within & ~single].max(initial=0))
        ok = within[by] & ~single[by]
        for back in range(1, deep + 1):  # pairs of a cell
            b = np.flatnonzero(ok & (rank[by] >= back))
            x, y = by[b - back], by[b]
            keys.append(tk.mix(tk.mix(t[x] ^ salt[x]) * np.uint64(tk.BASE) + t[y]))
            rows.append(r[y])
            places.append(alone[x])
            hots.append(np.minimum(cnt[x], cnt[y]) > high)
    if not keys:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z.astype(bool)
    return tuple(np.concatenate(x) for x in (keys, rows, places, hots))


def _index(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """key, sid, n, pos, salt: the index entries of all sets. salt is 0 but for keys of very frequent shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task indexes equal sets once
        for b in batches:
            data, offsets = common.utf8(b.column(1))
            for i, j in common.cuts(offsets, BLOCK):
                h, row, size, sid = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                new = np.array([x not in seen and not seen.add(x) for x in sid.tolist()], bool)
                h, row, size = h[new[row]], row[new[row]], np.where(new, size, 0)
                key, r, pos, hot = index_keys(h, row, size, shared.value, num, den)
                salt = np.where(hot, 1 + (sid[r].view(np.uint64) % np.uint64(SALTS)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sid[r]), pa.array(size[r].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(salt.astype(np.int32))], names=["key", "sid", "n", "pos", "salt"])

    return docs.mapInArrow(common.trimmed(run), "key long, sid long, n int, pos int, salt int")


def _may_link(a: str, b: str, num: int, den: int) -> F.Column:
    """Sizes fit, and what both can share besides the shingles before their places is enough."""
    na, nb, pa_, pb = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    least = F.ceil((na + nb) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))
    return (na * num <= nb * den) & (nb * num <= na * den) & (F.least(na - pa_, nb - pb) >= least)


def _of_sets(docs: DataFrame, sids: DataFrame, most: int, reps: DataFrame, k: int, make, what: str, column: str, held: list[str]) -> DataFrame:
    """sid, column: make(hashes) for the set of each sid, from one document that has it. most: rows of sids.

    Where an id occurs twice a sid may have several rows.
    """
    wanted = sids.distinct().join(reps, "sid").select("sid", "doc_id")
    texts = docs.join(F.broadcast(wanted) if most <= MOST_BROADCAST else wanted, "doc_id").select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = common.utf8(b.column(1))
            for i, j in common.cuts(offsets, BLOCK):
                h, row, _, sid = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                same = sid == b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)  # another text may have the id
                yield pa.RecordBatch.from_arrays([pa.array(sid[same]), pa.array([make(h[x:y]) for x, y, s in zip(ends[:-1], ends[1:], same, strict=True) if s], pa.binary())], names=["sid", column])

    return common.stored(texts.mapInArrow(common.trimmed(run), f"sid long, {column} binary"), what, held, 4 * most)


def _cells(h: np.ndarray) -> bytes:
    """How many hashes fall into each of CELLS cells; two sets share at most the sum of the smaller counts."""
    return np.minimum(np.bincount((h >> np.uint64(20)).astype(np.int64) % CELLS, minlength=CELLS), 65535).astype(np.uint16).tobytes()


def _counts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of cells."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, CELLS)


def _may_share(p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the counts of pairs of sets allow them to link; a count of 65535 may be more, and allows all."""
    least = np.minimum(p, q).sum(1, dtype=np.int64)
    most = np.maximum(p, q).sum(1, dtype=np.int64)
    return (den * least >= num * most) | (p.max(1) == 65535) | (q.max(1) == 65535)


def _with_values(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """a, b, and the values of both as x and y."""
    joined = pairs.join(values.select(F.col("sid").alias("a"), F.col(column).alias("x")), "a").join(values.select(F.col("sid").alias("b"), F.col(column).alias("y")), "b")
    return joined.select("a", "b", "x", "y")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))


def _allowed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int, held: list[str]) -> DataFrame:
    """The pairs (a, b) whose counts in cells allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1]).filter(pa.array(_may_share(_counts(b.column(2)), _counts(b.column(3)), num, den)))

    n = pairs.count()
    cells = _of_sets(docs, _both(pairs), 2 * n, reps, k, _cells, "cells", "cells", held)
    return common.stored(_with_values(pairs, cells, "cells").mapInArrow(common.trimmed(run), "a long, b long").distinct(), "near", held, n)


def _verified(near: DataFrame, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int, held: list[str]) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    def link(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(p, q, assume_unique=True))
        return den * both >= num * (len(p) + len(q) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1]).filter(pa.array([link(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_()))

    members = _of_sets(docs, _both(near), 2 * near.count(), reps, k, np.ndarray.tobytes, "sets", "members", held)
    return _with_values(near, members, "members").mapInArrow(common.trimmed(run), "a long, b long")


def undecided(t: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a < b, of the rows (key, sid, n, pos, root, top, salt, block, x, y, cells) of one group.

    They share a key, are in different components, were not held against each other as head and member, and their sizes,
    places and cells allow a link. In a group of two blocks x and y only pairs across them count.
    """
    t = t.sort_by("key")
    key, sid, n, pos, root, top, salt, block, bx, by = (common.one(t.column(c)).to_numpy() for c in ("key", "sid", "n", "pos", "root", "top", "salt", "block", "x", "y"))
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    cells = _counts(t.column("cells"))
    last = np.searchsorted(key, key, "right")
    partners = last - np.arange(len(key)) - 1  # each row with those after it in its key
    upto = np.cumsum(partners)
    found_a, found_b = [], []
    i = 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
        p = np.repeat(np.arange(i, j), partners[i:j])
        q = tk.flat_ranges(np.arange(i, j) + 1, partners[i:j])
        ok = root[p] != root[q]
        p, q = p[ok], q[ok]
        ok = ((sid[p] != top[q]) & (sid[q] != top[p]) | (salt[p] != salt[q])) & ((bx[p] == by[p]) | (block[p] != block[q]))
        least = -(-(n[p] + n[q]) * num // (num + den))
        ok &= (n[p] * num <= n[q] * den) & (n[q] * num <= n[p] * den) & (np.minimum(n[p] - pos[p], n[q] - pos[q]) >= least)
        p, q = p[ok], q[ok]
        if len(p):
            swap = sid[p] > sid[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            once = np.unique(tk.mix(sid[p].view(np.uint64)) * np.uint64(tk.BASE) + sid[q].view(np.uint64), return_index=True)[1]
            p, q = p[once], q[once]
            some = [_may_share(cells[p[x : x + 8192]], cells[q[x : x + 8192]], num, den) for x in range(0, len(p), 8192)]
            some = np.concatenate(some)
            found_a.append(sid[p[some]])
            found_b.append(sid[q[some]])
        i = j
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.column_stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=0)
    return both[:, 0], both[:, 1]


def _left_over(shared: DataFrame, size: int, found: DataFrame, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int, held: list[str]) -> DataFrame:
    """The pairs that heads left undecided and that counts in cells allow; found: node, root; size: rows of shared."""
    marked = shared.join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = marked.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("all > 2 and lo <> hi").select("key", "all")
    some = marked.join(mixed, "key").select("key", "sid", "n", "pos", "root", F.col("head.sid").alias("top"), "salt", F.ceil(F.col("all") / F.lit(KEY_ROWS)).cast("int").alias("blocks"))
    some = common.stored(some, "mixed", held, size)
    n = some.count()
    cells = _of_sets(docs, some.select("sid"), n, reps, k, _cells, "cells", "cells", held)
    # keys with the same head hold much the same sets, so they go to one worker, where a pair counts once
    parts = F.lit(max(1, n // GROUP_ROWS))
    dealt = some.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    dealt = dealt.withColumn("part", F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("top"), parts)))

    def run(t: pa.Table) -> pa.Table:
        a, b = undecided(t, num, den)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    rest = dealt.join(cells, "sid").select("key", "sid", "n", "pos", "root", "top", "salt", "block", "x", "y", "cells", "part", "blocks")
    rest = rest.groupBy("part", "x", "y", F.col("blocks") > 1).applyInArrow(run, "a long, b long").distinct()
    return common.stored(rest, "rest", held, n)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Links join texts whose sets of k-word shingles have a Jaccard similarity of num / den or more.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    held: list[str] = []
    src = common.plain(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    measured = common.stored(_measure(src, k), "measured")
    n = measured.count()
    rows = measured.where("slice is null").select("doc_id", "n", "sid")
    reps = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    reps = common.stored(reps, "sets", rows=n)

    # the index is dealt once, by key, which serves all that is asked of a key
    group = Window.partitionBy("key", "salt")
    entries = _index(src, k, num, den, _sketch(measured)).repartition("key", "salt").groupBy("key", "salt", "sid", "n").agg(F.max("pos").alias("pos"))
    entries = entries.withColumn("head", F.min(F.struct("pos", "sid", "n")).over(group)).withColumn("m", F.count(F.lit(1)).over(group))
    shared = common.stored(entries.where("m > 1 or salt > 0").drop("m"), "shared", held, 100 * n)  # keys of one set lead nowhere
    size = shared.count()
    star = shared.select(F.col("head.sid").alias("a"), F.col("sid").alias("b"), F.struct("n", "pos").alias("x"), "head")
    star = star.where("a <> b").where(_may_link("x", "head", num, den)).select("a", "b")
    heads = shared.where("salt > 0").groupBy("key", "salt").agg(F.min(F.struct("pos", "sid", "n")).alias("x"))
    heads = heads.withColumn("head", F.min("x").over(Window.partitionBy("key")))  # at most SALTS rows a key
    across = heads.where("x.sid <> head.sid").where(_may_link("x", "head", num, den)).select(F.col("head.sid").alias("a"), F.col("x.sid").alias("b"))
    pairs = star.union(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = _allowed(common.stored(pairs, "pairs", held, size), src, reps, k, num, den, held)
    found = graph.components(_verified(near, src, reps, k, num, den, held), near.count())

    rest = _left_over(shared, size, found, src, reps, k, num, den, held)
    if not rest.isEmpty():
        more = _verified(rest, src, reps, k, num, den, held)
        of = found.withColumnRenamed("root", "r")
        more = more.join(of.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("r", "a").alias("a"), "b")
        more = more.join(of.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("r", "b").alias("b")).distinct()
        more = graph.components(more, rest.count())
        of = found.join(more.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
        found = of.union(more).distinct()
    common.discard(spark, held)

    # sets that are linked, or that several documents have; all others are their document's own
    of = reps.join(found.withColumnRenamed("node", "sid"), "sid", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "sid"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = of.join(least, "root").select("sid", "component_id")
    out = rows.withColumn("sid", F.when(F.col("n") > 0, F.col("sid")))
    out = out.join(known, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return common.compact(out, n)
