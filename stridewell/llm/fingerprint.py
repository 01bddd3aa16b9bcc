"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash of eight bytes decides where a text is cut: at block size 2**k a cut follows each byte whose rolling
hash ends in k zero bits. Each piece gives one of 64 characters. A fingerprint is ``k:signature:signature`` for the
smallest block size whose signature has at most 64 characters, and for the next size. Cuts depend on nearby bytes
only, so texts with common passages have common runs of characters. Two fingerprints are compared by edit distance
where they share a block size.

Defined results: a null text counts as empty; the empty text has the fingerprint ``0::``; equal texts have equal
fingerprints; two fingerprints with no block size in common, or no run of RUN characters in common, have likeness 0.
Rows with equal ids are ordered by text; null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkernel as tk

WINDOW, MOST, RUN = 8, 64, 3
#: The 64 characters of a signature.
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
CODE = np.zeros(256, np.int64)
CODE[LETTERS] = np.arange(64)
BLOCK = 1 << 20
#: Characters of text in a bucket of neighbouring ids.
BUCKET_BYTES = 4_000_000


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a mixed 32-bit hash of it and the seven before it (fewer at the start)."""
    m, h = 0x2C1B3C6D, data.astype(np.uint32)
    h += np.uint32(1)
    for shift in (1, 2, 4):  # each step doubles the window
        more = h * np.uint32(pow(m, shift, 2**32))
        more[shift:] += h[:-shift] if shift else h
        h = more
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def _signatures(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = [""] * n
    r = rolling(data) if len(data) else np.zeros(0, np.uint32)
    at = np.arange(len(data))
    row = np.repeat(np.arange(n), size)
    full = at - offsets[row] >= WINDOW - 1  # the window lies in the row
    last = np.zeros(len(data), bool)
    last[offsets[1:][size > 0] - 1] = True
    at = at[full & ~last]
    level = np.full(n, -1)
    parts: dict[int, list[str]] = {i: [] for i in range(n)}
    k = 0
    while True:
        count = np.bincount(np.searchsorted(offsets, at, "right") - 1, minlength=n) if len(at) else np.zeros(n, np.int64)
        level[(level < 0) & (count < MOST)] = k
        now = np.flatnonzero(((level == k) | (level == k - 1)) & (level >= 0) & (size > 0))
        if len(now):
            mine = np.zeros(n, bool)
            mine[now] = True
            cut = at[mine[np.searchsorted(offsets, at, "right") - 1]] + 1 if len(at) else at
            starts = np.sort(np.concatenate([cut, offsets[now]]))
            ends = np.sort(np.concatenate([cut, offsets[now + 1]]))
            chars = LETTERS[(tk.span_hashes(data, starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
            first = np.searchsorted(starts, offsets[now], "left")
            stop = np.append(first[1:], len(starts))
            for i, a, b in zip(now.tolist(), first.tolist(), stop.tolist(), strict=True):
                parts[i].append(chars[a:b])
        if (level >= 0).all() and (level < k).all():
            break
        at = at[(r[at] >> np.uint32(min(k, 31))) & np.uint32(1) == 0] if k < 32 else at[:0]
        k += 1
    for i in range(n):
        out[i] = f"{level[i]}:{':'.join(parts[i])}" if size[i] else "0::"
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Of each row's bytes."""
    out: list[str] = []
    for i, j in common.cuts(offsets, BLOCK):
        out += _signatures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return out


def _codes(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in signatures], np.int64)
    codes = np.zeros((len(signatures), MOST), np.int64)
    flat = CODE[np.frombuffer("".join(signatures).encode(), np.uint8)]
    codes[np.repeat(np.arange(len(size)), size), tk.flat_ranges(np.zeros(len(size), np.int64), size)] = flat
    return codes, size


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of signatures, all pairs at once (a bit for each character of a)."""
    x, m = _codes(a)
    y, n = _codes(b)
    peq = np.zeros((len(a), 64), np.uint64)
    for i in range(int(m.max(initial=0))):
        rows = np.flatnonzero(m > i)
        peq[rows, x[rows, i]] |= np.uint64(1 << i)
    one, every = np.uint64(1), np.arange(len(a))
    pv, mv, score = np.full(len(a), tk.MASK, np.uint64), np.zeros(len(a), np.uint64), m.copy()
    top = np.maximum(m - 1, 0).astype(np.uint64)
    for j in range(int(n.max(initial=0))):
        eq = peq[every, y[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        live = j < n
        score += np.where(live, ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64), 0)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = np.where(live, mh | ~(xv | ph), pv), np.where(live, ph & xv, mv)
    return np.where(m == 0, n, score)


def _common_run(a: list[str], b: list[str]) -> np.ndarray:
    def runs(s: str) -> set[str]:
        return {s[i : i + RUN] for i in range(len(s) - RUN + 1)}

    return np.array([min(len(x), len(y)) < RUN or not runs(x).isdisjoint(runs(y)) for x, y in zip(a, b, strict=True)], bool)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: 1 - distance / longer length, the best over the block sizes they share."""
    best = np.zeros(len(a))
    one, two = [x.split(":") for x in a], [y.split(":") for y in b]
    for p in (1, 2):
        for q in (1, 2):
            at = [i for i, (x, y) in enumerate(zip(one, two, strict=True)) if int(x[0]) + p == int(y[0]) + q and len(x) > p and len(y) > q and (x[p] or y[q])]
            if at:
                s, t = [one[i][p] for i in at], [two[i][q] for i in at]
                longest = np.array([max(len(u), len(v)) for u, v in zip(s, t, strict=True)])
                got = np.where(_common_run(s, t), 1 - edit_distances(s, t) / longest, 0)
                best[at] = np.maximum(best[at], got)
    best[[i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x == y]] = 1.0
    return best


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, fingerprint: of every whole text. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fingerprints(*common.utf8(b.column(1))), pa.string())], names=["doc_id", "text", "fingerprint"])

    common.small_batches(docs.sparkSession)
    return common.plain(docs, doc_id=doc_id, text=text).mapInArrow(common.trimmed(run), "doc_id long, text string, fingerprint string")


def _edited(t: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    """A bucket's own rows in descending order, each against the one after it; ahead rows close the bucket."""
    ids, texts, prints, ahead = (t.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "ahead"))
    order = sorted(range(len(ids)), key=lambda i: (ahead[i], ids[i] is None, -(ids[i] or 0), texts[i] is not None, texts[i] or ""))
    own = [i for i in order if not ahead[i]]
    for k in range(0, len(own), 512):
        part = own[k : k + 512]
        at = {i: order[(k + n + 1) % len(order)] for n, i in enumerate(part)}  # without ids the last row has the first after it
        edited, n_chars = [], []
        for i in part:
            s, nxt = texts[i] or "", texts[at[i]] or ""
            half = len(s) // 2
            n_chars.append(len(s))
            edited.append(s[: len(s) - half] + nxt[:half])
        raw = pa.array(edited, pa.large_string())
        changed = fingerprints(*common.utf8(raw))
        mine = [prints[i] for i in part]
        yield common.rows(SCHEMA, doc_id=[ids[i] for i in part], n_chars=n_chars, edited_sha256=[hashlib.sha256(s.encode()).hexdigest() for s in edited], fingerprint=mine, edited_fingerprint=changed, near_edited=likeness(mine, changed), near_next=likeness(mine, [prints[at[i]] for i in part]))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are (columns of SCHEMA).

    Texts are dealt once, by ranges of ids whose ends are ids that occur; the row at the end of a range is sent to the
    next range too, where it follows the last row. A range holds about BUCKET_BYTES bytes of text.
    """
    src = common.plain(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    n, size = common.input_bytes(src)
    buckets = max(1, min(n, 1 + size // BUCKET_BYTES))
    bounds = common.id_bounds(src, buckets) or [0]
    ends = np.array(bounds, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(i) for i in range(3)], names=["doc_id", "text", "fingerprint"])
            ids = np.array([ends[0] if v is None else v for v in b.column(0).to_pylist()], np.int64)
            bucket = np.minimum(np.searchsorted(ends, ids, "left"), len(ends) - 1)
            nulls = np.array(b.column(0).is_null().to_pylist(), bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket, pa.int32()), pa.array(np.zeros(len(ids), bool))], names=[*b.schema.names, "bucket", "ahead"])
            head = np.flatnonzero((ends[bucket] == ids) & ~nulls)
            if len(head):
                some = b.take(pa.array(head))
                to = (bucket[head] + 1) % len(ends)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(to, pa.int32()), pa.array(np.ones(len(head), bool))], names=[*b.schema.names, "bucket", "ahead"])

    def close(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_edited(t, bounds)), schema=SCHEMA)

    dealt = fingerprint_documents(src).mapInArrow(common.trimmed(deal), "doc_id long, text string, fingerprint string, bucket int, ahead boolean")
    return dealt.groupBy("bucket").applyInArrow(close, SQL)
