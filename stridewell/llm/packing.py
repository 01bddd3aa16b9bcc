"""Packing: order-preserving dynamic programming over window cuts.

Texts are tokenized and laid end to end in order of id. A window (sequence) ends at the end of a text or of a
sentence, or, where these are further apart than a window, inside a sentence. A window costs its padding (none if its
length is a power of two), a fixed amount, and a penalty where it cuts a text or a sentence. The cheapest cuts are
found in one pass: the best start of a window that ends here is the front of a monotone queue.

Ids are dealt by ranges of doc_id of about BUCKET_BYTES bytes of text; a range is packed by itself, so that the last
window of a range may be short. sequence_id is the range's number times 2**32 plus the window's number in it.

Words are tokenized once a batch: the tokenizer splits at white space, so a text's ids are those of its words in turn.

Defined results: a null text counts as empty and has only the end id; rows with equal ids are ordered by their ids of
tokens; null ids come last.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common, textkernel as tk

LENGTH, END_ID = 4096, 2
#: Fixed values, in tokens: cost of a window, of a cut inside a text, of a cut inside a sentence.
EACH, IN_TEXT, IN_SENTENCE = 8, 4, 256
LEAST_POWER = 0
BUCKET_BYTES, BLOCK, MOST_KEPT = 6_000_000, 8 << 20, 300_000
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True


def _known_sizes() -> np.ndarray:
    """Bytes that a word may have to be encoded with others: their number must not change when a word is normalised.

    These are visible ASCII and, with the lead byte 0xC3, the letters from U+00C0 to U+00FF."""
    ok = np.zeros(256, bool)
    ok[0x21:0x7F] = True
    ok[0x80:0xC0] = True  # what follows a lead byte
    ok[0xC3] = True
    return ok


PLAIN = _known_sizes()


class WordIds:
    """A tokenizer's ids for words.

    Plain words are encoded many at once, as a text with spaces between; as the tokenizer drops spaces and keeps all
    other bytes, the bytes of the ids tell where each word ends. Where they do not, and for other words, each is
    encoded by itself. Ids are kept from batch to batch for at most `most` words.
    """

    def __init__(self, spec: str, most: int = 0):
        self.most = most or MOST_KEPT
        t = Tokenizer.from_str(spec)
        self.encode = t.encode_batch_fast
        vocab = t.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix("</w>"))
        self.words = pa.array([], pa.large_string())
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for k in range(0, len(words), 4096) for e in self.encode(words[k : k + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return size, np.fromiter((i for g in got for i in g), np.uint32, int(size.sum()))

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = common.utf8(words)
        text = words.to_pylist()
        ids = np.array(self.encode([" ".join(text)], add_special_tokens=False)[0].ids, np.uint32)
        bare = np.concatenate([[0], np.cumsum(~tk.IS_SPACE[data])])
        ends = np.cumsum(bare[offsets[1:]] - bare[offsets[:-1]])
        sums = np.cumsum(self.width[ids])
        last = np.searchsorted(sums, ends)
        if not len(sums) or last[-1] >= len(sums) or (sums[last] != ends).any() or sums[-1] != ends[-1]:
            return self._each(text)
        return np.diff(last, prepend=-1), ids

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words with the white space after them."""
        data, offsets = common.utf8(words)
        odd = np.concatenate([[0], np.cumsum(~(PLAIN[data] | tk.IS_SPACE[data]))])
        mark = np.zeros(len(data) + 1, np.int64)
        mark[1:-1] = np.cumsum((data[:-1] == 60) & (data[1:] == 124))  # <| may begin a special token
        odd = (odd[offsets[1:]] > odd[offsets[:-1]]) | (mark[np.maximum(offsets[1:] - 1, 0)] > mark[offsets[:-1]])
        size = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        for k in range(0, len(plain), 16_384):
            at = plain[k : k + 16_384]
            size[at], ids = self._together(words.take(pa.array(at)))
            parts.append((at, ids))
        if len(rest):
            size[rest], ids = self._each(words.take(pa.array(rest)).to_pylist())
            parts.append((rest, ids))
        first = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        for at, ids in parts:
            out[tk.flat_ranges(first[at], size[at])] = ids
        return size, out

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of each word's ids, and the ids in which they are."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        if len(self.words) + len(new) > self.most:  # only what came again stays
            again = np.unique(at.drop_null().to_numpy())
            self.ids = self.ids[tk.flat_ranges(self.first[again], self.size[again])]
            self.words, self.size = self.words.take(pa.array(again)), self.size[again]
            self.first = np.cumsum(self.size) - self.size
            at = pc.index_in(words, value_set=self.words)
        if len(new):
            size, ids = self._encoded(new)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
            self.words = pa.concat_arrays([self.words, new])
        missing = at.is_null().to_numpy(zero_copy_only=False)
        place = np.where(missing, len(self.words) - len(new) + np.cumsum(missing) - 1, at.fill_null(0).to_numpy(zero_copy_only=False))
        return self.first[place], self.size[place], self.ids


_kept: dict[tuple[str, int], WordIds] = {}


def word_ids(spec: str, most: int = 0) -> WordIds:
    """One for each tokenizer and worker, so that tasks share what is kept."""
    if (spec, most) not in _kept:
        _kept.clear()
        _kept[spec, most] = WordIds(spec, most)
    return _kept[spec, most]


def token_rows(data: np.ndarray, offsets: np.ndarray, words: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids with the end id after each row, the rows' offsets in them, and the positions after sentences."""
    n = len(offsets) - 1
    start, end, row = tk.word_spans(data, offsets)
    if not len(start):
        return np.full(n, end_id, np.uint32), np.arange(n + 1), np.zeros(0, np.int64)
    # a word with the white space after it, which the tokenizer drops, so that words lie end to end
    bounds = np.append(start, len(data)) - start[0]
    text = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[start[0] :])))
    coded = text.dictionary_encode()
    first, size, ids = words.of(coded.dictionary)
    code = coded.indices.to_numpy()
    each = size[code]
    per_row = np.bincount(row, each, minlength=n).astype(np.int64) + 1
    offs = np.concatenate([[0], np.cumsum(per_row)])
    after = np.cumsum(each) + row  # position after each word among all ids; one end id for each row before
    out = np.full(offs[-1], end_id, np.uint32)
    step = np.ones(int(each.sum()), np.int32)  # from one word's ids to the next one's
    some = np.flatnonzero(each)
    head = first[code[some]]
    at = np.cumsum(each[some]) - each[some]
    step[at[1:]] = head[1:] - (head[:-1] + each[some][:-1] - 1)
    if len(step):
        step[0] = head[0]
    inside = np.ones(len(out), bool)
    inside[offs[1:] - 1] = False
    out[inside] = ids[np.cumsum(step)]
    return out, offs, after[STOPS[data[end - 1]]]


def windows(total: int, text_ends: np.ndarray, sentence_ends: np.ndarray, length: int) -> list[int]:
    """Ends of the windows that cost least; text_ends are increasing, and the last is total."""
    if not total:
        return []
    kind = np.zeros(total + 1, np.uint8)
    kind[sentence_ends[(sentence_ends > 0) & (sentence_ends < total)]] = 1
    kind[text_ends] = 3
    kind[[0, total]] = 3
    at = np.flatnonzero(kind)
    for i in np.flatnonzero(np.diff(at) > length).tolist():
        kind[np.arange(at[i] + length, at[i + 1], length)] = 2
    at = np.flatnonzero(kind)
    cost = np.array([0, IN_TEXT + EACH, IN_SENTENCE + EACH, EACH], float)[kind[at]]
    ends_at, starts_at = [], []
    number = np.cumsum(kind > 0, dtype=np.int32) - 1
    for k in range(LEAST_POWER, length.bit_length()):
        j = np.flatnonzero(at >= 1 << k)
        j = j[kind[at[j] - (1 << k)] > 0]
        ends_at.append(j)
        starts_at.append(number[at[j] - (1 << k)])
    ends_of = np.concatenate(ends_at)
    exact = np.concatenate(starts_at)[np.argsort(ends_of, kind="stable")].tolist()  # starts of unpadded windows
    upto = np.cumsum(np.bincount(ends_of, minlength=len(at))).tolist()  # how many of them up to each cut
    pos, costs = at.tolist(), cost.tolist()
    best, came = [0.0] * len(pos), [0] * len(pos)
    key = [0.0] * len(pos)  # best cost up to a cut, plus its position: the padding's part that the start decides
    queue = deque([0])
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        c = key[i] + length - p
        for e in exact[upto[j - 1] : upto[j]]:
            if best[e] < c:
                c, i = best[e], e
        best[j], came[j] = c + costs[j], i
        k = key[j] = best[j] + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    ends, j = [], len(pos) - 1
    while j:
        ends.append(pos[j])
        j = came[j]
    return ends[::-1]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(t: pa.Table, length: int, kind: type, keep_ids: bool) -> pa.Table:
    """One range's pieces."""
    if not t.num_rows:
        return SCHEMA.empty_table()
    doc, raw, breaks = (t.column(c).to_pylist() for c in ("doc_id", "ids", "breaks"))
    order = sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i] or 0, raw[i]))
    ids = [np.frombuffer(raw[i], kind) for i in order]
    size = np.array([len(x) for x in ids], np.int64)
    ends = np.cumsum(size)
    begin = ends - size
    stream = np.concatenate(ids).astype("<u4")
    sentences = np.concatenate([np.frombuffer(breaks[i], np.uint32).astype(np.int64) + b for i, b in zip(order, begin.tolist(), strict=True)])
    stops = np.array(windows(int(ends[-1]), ends, sentences, length), np.int64)
    cut = np.union1d(np.union1d(stops, ends), [0])
    a, z = cut[:-1], cut[1:]
    of, seq = np.searchsorted(ends, a, "right"), np.searchsorted(stops, a, "right")
    opened = np.concatenate([[0], stops])[seq]
    pieces = [stream[i:j].tobytes() for i, j in zip(a.tolist(), z.tolist(), strict=True)]
    names = [doc[order[i]] for i in of.tolist()]
    high = t.column("bucket")[0].as_py() << 32
    return pa.Table.from_batches([common.rows(SCHEMA, doc_id=names, start=a - begin[of], length=z - a, ids_crc32=[zlib.crc32(p) for p in pieces], doc_tokens=size[of], sequence_id=seq + high, offset=a - opened, ids=pieces if keep_ids else [None] * len(pieces))])


def pack_documents(docs: DataFrame, spec: str, end_id: int = END_ID, length: int = LENGTH, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, most_kept: int = MOST_KEPT) -> DataFrame:
    """The pieces of all texts (columns of SCHEMA; ids: little-endian 32-bit, if kept).

    spec: a tokenizer's JSON, one that splits at white space and drops it. block: bytes of text that a worker tokenizes
    at once, most_kept: words whose ids it keeps; more take less time and more memory, and the pieces are the same.
    With fewer than MOST_KEPT a worker also gives its tokenizer back once tokenizing is over.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    src = common.plain(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    n, size = common.input_bytes(src)
    bounds = np.array(common.id_bounds(src, max(1, min(n, 1 + size // BUCKET_BYTES))) or [0], np.int64)
    shared = spark.sparkContext.broadcast(spec)  # one tokenizer file
    kind = np.uint16 if max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(shared.value, most_kept)
        for t in common.gathered(batches, block):
            b = t.to_batches()[0]
            data, offsets = common.utf8(b.column(1))
            for i, j in common.cuts(offsets, block):
                ids, offs, breaks = token_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words, end_id)
                flat = ids.astype(kind)
                first = np.searchsorted(breaks, offs, "right")  # a break at a row's start is none
                keys = b.column(0).slice(i, j - i)
                known = np.array([bounds[-1] if v is None else v for v in keys.to_pylist()], np.int64)
                bucket = np.minimum(np.searchsorted(bounds, known, "left"), len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array(bucket, pa.int32()),
                    pa.array([flat[x:y].tobytes() for x, y in zip(offs[:-1], offs[1:], strict=True)], pa.binary()),
                    pa.array([(breaks[x:y] - o).astype(np.uint32).tobytes() for x, y, o in zip(first[:-1], first[1:], offs[:-1], strict=True)], pa.binary()),
                ], names=["doc_id", "bucket", "ids", "breaks"])

    made = src.mapInArrow(common.trimmed(tokens), "doc_id long, bucket int, ids binary, breaks binary")

    def packed(t: pa.Table) -> pa.Table:
        if most_kept < MOST_KEPT:
            _kept.clear()
        return pack(t, length, kind, keep_ids)

    return made.groupBy("bucket").applyInArrow(packed, SQL)
