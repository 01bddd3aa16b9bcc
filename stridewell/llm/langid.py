"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's script is that of its first letter; only languages that write at least SHARE of their words in it stay
candidates (all of them, if none does). A candidate's score for a word is the log odds of the word and of its byte
trigrams, learned by counting. Viterbi finds the best sequence of languages, where each change costs SWITCH, so a text
of several languages falls into spans. The text's language is that of most letters; its score is their share.

Learning takes at most `sample` texts a language (a documented bound, 2048); labelling takes every whole text.
Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, learning, textkernel as tk

SAMPLE, WORD_BITS, TRI_BITS = 2048, 16, 16
#: Cost of a change of language, largest log odds of a word, a script's least share, what no candidate scores.
SWITCH, CLIP, SHARE, NEVER = 8.0, 10.0, 0.02, -60.0
BLOCK, BATCH = 1 << 19, 1 << 24

#: First and last code point of scripts.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F),
    ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF),
    ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Ethiopic", 0x1200, 0x137F),
    ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x2FA1F), ("Hangul", 0xAC00, 0xD7AF), ("Hangul", 0x1100, 0x11FF),
)
NAMES = sorted({s for s, _, _ in SCRIPTS})
OTHER = len(NAMES)

_tables: list[np.ndarray] = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its script."""
    if not _tables:
        script = np.full(0x110000, OTHER, np.int8)
        for name, a, b in SCRIPTS:
            script[a : b + 1] = NAMES.index(name)
        _tables[:] = np.fromiter((not 0xD800 <= c <= 0xDFFF and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000), script
    return _tables[0], _tables[1]


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A flag at the first byte of each letter, and the code point at such bytes (0 elsewhere)."""
    alpha, _ = letter_tables()
    point = np.where(data < 128, data, 0).astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
        at = np.flatnonzero((data >= low) & (data < high))
        p = padded[at] & (0x3F >> more)
        for k in range(1, more + 1):
            p = (p << 6) | (padded[at + k] & 0x3F)
        point[at] = np.minimum(p, 0x10FFFF)
    return alpha[point], point


class Block:
    """The words with a letter in a block: rows, ordinals in the row, letters, scripts, places of words and trigrams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = tk.Words(data, offsets)
        flag, point = letters(data)
        have = np.concatenate([[0], np.cumsum(flag)])
        count = have[w.end] - have[w.start]
        on = np.flatnonzero(count)
        at = np.flatnonzero(flag)
        self.row, self.letters = w.row[on], count[on]
        self.ordinal = on - w.first[self.row]
        self.script = letter_tables()[1][point[at[have[w.start[on]]]]] if len(on) else np.zeros(0, np.int8)
        self.word = (w.hash[on] >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        size = w.end[on] - w.start[on]
        self.ends = np.cumsum(size)
        pos = tk.flat_ranges(w.start[on], size)
        cur = w.lower[pos].astype(np.uint32)
        prev, nxt = np.empty_like(cur), np.empty_like(cur)
        prev[1:], nxt[:-1] = cur[:-1], cur[1:]
        if len(cur):
            prev[self.ends - size] = 32
            nxt[self.ends - 1] = 32
        key = (prev << np.uint32(16)) | (cur << np.uint32(8)) | nxt
        self.tri = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRI_BITS)).astype(np.int32)
        self.tri_word = np.repeat(np.arange(len(on)), size)

    def scores(self, model: dict[str, np.ndarray]) -> np.ndarray:
        """Of each word for each language."""
        n = len(model["langs"])
        if not len(self.row):
            return np.zeros((0, n), np.float32)
        first = np.concatenate([[0], self.ends[:-1]])
        tri = np.stack([np.add.reduceat(model["tri"][i][self.tri], first) for i in range(n)], 1)
        got = np.clip(model["word"][:, self.word].T + 0.5 * tri, -CLIP, CLIP)
        return np.where(model["scripts"][self.script], got, NEVER).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray) -> list[dict[str, np.ndarray]]:
    out = []
    for i, j in common.cuts(offsets, BLOCK):
        b = Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for r in range(j - i):
            a, z = np.searchsorted(b.row, [r, r + 1])
            x, y = np.searchsorted(b.tri_word, [a, z])
            got = [np.unique(v, return_counts=True) for v in (b.word[a:z], b.tri[x:y], b.script[a:z])]
            out.append({f"{k}{t}": v.astype(np.int32) for k, pair in zip("wts", got, strict=True) for t, v in zip("ic", pair, strict=True)})
    return out


def train(examples: list[dict[str, np.ndarray]], labels: np.ndarray) -> dict[str, np.ndarray]:
    langs = sorted(set(labels.tolist()))
    counts = {"w": np.zeros((len(langs), 1 << WORD_BITS)), "t": np.zeros((len(langs), 1 << TRI_BITS)), "s": np.zeros((len(langs), OTHER + 1))}
    for e, y in zip(examples, labels.tolist(), strict=True):
        for k, table in counts.items():
            table[langs.index(y), e[f"{k}i"]] += e[f"{k}c"]

    def odds(c: np.ndarray) -> np.ndarray:
        p = np.log((c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * c.shape[1]))
        return (p - p.mean(0)).astype(np.float32)

    share = counts["s"] / np.maximum(1, counts["s"].sum(1, keepdims=True)) >= SHARE
    scripts = share.T.copy()
    scripts[~scripts.any(1)] = True
    return {"langs": np.array(langs), "word": odds(counts["w"]), "tri": odds(counts["t"]), "scripts": scripts}


def viterbi(score: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The best language of each word; rows are stepped through together, longest first."""
    size = np.bincount(row, minlength=n)
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    live = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")  # rows that have a word t
    best = np.zeros((n, score.shape[1]), np.float32)
    back = np.zeros(score.shape, np.uint8 if score.shape[1] < 256 else np.uint16)
    own = np.arange(score.shape[1])
    for t, m in enumerate(live.tolist()):
        v, at = best[:m], start[:m] + t
        top = v.argmax(1)
        move = v[np.arange(m), top][:, None] - np.float32(SWITCH)
        go = move > v
        back[at] = np.where(go, top[:, None], own)
        best[:m] = np.where(go, move, v) + score[at]
    path = np.zeros(len(row), np.int64)
    state = best.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = start[:m] + t
        path[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return path


SPAN = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("lang", pa.string())]))
SPAN_SQL = "array<struct<first_word:bigint,last_word:bigint,lang:string>>"


def label(data: np.ndarray, offsets: np.ndarray, model: dict[str, np.ndarray]) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Language, score and spans of each row."""
    n, names = len(offsets) - 1, [str(x) for x in model["langs"]]
    blocks, scores, shift = [], [], []
    for i, j in common.cuts(offsets, BLOCK):
        b = Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        scores.append(b.scores(model))
        blocks.append((b.row + i, b.ordinal, b.letters))
    row, ordinal, count = (np.concatenate(x) for x in zip(*blocks, strict=True)) if blocks else [np.zeros(0, np.int64)] * 3
    if not len(row) or not names:
        return pa.array(["und"] * n, pa.string()), np.zeros(n), pa.array([[]] * n, SPAN)
    path = viterbi(np.concatenate(scores), row, n)
    mass = np.bincount(row * len(names) + path, count, minlength=n * len(names)).reshape(n, len(names))
    total = mass.sum(1)
    lang = np.where(total > 0, mass.argmax(1), len(names))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (path[1:] != path[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    words = pa.array(names + ["und"])
    items = pa.StructArray.from_arrays([pa.array(ordinal[first]), pa.array(ordinal[last]), words.take(pa.array(path[first]))], names=["first_word", "last_word", "lang"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(n + 1)), pa.int32()), items).cast(SPAN)
    return words.take(pa.array(lang)), np.divide(mass.max(1), total, out=np.zeros(n), where=total > 0), spans


def language_model(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """docs: doc_id, text, lang. Learns from at most `sample` texts a language, those with the smallest hashed ids.

    Ids are first thinned to those that can be among them, by each language's number of ids, so that a language's task
    gets about twice the sample. Of an id that a language has several texts of, the last in order counts.
    """
    ids = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    share = ids.groupBy("lang").agg((F.lit(2.0 * sample + 200) / F.approx_count_distinct("doc_id")).alias("_share"))  # a row a language
    ids = ids.withColumn("_h", F.xxhash64("doc_id")).join(F.broadcast(share), "lang")
    ids = ids.where((F.col("_h") / F.lit(2.0**64) + 0.5) <= F.col("_share")).select("lang", "doc_id", "_h").distinct()
    first = ids.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_k") <= sample)
    # at most `sample` ids a language, which bounds the broadcast
    chosen = docs.select("doc_id", "lang", "text").join(F.broadcast(first.select("doc_id", "lang", "_h")), ["doc_id", "lang"])
    chosen = chosen.groupBy("doc_id", "lang", "_h").agg(F.max("text").alias("text"))
    return learning.train_once(chosen.select("doc_id", "_h", "text", F.col("lang").alias("label")), features, train, pa.string())


def languages(docs: DataFrame, model: dict[str, np.ndarray] | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (first and last word, counted from 0, of each run of a language). No shuffle."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model or {"langs": np.zeros(0, str)})  # tables of a fixed size a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.gathered(batches, BATCH):
            lang, score, spans = label(*common.utf8(common.one(t.column("text"))), shared.value) if len(shared.value["langs"]) else (pa.array(["und"] * t.num_rows), np.zeros(t.num_rows), pa.array([[]] * t.num_rows, SPAN))
            yield pa.RecordBatch.from_arrays([common.one(t.column("doc_id")), lang, pa.array(score, pa.float64()), spans], names=["doc_id", "lang_pred", "score", "spans"])

    src = common.plain(docs, doc_id=doc_id, text=text)
    return src.mapInArrow(common.trimmed(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans {SPAN_SQL}")
