"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words, pairs of words, and the same for word shapes (letters, digits and repeats folded,
other characters kept), each hashed into 2**BITS places. A place weighs the square root of its count, and a text's
weights have length 1. Training is FTRL-proximal, one text after another, with L1 and L2 terms; a score is the sigmoid
of a sparse dot product.

Training takes at most `sample` labelled texts (a documented bound, 8192); scoring takes every whole text. Defined
results: a text without words (or null) scores the bias alone; without any labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, learning, textkernel as tk

BITS, SAMPLE, ROUNDS = 18, 8192, 3
#: A small sample is gone through more often, up to MOST_ROUNDS times, for about UPDATES steps in all.
UPDATES, MOST_ROUNDS = 12_000, 30
#: FTRL's learning rate, its smoothing, and the L1 and L2 terms.
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.005
BLOCK = 1 << 19

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48
SHAPE[128:] = 97


def _shape_hashes(data: np.ndarray, w: tk.Words) -> np.ndarray:
    """Hashes of the words with each run of the same shape folded to one character."""
    s = SHAPE[data]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[w.start] = True
    term = np.where(new, (s.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    place = np.cumsum(new) - 1  # position among kept characters
    first = place[w.start]
    word = np.repeat(np.arange(len(w.start)), w.end - w.start)
    at = tk.flat_ranges(w.start, w.end - w.start)
    order = np.minimum(place[at] - first[word], 63).astype(np.uint64)
    total = np.add.reduceat(np.where(new[at], tk.mix(term[at] + order), np.uint64(0)), np.cumsum(w.end - w.start) - (w.end - w.start)) if len(at) else np.zeros(0, np.uint64)
    return tk.mix(total)


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, rows (in order) and weights of a block's features."""
    w = tk.Words(data, offsets)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    shape = _shape_hashes(data, w)
    same = np.zeros(len(w.start), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    parts, at = [], []
    for salt, h in ((1, w.hash), (2, shape)):
        h = h ^ np.where(same, np.uint64(0x5555), np.uint64(0)) if salt == 2 else h
        pair = w.row[1:] == w.row[:-1]
        parts += [tk.mix(h + np.uint64(salt)), tk.mix(h[:-1][pair] * np.uint64(tk.BASE) + h[1:][pair] + np.uint64(salt + 2))]
        at += [w.row, w.row[1:][pair]]
    place = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.concatenate(at) * (1 << BITS) + place
    key, count = np.unique(key, return_counts=True)
    row = key >> BITS
    weight = np.sqrt(count)
    norm = np.sqrt(np.bincount(row, count, minlength=len(offsets) - 1))
    return key & ((1 << BITS) - 1), row, weight / norm[row]


def features(data: np.ndarray, offsets: np.ndarray) -> list[dict[str, np.ndarray]]:
    out = []
    for i, j in common.cuts(offsets, BLOCK):
        place, row, weight = hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ends = np.searchsorted(row, np.arange(j - i + 1))
        out += [{"i": place[a:b].astype(np.int32), "x": weight[a:b].astype(np.float32)} for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def train(examples: list[dict[str, np.ndarray]], labels: np.ndarray) -> dict[str, np.ndarray]:
    """FTRL-proximal; place 2**BITS is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rows = [(np.append(e["i"], 1 << BITS), np.append(e["x"], 1.0).astype(np.float64)) for e in examples]

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(max(ROUNDS, min(MOST_ROUNDS, UPDATES // max(1, len(rows))))):
        for (i, x), y in zip(rows, labels.tolist(), strict=True):
            w = weights(i)
            g = (learning.sigmoid(w @ x) - y) * x
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g2
    return {"w": weights(np.arange((1 << BITS) + 1)).astype(np.float32)}


def score_texts(data: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.full(len(offsets) - 1, float(w[-1]))
    for i, j in common.cuts(offsets, BLOCK):
        place, row, weight = hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out[i:j] += np.bincount(row, weight * w[place], minlength=j - i)
    return learning.sigmoid(out)


def quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights. docs: doc_id, text; labels: doc_id, label (1: good)."""
    model = learning.train_once(learning.labelled_sample(docs, labels, sample), features, train)
    return model["w"] if model else np.zeros((1 << BITS) + 1, np.float32)


def quality_scores(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with a column quality_score more, 0 to 1 (quality_score_ where docs has one); all columns are passed on."""
    return scored(docs, weights, score_texts, text, "quality_score")


def scored(docs: DataFrame, weights, fn, text: str, name: str) -> DataFrame:
    """docs with the score of each text; the name takes a `_` more where docs has a column of that name."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)  # of a fixed size
    names, name = docs.columns, common.fresh(docs, name)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(*common.utf8(b.column(at)), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*names, name])

    return docs.mapInArrow(common.trimmed(run), docs.select("*").schema.add(name, "double"))
