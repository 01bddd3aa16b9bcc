"""Toxicity: a factorization machine over hashed terms.

A word's terms are itself, in lower case and without punctuation, and its first 4, 5, 6 and 7 bytes, hashed into
2**BITS places. A text is cut into windows of WINDOW words that overlap by half; a window's terms are those of its
distinct words. A window scores ``b + sum(w[i]) + (|sum(v[i])|^2 - sum(|v[i]|^2)) / 2``: the last part gives each pair
of terms a weight of its own, so that words harmless alone count together. A text scores as its worst window, so a
long text hides nothing.

Training takes at most `sample` labelled texts (a documented bound, 8192), by AdaGrad on each text's worst window,
starting from the terms' log odds; terms of fewer than LEAST sample texts weigh nothing. Terms not likelier in toxic
texts start near nothing and learn slowly, as they are many; pairs of them and they as context still count. Scoring takes every whole text. Defined results: a text without words (or null) scores the bias; without any
labels every score is about 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import common, learning, quality, textkernel as tk

BITS, RANK, WINDOW, SAMPLE, ROUNDS = 19, 4, 160, 8192, 12
PREFIXES = (4, 5, 6, 7)
#: AdaGrad's step, the decay of weights and factors, and the sample texts that a term needs.
STEP, DECAY, DECAY_V, LEAST = 0.25, 2e-4, 2e-3, 8
#: Fixed values for terms not likelier in toxic texts: the scale of their first factors, and AdaGrad's first sum.
REST, SLOW = 0.3, 1e5
BLOCK = 1 << 19

PLAIN = np.zeros(256, bool)  # characters that words keep
PLAIN[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the terms of each word (a run of letters and digits; 0: no such term), and the words' rows."""
    low = tk.LOWER[data]
    solid = PLAIN[low]
    n = len(low)
    if not n:
        return np.zeros((1 + len(PREFIXES), 0), np.int32), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | first[1:]
    end[:-1] &= ~solid[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return (tk.span_hashes(low, s, e, PREFIXES) >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(offsets, s, "right") - 1


def instances(place: np.ndarray, row: np.ndarray, n: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Active places in windows (a word counts once in each), their windows in order, and the windows' rows.

    Windows without active terms are left out. active: a flag for each place; place 0 never is.
    """
    half = WINDOW // 2
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    last = np.maximum(0, -(-counts // half) - 2)  # a row's last window
    on = active[place]
    k, word = np.nonzero(on)
    if not len(word):
        z = np.zeros(0, np.int64)
        return z, z, z
    of, at = row[word], (word - first[row[word]]) // half
    begin = np.cumsum(last + 1) - (last + 1)
    win = np.concatenate([begin[of] + np.minimum(at, last[of]), begin[of] + np.maximum(at - 1, 0)])
    kk, ww = np.concatenate([k, k]), np.concatenate([word, word])
    # a word in a window, and one of its terms, as one number; windows fit 64 - 2 * BITS - 3 bits, as texts are under 2 GB
    tie = (win.astype(np.uint64) << np.uint64(2 * BITS + 3)) | (place[0][ww].astype(np.uint64) << np.uint64(BITS + 3)) | (place[kk, ww].astype(np.uint64) << np.uint64(3)) | kk.astype(np.uint64)
    tie.sort()
    tie = tie[np.append(True, tie[1:] != tie[:-1])]
    win = (tie >> np.uint64(2 * BITS + 3)).astype(np.int64)
    new = np.append(True, win[1:] != win[:-1])
    return ((tie >> np.uint64(3)) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.cumsum(new) - 1, np.searchsorted(begin, win[new], "right") - 1


def raw_scores(place: np.ndarray, win: np.ndarray, n: int, b: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of n windows; and the sums of their factors."""
    vp = v[place]
    lin = np.bincount(win, w[place] - 0.5 * (vp * vp).sum(1), minlength=n)
    sums = np.column_stack([np.bincount(win, vp[:, f], minlength=n) for f in range(RANK)])
    return b + lin + 0.5 * (sums**2).sum(1), sums


def features(data: np.ndarray, offsets: np.ndarray) -> list[dict[str, np.ndarray]]:
    out = []
    for i, j in common.cuts(offsets, BLOCK):
        place, row = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ends = np.searchsorted(row, np.arange(j - i + 1))
        out += [{"t": place[:, a:b]} for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def train(examples: list[dict[str, np.ndarray]], labels: np.ndarray) -> dict[str, np.ndarray]:
    size = 1 << BITS
    rng = np.random.default_rng(7)
    df = np.zeros((2, size), np.int64)
    for e, y in zip(examples, labels.tolist(), strict=True):
        df[int(y > 0), np.unique(e["t"])] += 1
    clean, toxic = df
    odds = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((clean + 0.5) / ((labels == 0).sum() + 1))
    active = toxic + clean >= LEAST  # rarer terms say nothing that holds for other texts
    active[0] = False
    b, w = -3.0, np.where(active & (odds > 1), 0.5 * odds, 0)
    v = rng.normal(0, 0.1, (size, RANK))
    v = np.where((odds > 0.5)[:, None], np.abs(v), REST * v) * active[:, None]  # toxic terms start out together
    gb, gw = 1.0, np.where(odds > 0.5, 1, SLOW).astype(np.float32)
    gv = np.repeat(gw[:, None], RANK, 1)
    part = 256
    for _ in range(ROUNDS):
        order = rng.permutation(len(examples))
        for k in range(0, len(order), part):
            some = order[k : k + part]
            texts = [examples[i]["t"] for i in some]
            row = np.repeat(np.arange(len(some)), [t.shape[1] for t in texts])
            place, win, of = instances(np.concatenate(texts, 1), row, len(some), active)
            y = labels[some].astype(float)
            score = np.full(len(some), b)  # texts without active terms
            pick = np.full(len(some), -1)
            if len(of):
                all_scores, all_sums = raw_scores(place, win, len(of), b, w, v)
                rank = np.lexsort((-all_scores, of))  # the worst window of each text learns its label
                rows, at = np.unique(of[rank], return_index=True)
                pick[rows] = rank[at]
                score[rows] = all_scores[pick[rows]]
            err = learning.sigmoid(score) - y
            gb += err.sum() ** 2
            b -= STEP * err.sum() / np.sqrt(gb)
            if len(of):
                to = np.zeros(len(of))
                to[pick[pick >= 0]] = err[pick >= 0]
                keep = to[win] != 0
                p, g, sums = place[keep], to[win[keep]], all_sums[win[keep]]
                dv = g[:, None] * (sums - v[p])
                uniq, at = np.unique(p, return_inverse=True)
                dw = np.bincount(at, g, minlength=len(uniq)) + DECAY * w[uniq]
                du = np.column_stack([np.bincount(at, dv[:, f], minlength=len(uniq)) for f in range(RANK)]) + DECAY_V * v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += du * du
                w[uniq] -= STEP * dw / np.sqrt(gw[uniq])
                v[uniq] -= STEP * du / np.sqrt(gv[uniq])
    return {"b": np.array([b]), "w": w.astype(np.float32), "v": v.astype(np.float32), "active": active}


def score_texts(data: np.ndarray, offsets: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    n, bias = len(offsets) - 1, float(model["b"][0])
    out = np.full(n, bias)
    for i, j in common.cuts(offsets, BLOCK):
        place, row = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        place, win, of = instances(place, row, j - i, model["active"])
        if len(of):
            score, _ = raw_scores(place, win, len(of), bias, model["w"], model["v"])
            worst = np.full(j - i, bias)  # windows without active terms
            np.maximum.at(worst, of, score)
            out[i:j] = worst
    return learning.sigmoid(out)


def toxicity_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """docs: doc_id, text; labels: doc_id, label (1: toxic)."""
    model = learning.train_once(learning.labelled_sample(docs, labels, sample), features, train)
    return model or {"b": np.array([-60.0]), "w": np.zeros(1 << BITS, np.float32), "v": np.zeros((1 << BITS, RANK), np.float32), "active": np.zeros(1 << BITS, bool)}


def toxicity_scores(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", out: str = "toxicity_score") -> DataFrame:
    """docs with a column `out` more, 0 to 1 (with a `_` more where docs has it); all columns are passed on."""
    return quality.scored(docs, model, score_texts, text, out)
