"""The text operators against brute force, round trips and held-out labels, and on awkward tables."""

import collections
import gc
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stridewell.llm import bwt, common, context_mixing, decontam, fingerprint, graph, html_extract, langid, learning, packing, quality, queries, shingle_join, simhash, suffix_dedup, textkernel, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return WORD.findall(lower(s))


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents").toPandas()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, names that clash with the operators' own."""
    long = " ".join(f"word{i % 997} von" for i in range(30_000))
    base = " ".join(f"tok{i}" for i in range(300))
    rows = [
        (1, None, None, 1), (2, "", "en", 2), (3, "   \n\t ", "en", 3), (4, long, "de", 4), (5, "a", None, 5), (6, "123 ... !!", "en", 6),
        (7, base, "en", 7), (7, base, "en", 8), (8, base, "fr", 9), (9, base + " extra", "en", 10), (None, base, "en", 11), (None, None, None, 12),
        (10, "é" * 500 + " ß " + "日本語 テスト " * 60, "de", 13), (11, "é" * 500, "de", 14), (12, "For " * 400, "en", 15), (12, "other text", None, 16),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int").withColumns({"bucket": F.lit("x"), "key": F.lit(1.5), "_doc": F.col("n"), "sid": F.lit(None).cast("string"), "block": F.lit(3)})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


# kernel --------------------------------------------------------------------------------------------------------------
def test_words_and_shingles(docs):
    texts = [t or "" for t in docs.text[:40]] + ["", " a", "A b", "x y z\x1cq", "a b c", "A B C"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = textkernel.Words(data, offs)
    assert [data[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)] == [x for t in texts for x in WORD.findall(t)]
    seen = {}
    for h, s, e in zip(w.hash.tolist(), w.start, w.end, strict=True):
        assert seen.setdefault(h, lower(data[s:e].tobytes().decode())) == lower(data[s:e].tobytes().decode())
    h, row = textkernel.distinct_by_row(*w.shingles(3))
    want = [len({tuple(words(t)[i : i + 3]) for i in range(max(1, len(words(t)) - 2))}) if words(t) else 0 for t in texts]
    assert np.bincount(row, minlength=len(texts)).tolist() == want
    assert set(h[row == len(texts) - 1]) == set(h[row == len(texts) - 2])


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    data = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    s = np.arange(0, 4990, 10)
    want = textkernel.span_hashes(data, s, s + 7)
    monkeypatch.setattr(textkernel, "PIECE", 64)
    assert (textkernel.span_hashes(data, s, s + 7) == want).all()
    whole = textkernel.span_hashes(data, np.array([0]), np.array([5000]))
    monkeypatch.setattr(textkernel, "PIECE", 1 << 19)
    assert (textkernel.span_hashes(data, np.array([0]), np.array([5000])) == whole).all()


# 1 -------------------------------------------------------------------------------------------------------------------
def _distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_edit_distances():
    rng = np.random.default_rng(1)
    sig = ["".join(rng.choice(list("ABCD"), n)) for n in rng.integers(0, 65, 60)] + ["", "A" * 64]
    a, b = sig, sig[::-1]
    assert fingerprint.edit_distances(a, b).tolist() == [_distance(x, y) for x, y in zip(a, b, strict=True)]


def test_op1(spark, sf, docs):
    got = queries.op1_fingerprints(spark, sf).toPandas().set_index("doc_id")
    p = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    prints = collections.defaultdict(set)
    for i in range(len(p)):
        a, b = p.text[i] or "", p.text[(i + 1) % len(p)] or ""
        h = len(a) // 2
        r = got.loc[p.doc_id[i]]
        assert r.edited_sha256 == hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest() and r.n_chars == len(a)
        prints[a].add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert got.near_edited.between(0, 1).all() and got.near_edited.mean() > 0.35 and got.near_next.mean() < 0.1


def test_rows_without_ids_follow_each_other(spark):
    texts = ["b" * 900, "a" * 901, None]
    got = fingerprint.fingerprint_edits(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).collect()
    order = [None, texts[1], texts[0]]  # nulls, then in order of the texts
    edited = {hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in ((x or "", y or "") for x, y in zip(order, [*order[1:], order[0]], strict=True))}
    assert {r.edited_sha256 for r in got} == edited and len(got) == 3


def test_fingerprints_of_copies_are_near():
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(800))
    raw = [text.encode(), (text[:2000] + "changed here" + text[2010:]).encode(), " ".join(f"v{i * 31 % 997}" for i in range(800)).encode()]
    a, b, c = fingerprint.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert fingerprint.likeness([a, a], [b, c]).tolist()[0] > 0.8 and fingerprint.likeness([a], [c])[0] < 0.2


# 2 -------------------------------------------------------------------------------------------------------------------
def _components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = collections.defaultdict(list)
    for a, s in sets.items():
        common_ = collections.Counter(b for x in s for b in held[x])
        for x in s:
            held[x].append(a)
        for b, n in common_.items():
            if den * n >= num * (len(s) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_op2(spark, sf, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_ngram_jaccard_join(spark, sf).collect()}
    assert got == _components(zip(docs.doc_id, docs.text, strict=True), 3, 90, 100)


@pytest.mark.parametrize(("k", "num", "den", "small"), [(5, 4, 5, False), (2, 7, 10, False), (5, 4, 5, True)])
def test_join_of_near_copies(spark, monkeypatch, k, num, den, small):
    """A large group of near copies, chains, shared frequent passages, sets of every size; also dealt to small blocks."""
    if small:
        for name, value in (("KEY_ROWS", 7), ("GROUP_ROWS", 64), ("PAIRS", 32)):
            monkeypatch.setattr(shingle_join, name, value)
    rng = np.random.default_rng(k)
    vocab = [f"v{i}" for i in range(400)]
    base = list(rng.choice(vocab, 160))
    frequent = list(rng.choice(vocab, 60))
    rows = []
    for i in range(90):
        w = list(base)
        for p in rng.integers(0, len(w), rng.integers(0, 5)):
            w[p] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([*frequent, *rng.choice(vocab, rng.integers(0, 40))])) for i in range(60)]
    rows += [(200 + i, " ".join(base[: 3 * i + 1])) for i in range(50)] + [(300, ""), (301, None), (302, "v1")]
    df = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.jaccard_components(df, k, num, den).collect()}
    assert got == _components(rows, k, num, den)


def test_prefixes_share_a_key():
    """Any two sets that link share an index key, also when most shingles are frequent."""
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sketch = np.full(1 << shingle_join.SKETCH_BITS, 5, np.uint64)
    sketch[(pool[:2000] >> np.uint64(64 - shingle_join.SKETCH_BITS)).astype(np.int64)] = 5000
    for num, den in ((90, 100), (4, 5)):
        for _ in range(60):
            n = int(rng.integers(1, 700))
            a = rng.choice(pool, n, replace=False)
            b = np.unique(np.concatenate([a[rng.random(n) > rng.random() * 0.2], rng.choice(pool, int(rng.integers(0, 1 + n // 10)), replace=False)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or den * both < num * (len(a) + len(b) - both):
                continue
            keys = [set(shingle_join.index_keys(np.unique(s), np.zeros(len(s), np.int64), np.array([len(s)]), sketch, num, den)[0].tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), *[(100 + i, 101 + i) for i in range(40)], (7, 500), (500, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[3] == got[500] == got[7] == 1 and got[11] == 10 and got[140] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3, 4, 6 -------------------------------------------------------------------------------------------------------------
def _held_out(spark, name, label):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas().merge(common.table(spark, sf, "labels").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all()
    return got[got.held_out], label


def test_op3_held_out(spark):
    g, y = _held_out(spark, "op3_quality", "quality")
    assert (g.predicted == g[y]).mean() > 0.93 and (g.held_out == [crc(i, 5) == 0 for i in g.doc_id]).all()


def test_op4_held_out(spark):
    g, y = _held_out(spark, "op4_toxicity", "toxic")
    assert (g.predicted == g[y]).mean() > 0.9 and (g.held_out == [crc(i, 3) == 1 for i in g.doc_id]).all()


def test_factorization_machine_learns_pairs():
    """Either term alone is harmless; only both together are toxic."""
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(900):
        w = list(rng.choice([f"n{k}" for k in range(60)], 30))
        kind = i % 4
        w += ["insultx"] * (kind in (1, 3)) + ["groupy"] * (kind in (2, 3))
        rng.shuffle(w)
        texts.append(" ".join(w).encode())
        labels.append(int(kind == 3))
    offs = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    model = toxicity.train(toxicity.features(data, offs), np.array(labels))
    score = toxicity.score_texts(data, offs, model)
    assert ((score >= 0.5) == np.array(labels)).mean() > 0.97


def test_factorization_machine_learns_terms_equally_frequent_in_both_classes():
    """No term alone tells the classes apart: an insult is toxic with a mention, a greeting without one."""
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(900):
        mention, insult = i & 1, i >> 1 & 1
        w = [*rng.choice([f"n{k}" for k in range(60)], 30), *["groupy"] * mention, "insultx" if insult else "greeting"]
        rng.shuffle(w)
        texts.append(" ".join(w).encode())
        labels.append(int(mention == insult))

    def block(some):
        return np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])

    model = toxicity.train(toxicity.features(*block(texts[:600])), np.array(labels[:600]))
    assert ((toxicity.score_texts(*block(texts[600:]), model) >= 0.5) == np.array(labels[600:])).mean() > 0.9


def test_models_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, label int")
    w = quality.quality_model(awkward.select("doc_id", "text"), none)
    assert {r.quality_score for r in quality.quality_scores(awkward, w).collect()} == {0.5}
    m = toxicity.toxicity_model(awkward.select("doc_id", "text"), none)
    assert max(r.toxicity_score for r in toxicity.toxicity_scores(awkward, m).collect()) < 1e-6


def test_op6_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, sf).toPandas().merge(common.table(spark, sf, "documents").toPandas()[["doc_id", "lang"]], on="doc_id")
    assert (got.held_out == [crc(i, 4) == 2 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97


def _viterbi(score):
    best, back = score[0].copy(), []
    for s in score[1:]:
        move = best.max() - np.float32(langid.SWITCH)
        back.append(np.where(move > best, best.argmax(), np.arange(len(best))))
        best = np.maximum(best, move) + s
    path = [int(best.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_in_step():
    rng = np.random.default_rng(4)
    size = [5, 0, 30, 1, 12]
    score = rng.normal(0, 6, (sum(size), 3)).astype(np.float32)
    got = langid.viterbi(score, np.repeat(np.arange(5), size), 5)
    parts = np.split(score, np.cumsum(size)[:-1])
    assert got.tolist() == [x for p in parts if len(p) for x in _viterbi(p)]


def test_mixed_language_spans(docs):
    lang = {k: " ".join(t for t in docs[docs.lang == k].text if t) for k in ("en", "de")}
    raw = [lang["en"][:40000].encode(), lang["de"][:40000].encode()]
    model = langid.train(langid.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])), np.array(["en", "de"]))
    mixed = (" ".join(lang["en"].split()[-80:]) + " " + " ".join(lang["de"].split()[-80:])).encode()
    got, score, spans = langid.label(np.frombuffer(mixed, np.uint8), np.array([0, len(mixed)]), model)
    assert [s["lang"] for s in spans.to_pylist()[0]] == ["en", "de"] and abs(spans.to_pylist()[0][1]["first_word"] - 80) < 6


# 5 -------------------------------------------------------------------------------------------------------------------
def _align(a, b):
    h = np.zeros((len(b) + 1, len(a) + 1), int)
    for i, y in enumerate(b, 1):
        for j, x in enumerate(a, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_matches_table():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rng.integers(0, 4, int(rng.integers(1, 25))).astype(np.uint64) for _ in range(2))
        score, s, e = decontam.align(a, b)
        assert score == _align(a, b)
        assert 0 <= s <= e <= len(a) and (score == 0 or _align(a[s:e], b) == score)


def test_planted_benchmark_copies(spark, sf, docs):
    bench = common.table(spark, sf, "benchmark").toPandas()
    rng = np.random.default_rng(6)
    clean = [t for t in docs.text if t and len(t) > 300][:60]
    rows, want = [], set()
    for i, t in enumerate(clean):
        rows.append((1000 + i, t))
    found = {r.doc_id for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), common.table(spark, sf, "benchmark")).collect()}
    for i, item in enumerate(bench.text[:30]):
        w = item.split()
        if i % 3 == 1:  # words changed
            for p in rng.integers(0, len(w), max(1, len(w) // 10)):
                w[p] = "zzz"
        if i % 3 == 2:  # words left out
            w = [x for x in w if rng.random() > 0.1]
        host = next(t for r, t in rows[i:] if r not in found).split()
        rows.append((i, " ".join(host[:40] + w + host[40:])))
        want.add((i, int(bench.item_id[i])))
    got = decontam.contaminated(spark.createDataFrame([(int(a), b) for a, b in rows], "doc_id long, text string"), common.table(spark, sf, "benchmark")).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}


def test_exact_benchmark_copies_are_found(spark, sf, docs):
    bench = common.table(spark, sf, "benchmark").toPandas()
    got = {(r.doc_id, r.item_id) for r in queries.op5_benchmark_decontamination(spark, sf).collect()}
    flat = {i: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t))) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    for j, b in zip(bench.item_id, bench.text, strict=True):
        item = " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(b)))
        assert {(i, j) for i, t in flat.items() if f" {item} " in f" {t} "} <= got


def test_changed_copies_with_an_intact_run_are_found(spark):
    """Every copy of likeness 0.5 and more that keeps three words of its item in a row, wherever they are."""
    rng = np.random.default_rng(14)
    changed = [(14, (3, 7, 11)), (15, (2, 6, 10, 13))] + [(15, tuple(rng.choice(15, 4, replace=False).tolist())) for _ in range(60)]
    changed += [(90, tuple(rng.choice(90, 30, replace=False).tolist())) for _ in range(10)]
    items, rows, want = [], [], set()
    for i, (size, places) in enumerate(changed):
        item = [f"i{i}w{k}" for k in range(size)]
        copy = [f"c{i}w{k}" if k in places else w for k, w in enumerate(item)]
        text = [f"t{i}w{k}" for k in range(40)] + copy + [f"u{i}w{k}" for k in range(40)]
        items.append((i, " ".join(item)))
        rows.append((i, " ".join(text)))
        number = {w: k for k, w in enumerate(dict.fromkeys(item + text))}
        score, _, _ = decontam.align(*(np.array([number[w] for w in x], np.uint64) for x in (text, item)))
        if score / (2 * size) >= 0.5 and any(copy[k : k + 3] == item[k : k + 3] for k in range(size - 2)):
            want.add((i, i))
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(0, 0), (1, 1)} < want and {(r.doc_id, r.item_id) for r in got.collect()} == want


# 7 -------------------------------------------------------------------------------------------------------------------
def _cover(rows, n):
    at = collections.Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    out = []
    for i, t in rows:
        mark = np.zeros(len(t) + 1, int)
        for k in range(len(t) - n + 1):
            if at[t[k : k + n]] > 1:
                mark[k] += 1
                mark[k + n] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        out.append((i, gone, bytes(np.frombuffer(t, np.uint8)[~gone]) if len(t) else b""))
    return out


def _aligned(rng, kind, m, e):
    """Rows around cores, many of them alike: cores, what stands before and after them, and how much of it there is."""
    core, base = rng.integers(0, 4, m), rng.integers(0, 3, (3, 2 * e)).astype(kind)
    rows = base[rng.integers(0, 3, m)].copy()
    other = rng.random(rows.shape) < 0.05
    rows[other] = rng.integers(0, 3, int(other.sum()))
    a, b = (np.where(rng.random(m) < 0.3, rng.integers(0, e + 1, m), e) for _ in range(2))
    left, right = rows[:, :e].copy(), rows[:, e:].copy()
    left[np.arange(e)[None] < (e - a)[:, None]] = 0
    right[np.arange(e)[None] >= b[:, None]] = 0
    return core, left, a, right, b


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_merge_of_transforms(kind):
    """The merge of the shards' transforms is the transform of all, which is that of sorted suffixes."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        m, e = int(rng.integers(1, 60)), int(rng.integers(0, 20))
        core, _, _, right, b = _aligned(rng, kind, m, e)
        symbols, per = bwt.packed(right)
        cut = sorted({0, m, *rng.integers(0, m + 1, 3).tolist()})
        shards = [bwt.transform(np.arange(x, y), core, symbols, b, per) for x, y in zip(cut, cut[1:], strict=False)]
        order, shared = bwt.merge(shards, core, symbols, b, per)
        whole = bwt.transform(np.arange(m), core, symbols, b, per)
        suffix = [(int(core[i]), right[i][: b[i]].tolist()) for i in range(m)]
        assert [suffix[i] for i in order] == sorted(suffix) == [suffix[i] for i in whole[0]]
        want = [-1] + [-1 if x[0] != y[0] else next((k for k, (p, q) in enumerate(zip(x[1], y[1], strict=False)) if p != q), min(len(x[1]), len(y[1]))) for x, y in itertools.pairwise(sorted(suffix))]
        assert shared.tolist() == want == whole[1].tolist()


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_merged_transforms_find_repeats(kind, monkeypatch):
    rng = np.random.default_rng(9)
    for _ in range(60):
        m, e = int(rng.integers(1, 60)), int(rng.integers(0, 20))
        monkeypatch.setattr(bwt, "SHARD", int(rng.integers(1, 30)))
        core, left, a, right, b = _aligned(rng, kind, m, e)
        low, high = bwt.repeated(core, left, a, right, b)
        at = [{j: (core[i], j, left[i][e - j :].tobytes(), right[i][: e - j].tobytes()) for j in range(e + 1) if a[i] >= j and b[i] >= e - j} for i in range(m)]
        count = collections.Counter(x for w in at for x in w.values())
        for i, w in enumerate(at):
            hits = [j for j, x in w.items() if count[x] > 1]
            assert (low[i], high[i]) == ((min(hits), max(hits)) if hits else (1 << 30, -1))


def test_op7(spark, sf, docs):
    rows = [(i, (t or "").encode()) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_array_dedup(spark, sf).collect()}
    for (i, t), (_, gone, kept) in zip(rows, _cover(rows, 400), strict=True):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert got[i] == (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_passage_of_many_texts(spark, monkeypatch):
    """More different stretches around one core than one task takes: cores are split until few enough differ."""
    monkeypatch.setattr(suffix_dedup, "MOST", 6)
    rng = np.random.default_rng(10)

    def prose(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))

    passage, other = prose(80), prose(75)
    rows = [(i, prose(30) + " " + passage + " " + prose(int(rng.integers(0, 40)))) for i in range(40)]
    rows += [(100 + i, prose(20) + other[: 430 + i] + prose(30)) for i in range(12)] + [(200, "ab " * 300), (201, prose(200)), (202, "x")]
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.measure_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, gone, kept in _cover([(i, t.encode()) for i, t in rows], 400):
        assert got[i] == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), i


def test_passages_of_words(spark, monkeypatch):
    """Runs of words that occur again, whatever stands between the words, against brute force; and with split cores."""
    rng = np.random.default_rng(11)

    def prose(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))

    passage = prose(51)
    texts = [f"{prose(int(rng.integers(0, 60)))} {passage} {prose(int(rng.integers(0, 60)))}".strip() for _ in range(30)]
    texts += [passage.replace(" ", "\n"), " ".join(passage.split()[1:]), prose(300), "ab " * 200, "", prose(3), prose(70) + " " + " ".join(passage.split()[:50]) + " é"]
    grams = collections.Counter(tuple(w[i : i + 51]) for w in (t.split() for t in texts) for i in range(len(w) - 50))
    want = {}
    for i, t in enumerate(texts):
        w = [(m.start(), m.end()) for m in WORD.finditer(t)]
        gone = {k for j in range(len(w) - 50) if grams[tuple(t.split()[j : j + 51])] > 1 for k in range(j, j + 51)}
        byte = [t[:k].encode() for k in range(len(t) + 1)]
        want[i] = sum(len(byte[w[k + 1][0] if k + 1 < len(w) else len(t)]) - len(byte[w[k][0]]) for k in gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (suffix_dedup.MOST, 4):
        monkeypatch.setattr(suffix_dedup, "MOST", most)
        assert {r.doc_id: r.passage_bytes for r in suffix_dedup.measure_repeats(docs, passage=51).collect()} == want


# 8 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<b>x</i>y", "xy"), ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "* a\n* b\n  * c"), ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
        ("<script>if (a<b) x()</script>t<style>p{}</style>", "t"), ("<p hidden>no</p>yes<span style='color:red; display : none'>no</span>", "yes"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"), ("<table><tr><th colspan=2>h<tr><td>a<td>b</table>", "h |\na | b"),
        ("<pre>\n  a\n b</pre>", "  a\n b"), ("<!-- <p>x</p> -->y", "y"), ("a &amp;lt; b &euro;", "a &lt; b €"), ("<title>t</title><h1>A</h1>b", "A\n\nb"),
        ("<blockquote>a<p>b</blockquote>c", "> a\n>\n> b\n\nc"), ("a <!-- never closed", "a"), ("<p title='a>b'>x", "x"), ("x < y", "x < y"), ("<img alt='pic'>", "pic"),
    ],
)
def test_rendering(page, text):
    assert html_extract.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<button>Save</button>b", "a Save b"), ("<select><option>x<option>y</select>z", "x\ny\nz"), ("<textarea>\np &amp;\n q</textarea>", "p &\n q"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math>", "x=2"), ("<svg><title>t</title><rect/><text>A</text><text>B</text></svg>c", "A B c"),
        ("<dialog open>yes</dialog><dialog>no</dialog>", "yes"), ("<span aria-hidden=true>seen</span>", "seen"),
        (f"<table><tr><td>{'w' * 80}<td>b<tr><td>a<td>c</table>", f"{'w' * 80} | b\na{' ' * 79} | c"),
        ("<table>" + "<tr><td rowspan=60>a<td>b" + "<tr><td>c" * 59 + "<tr><td>d<td>e</table>", "a | b\n" + "  | c\n" * 59 + "d | e"),
        ("<div>" * 200 + "a<span hidden>no<b>no</b></span>b</div>c" + "</div>" * 199 + "d", "abc\nd"),
        ("<ul><li>" + "<b>" * 300 + "<i>x</i></b>" + "</b>" * 299 + "<li>y</ul>z", "* x\n* y\n\nz"),
    ],
)
def test_rendering_of_all_that_is_visible(page, text):
    assert html_extract.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"a&#{'9' * 5000};b", "a\ufffdb"), (f"<img alt='&#x{'f' * 5000};'>", "\ufffd"), (f"&#{'0' * 5000}65;", "A"), ("&#x1F600; &#128512;", "\U0001f600 \U0001f600"),
        ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p>no</div>", "yes"), ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>b</ul>", "* b"),
        ("<div style='visibility:hidden'><pre>no</pre><hr></div>z", "z"), ("<p style='visibility:hidden; visibility:visible'>a", "a"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<table><tr><td colspan=3>a<td>b<tr><td>c<td>d</table>", "a |   | b\nc | d"), ("<table><tr><td colspan=9>a<tr><td>c<td>d<td>e</table>", "a |\nc | d | e"),
    ],
)
def test_rendering_of_long_references_and_visibility(page, text):
    assert html_extract.render(page) == text


def test_text_is_bounded_by_the_page():
    page = "<table>" + "<tr><td colspan=1000 rowspan=65534>a</td></tr>" * 150 + "</table>"
    began = time.perf_counter()
    assert len(html_extract.render(page)) < 20 * len(page)
    assert time.perf_counter() - began < 1


def test_rendering_never_fails(spark, sf):
    rng = np.random.default_rng(11)
    bits = ["<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<p>", "</p>", "<div", ">", "'", '"', "&#0;", "&nosuch;", "x ", "<b>", "</div>", "<!--", "-->", "<pre>", "<script>", "</script>", "<dd>", "</", "<a b=c d>"]
    for _ in range(300):
        html_extract.render("".join(rng.choice(bits, 30)))
    assert html_extract.render("<div>" * 5000 + "deep") == "deep"
    pages = common.table(spark, sf, "pages")
    got = queries.op8_html_extraction(spark, sf).toPandas()
    assert len(got) == pages.count() and (got.n_chars == got.text.str.len()).all() and (got.n_chars > 0).mean() > 0.9
    assert not got.text.str.contains("<script|track\\(").any()


# 9 -------------------------------------------------------------------------------------------------------------------
def test_op9(spark, sf, docs):
    tokens = {i: [*words(t), None] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    count = collections.Counter(w for i, t in tokens.items() if crc(i, 10) for w in t)
    n, v = sum(count.values()), len(count)
    got = queries.op9_lm_scoring(spark, sf).toPandas()
    for r in got.itertuples():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 10) == 0, len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    assert (got.score < 0).all() and got.bits_per_byte.mean() < 4
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()
    assert ((out.score - out.spelling_score) > out.base_score).mean() > 0.9


def _op9_block(rows):
    """The stored row of a block of (doc_id, text, held)."""
    t = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "held": [r[2] for r in rows]})
    return context_mixing._block(t, rows[0][0]).to_pylist()[0]


def test_runs_are_counted_over_all_blocks():
    rng = np.random.default_rng(16)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 40))), i % 4 == 0) for i in range(60)]
    blocks = [_op9_block(rows[k : k + 15]) for k in range(0, 60, 15)]
    counts = [collections.Counter() for _ in range(2)]
    for _, text, held in rows:
        t = [0, 0, *text.split(), None]
        for j in range(2, len(t)):
            if not held:
                counts[0][tuple(t[j - 1 : j + 1])] += 1
                counts[1][tuple(t[j - 2 : j + 1])] += 1
    shards = 3
    packed = pa.Table.from_batches([context_mixing._runs(b, shards, 48) for b in blocks]).to_pylist()
    back: dict = {}
    for s in range(shards):
        for r in context_mixing._run_totals(pa.Table.from_pylist([r for r in packed if r["shard"] == s])).to_pylist():
            for name in ("two", "three"):
                back.setdefault((r["block"], name), []).append(context_mixing._unzip_numbers(r[f"{name}_counts"], r[f"n_{name}s"]))
    for b, first in zip(blocks, range(0, 60, 15), strict=True):
        ids = context_mixing.learning.unpack(b["ids"])
        tok = context_mixing.Tokens(context_mixing._unzip(b["texts"], np.uint8, b["size"]), ids["offsets"])
        for name, n, keys, want in zip(("two", "three"), (2, 3), tok.runs(48), counts, strict=True):
            got = np.concatenate(back[b["block"], name])[np.unique(keys, return_inverse=True)[1]]
            expected = [want[tuple(t[j - n + 1 : j + 1])] for _, x, _ in rows[first : first + 15] for t in [[0, 0, *x.split(), None]] for j in range(2, len(t))]
            assert got.tolist() == expected


def test_numbers_and_keys_come_back():
    rng = np.random.default_rng(17)
    for x in (np.zeros(0, np.uint64), np.zeros(3, np.uint64), np.unique(rng.integers(0, 2**64, 500, np.uint64)), np.array([2**64 - 1], np.uint64)):
        assert (context_mixing._unzip_numbers(context_mixing._zip_numbers(x), len(x)) == x).all()
        assert (context_mixing._unzip_keys(context_mixing._zip_keys(x), len(x)) == x).all()


def test_gates_keep_a_distribution_and_follow_what_helps():
    rng = np.random.default_rng(18)
    shares = [rng.dirichlet(np.ones(5)) for _ in range(2)]  # of five words after one context
    p = np.full(5, 0.2)
    out = context_mixing._gated(np.log(p), shares, [np.full(5, 9), np.full(5, 3)], np.zeros(5, bool))
    assert np.exp(out).sum() == pytest.approx(1)
    shut = context_mixing._gated(np.log(p), shares, [np.zeros(5, int)] * 2, np.ones(5, bool))
    assert np.allclose(shut, np.log(p))
    right = np.full(2000, 0.9)
    out = context_mixing._gated(np.full(2000, math.log(0.01)), [right, np.full(2000, 0.001)], [np.full(2000, 5)] * 2, np.ones(2000, bool))
    assert np.exp(out).min() > 0.8


def test_a_text_gains_from_its_copy_and_not_from_itself(spark):
    rng = np.random.default_rng(19)
    vocab = ["".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(vocab, 60)), False) for i in range(300)]
    rows += [(300 + i, rows[i][1], i % 2 == 0) for i in range(20)]
    got = context_mixing.mixing_scores(spark.createDataFrame(rows, "doc_id long, text string, held boolean")).toPandas().set_index("doc_id")
    twice, alone = got.score[got.index < 20], got.score[(got.index >= 20) & (got.index < 300)]
    # a training text with a held-out copy has no other training occurrence
    assert twice[twice.index % 2 == 1].min() > alone.max() and got.score[got.held_out].min() > alone.max()
    assert twice[twice.index % 2 == 0].max() < twice[twice.index % 2 == 1].min()


def test_codes_are_complete():
    for n in (1, 2, 3, 50):
        c = context_mixing.huffman(np.arange(n) ** 2)
        assert sum(2.0 ** -int(s) for s in c["size"]) == pytest.approx(1)
        paths = {tuple(c["bit"][f : f + s]) for f, s in zip(c["first"], c["size"], strict=True)}
        assert len(paths) == n


def test_mixer_is_a_distribution_and_learns():
    rng = np.random.default_rng(12)
    m = context_mixing.Mixer(2)
    for _ in range(20):
        context = rng.integers(0, 4, 2000)
        bit = (rng.random(2000) < np.array([0.05, 0.9, 0.5, 0.99])[context]).astype(np.uint8)
        m.refresh()
        m.learn([np.zeros(2000, np.int64), context], bit)
    fixed = context_mixing.Mixer(2, {"counts": m.counts, "weights": m.weights, "refine": m.refine})
    slots = [np.zeros(4, np.int64), np.arange(4)]
    one, zero = (10 ** fixed.logs(slots, np.full(4, b, np.uint8)) for b in (1, 0))
    assert np.allclose(one + zero, 1) and np.allclose(one, [0.05, 0.9, 0.5, 0.99], atol=0.03)


def test_spellings_sum_to_less_than_one():
    """Over all spellings of up to three letters of a small alphabet."""
    text = b"a b ab ba abc c a a b cab " * 40
    model = context_mixing.Spelling(context_mixing.huffman(np.bincount(list(text), minlength=257) + (np.arange(257) == 256) * 300))
    w = textkernel.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    model.learn(w.lower, w.start, w.end)
    model.mixer.refresh()
    raw = " ".join(dict.fromkeys(a + b + c for a in "abc" for b in ("", *"abc") for c in ("", *"abc"))).encode()
    w = textkernel.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    total = (10 ** model.logs(w.lower, w.start, w.end)).sum()
    assert 0.3 < total <= 1


def test_every_byte_of_a_long_new_word_costs(spark):
    rng = np.random.default_rng(15)
    rows = [(i, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(60)), False) for i in range(20)]
    rows += [(100 + n, "".join(chr(97 + c) for c in rng.integers(0, 26, n)), True) for n in (300, 3_000, 30_000)]
    got = {r.doc_id: r.score for r in context_mixing.mixing_scores(spark.createDataFrame(rows, "doc_id long, text string, held boolean")).collect()}
    for n in (300, 3_000, 30_000):  # 26 letters at random: 1.41 digits each at best
        assert -2.2 * n < got[100 + n] < -1.3 * n


# 10 ------------------------------------------------------------------------------------------------------------------
def test_windows_cost_least():
    """Against all ways to cut, on small inputs."""
    rng = np.random.default_rng(13)
    for _ in range(60):
        length, total = 1024, int(rng.integers(1, 3000))
        ends = np.unique(np.append(rng.integers(1, total + 1, 4), total))
        sentences = np.unique(rng.integers(1, total + 1, 9))
        cuts = np.union1d(np.union1d(ends, sentences), [0, total])
        far = np.flatnonzero(np.diff(cuts) > length)
        hard = np.concatenate([np.arange(cuts[i] + length, cuts[i + 1], length) for i in far]) if len(far) else np.zeros(0, int)
        cuts = np.union1d(cuts, hard).tolist()

        def price(a, b, ends=ends, hard=hard):
            n = b - a
            pad = 0 if n >= 1 << packing.LEAST_POWER and n & (n - 1) == 0 else length - n
            return pad + packing.EACH + (0 if b in ends else packing.IN_SENTENCE if b in hard else packing.IN_TEXT)

        best = {0: 0.0}
        for b in cuts[1:]:
            best[b] = min(best[a] + price(a, b) for a in cuts if a < b and b - a <= length)
        got = [0, *packing.windows(total, ends, sentences, length)]
        assert got[-1] == total and max(np.diff(got)) <= length
        assert sum(price(a, b) for a, b in zip(got[:-1], got[1:], strict=True)) == pytest.approx(best[total])


def test_every_power_of_two_is_a_window_without_padding():
    """Against all ways to cut; the price is the contract's and takes nothing from the code but the fixed amounts."""
    rng = np.random.default_rng(16)
    for _ in range(60):
        length, total = 4096, int(rng.integers(1, 6000))
        ends = np.unique(np.append(np.cumsum(2 ** rng.integers(0, 12, 6)), total))
        ends = ends[ends <= total]
        cuts = np.union1d(ends, rng.integers(0, total + 1, 9)).tolist()
        far = [c for a, b in zip([0, *cuts], cuts, strict=False) for c in range(a + length, b, length)]
        cuts = sorted({0, *cuts, *far})

        def price(a, b, ends=ends, far=far):
            n = b - a
            pad = 0 if n & (n - 1) == 0 else length - n
            return pad + packing.EACH + (0 if b in ends else packing.IN_SENTENCE if b in far else packing.IN_TEXT)

        best = {0: 0.0}
        for b in cuts[1:]:
            best[b] = min(best[a] + price(a, b) for a in cuts if a < b and b - a <= length)
        got = [0, *packing.windows(total, ends, np.array([c for c in cuts if c not in far], np.int64), length)]
        assert sum(price(a, b) for a, b in zip(got[:-1], got[1:], strict=True)) == pytest.approx(best[total])


def _check_pieces(pieces, ids):
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for x in g.itertuples():
            assert x.start == at and x.doc_tokens == len(ids[i])
            assert x.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + x.length], "<u4").tobytes())
            at += x.length
        assert at == len(ids[i])
    seq = pieces.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.sum() <= 4096).all()
    assert (seq.offset == seq.groupby("sequence_id").length.cumsum() - seq.length).all()


def test_op10(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(queries.tokenizer_spec())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in zip(docs.doc_id, docs.text, strict=True)}
    _check_pieces(queries.op10_packing(spark, sf).toPandas(), ids)


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    spec = queries.tokenizer_spec()
    t = Tokenizer.from_str(spec)
    texts = ["", " ", "a", "Don't  stop", "x y z", "é é ́x", "<|endoftext|> a<|startoftext|>b", "日本 語", "a\x1cb\x0bc\x85d", "1 234", "!?.'s 's", "İ ſ ß", "́", "tab\tnew\nline\r\n"]
    raw = [x.encode() for x in texts]
    ids, offs, _ = packing.token_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), packing.WordIds(spec), 2)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


# all, on awkward and empty tables ------------------------------------------------------------------------------------
def test_awkward_tables(spark, awkward, empty):
    n = awkward.count()
    spec = queries.tokenizer_spec()
    for df, m in ((awkward, n), (empty, 0)):
        ids = df.select("doc_id", "text")
        assert fingerprint.fingerprint_edits(df).count() == m
        assert shingle_join.jaccard_components(df).count() == m
        assert suffix_dedup.measure_repeats(df).count() == m
        assert suffix_dedup.cut_repeats(df).count() == m
        assert context_mixing.mixing_scores(df.withColumn("held", F.col("doc_id") == 4)).count() == m
        assert packing.pack_documents(df, spec).where("start = 0").count() == m
        model = langid.language_model(df)
        assert langid.languages(df, model).count() == m
        items = spark.createDataFrame([(1, " ".join(f"tok{i}" for i in range(20, 50))), (2, None), (3, ""), (None, "tok1 tok2"), (4, "a")], "item_id long, text string")
        found = decontam.contaminated(df, items)
        assert found.count() == 0 if not m else {(r.doc_id, r.item_id) for r in found.collect()} >= {(7, 1), (9, 1), (None, 1), (5, 4)}
        labels = df.select("doc_id", (F.col("n") % 2).alias("label"))
        assert quality.quality_scores(df, quality.quality_model(ids, labels)).columns[-1] == "quality_score"
        assert toxicity.toxicity_scores(df, toxicity.toxicity_model(ids, labels)).count() == m
        assert html_extract.extract_text(df, "doc_id", "text").count() == m
    assert decontam.contaminated(awkward, awkward.limit(0), item_id="doc_id", item_text="text").count() == 0


def test_awkward_results(spark, awkward):
    joined = {(r.doc_id, r.n_shingles): r.component_id for r in shingle_join.jaccard_components(awkward).collect()}
    assert joined[7, 296] == joined[8, 296] == joined[9, 297] == 7 and joined[2, 0] == 2
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(awkward, langid.language_model(awkward)).collect()}
    assert lang[1] == lang[2] == lang[6] == ("und", 0.0)
    cut = suffix_dedup.cut_repeats(awkward)
    assert cut.columns == awkward.columns
    left = {r.n: r.text for r in cut.collect()}
    assert left[1] is None and left[7] == left[8] == left[9] == "" and left[5] == "a"
    prints = {r.doc_id: r.n_chars for r in fingerprint.fingerprint_edits(awkward).collect()}
    assert prints[1] == 0 and prints[11] == 500


def test_labels_never_use_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", learning.held(F.col("doc_id"), 5, 0).alias("h")).collect()}
    assert got == {i: crc(i, 5) == 0 for i in range(50)}


def test_simhash_joins_nothing_that_grows_through_the_driver(spark, monkeypatch):
    """No join of its tables is by broadcast, however small Spark takes them to be."""
    plans, store = [], common.stored

    def seen(df, *a, **b):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, *a, **b)

    monkeypatch.setattr(common, "stored", seen)
    texts = [f"a b c d e f g h {k // 3} i j k l m n o p" for k in range(60)]
    out = simhash.simhash_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("BroadcastHashJoin" in p for p in plans)
    assert all(r["component_id"] <= r["doc_id"] // 3 * 3 for r in out.collect())


def test_merged_transforms_give_memory_back(monkeypatch):
    """Workers of groups, which live on, give back what a group took."""
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    a = np.arange(4, dtype=np.int64)
    side = pa.array([b"ab"] * 4, pa.binary())
    four = pa.array(np.full(4, 2, np.int32))
    t = pa.table({"key": a // 4, "same": a, "left": side, "right": side, "around": four, "shift": pa.array(np.zeros(4, np.int32)), "root_key": a // 4, "root_same": a})
    assert suffix_dedup._by_transform(t, np.uint8).num_rows == 4 and done


@pytest.mark.parametrize("unit", [suffix_dedup.of_bytes(400), suffix_dedup.of_words(51)])
def test_workers_let_go_of_what_they_cut_out(spark, unit):
    """What is around repeated cores is cut out by workers that live on: none of it stays in them."""
    rng = np.random.default_rng(7)
    word = [f"w{k:04d}" for k in range(3000)]
    shared = [" ".join(rng.choice(word, 120)) for _ in range(20)]
    rows = [(k, " ".join([*rng.choice(word, 40), shared[k % 20], *rng.choice(word, 40)])) for k in range(200)]

    def views(batches):
        for b in batches:
            held = sum(isinstance(x, memoryview) for x in gc.get_objects())
            time.sleep(0.2)  # so that each worker gets a task
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64())], names=["held"])

    def most():
        return max(r.held for r in spark.range(0, 8, 1, 8).mapInArrow(views, "held long").collect())

    before = most()
    assert suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc long, text string"), unit).count() == 200
    assert most() < before + 50
