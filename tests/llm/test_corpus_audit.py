"""Source divergence, spelling variants and SimHash against brute force, SQL and awkward tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

from stridewell.llm import common, divergence, queries, simhash, spelling


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents").toPandas()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows and ids, names that clash with the operators' own."""
    base = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}lang" for i in range(200))
    long = " ".join(f"langeswort{chr(97 + i % 11)}" for i in range(40_000))
    rows = [
        (1, None, None, None), (2, "", "en", ""), (3, " \n ", "en", "a"), (4, long, "de", "a"), (5, base, "de", "b"), (5, base, "de", "b"), (6, base + " mehr", None, "b"),
        (None, base, "de", None), (None, None, None, None), (7, "x" * 30_000, "en", "a"), (8, "Übungen ÀÉ übungen Übungen übungen", "de", "c"), (9, "one two", "en", "b"), (10, "one two", "en", "a"), (11, "ONE\x0btwo three", "en", "b"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"word": F.lit("x"), "n": F.lit(1.5), "fp": F.col("doc_id"), "term": F.lit(None).cast("string"), "key": F.lit(3), "rank": F.lit("r")})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


# source divergence ---------------------------------------------------------------------------------------------------
def _divergence(rows, least=3, top=200):
    """rows: (lang, source, text)."""
    docs = [(g or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))) for g, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        v = len(kept)
        sources = sorted({d[1] for d in mine})

        def shares(of):
            c = collections.Counter(t for d in of for t in d[2])
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}, c

        p = {s: shares([d for d in mine if d[1] == s]) for s in sources}
        q = shares(mine)[0]
        for s in sources:
            pairs = [(-sum((p[s][0][t] - p[o][0][t]) ** 2 // p[o][0][t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][0][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if p[s][1][t] and p[s][0][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)]
    return sorted(out, key=str)


def test_op11(spark, sf, docs):
    out = queries.op11_source_divergence(spark, sf)
    assert oracle.differences(out, oracle.connect(sf), queries.ORACLES["op11_source_divergence"]) == []
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert got(out) == _divergence(docs[["lang", "source", "text"]].itertuples(index=False))


@pytest.mark.parametrize(("counted", "shard"), [(1 << 17, 8 << 20), (40, 300)])
def test_divergence_of_unlike_sources(spark, monkeypatch, counted, shard):
    """A source with most rows, sources without kept terms, ties in value, terms outside ASCII, small shards."""
    monkeypatch.setattr(divergence, "COUNTED", counted)
    monkeypatch.setattr(divergence, "SHARD_BYTES", shard)
    rng = random.Random(3)
    terms = ["Alpha", "beta", "gamma", "ÉTÉ", "straße", "日本", "\U0001f600", "delta", "ab", "x"]
    rows = [("en", "big", " ".join(rng.choices(terms, k=rng.randint(0, 12)))) for _ in range(120)]
    rows += [("en", f"s{k}", " ".join(rng.choices(terms[: k + 1], k=5))) for k in range(9)] + [("en", "none", "unseen"), ("en", None, None), ("fr", "lonely", "mot"), ("fr", "b", "autre"), (None, "big", "alpha alpha"), (None, "c", "alpha"), (None, "d", "alpha_alpha-Alpha")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert got(divergence.source_divergence(df, top=4)) == _divergence(rows, top=4)
    assert got(divergence.source_divergence(df, least=1)) == _divergence(rows, least=1)


def test_divergence_awkward(spark, awkward, empty):
    out = divergence.source_divergence(awkward)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(out) == _divergence([(r["lang"], r["source"], r["text"]) for r in awkward.collect()])
    assert divergence.source_divergence(empty).count() == 0


# spelling variants ---------------------------------------------------------------------------------------------------
def _edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _forms(rows):
    """rows: (doc_id, text)."""
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = sorted(w for w in n if len(w) >= 7 and n[w] >= 2)
    near = collections.defaultdict(set)
    by = collections.defaultdict(set)
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[key].add(w)
    for same in by.values():
        for a, b in itertools.permutations(same, 2):
            if _edit(a, b):
                near[a].add(b)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


FORMS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_op12(spark, sf, docs):
    out = queries.op12_spelling_variants(spark, sf)
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert got(out, *FORMS) == _forms(docs[["doc_id", "text"]].itertuples(index=False))
    assert out.where("form is not null").count() > 0


def _vocabulary(kind):
    rng = random.Random(5)
    if kind == "short":  # over a small alphabet most words have many near ones, lengths are at the bound
        return ["".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(200)]
    if kind == "prefix":  # nearly all words share their first ten letters
        return ["gemeinsame" + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 4))) for _ in range(200)] + ["emeinsame", "gemeinsam", "gemeinsames"]
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(7, 30))) for _ in range(40)]
    return words + [w[:i] + x + w[i + y :] for w in words for i in range(0, len(w) + 1, 2) for x, y in (("", 1), ("z", 0), ("z", 1))]


@pytest.mark.parametrize(("kind", "size"), [("short", 8), ("prefix", 8), ("edits", 8), ("short", 16384)])
def test_tries_hold_every_pair(spark, kind, size):
    words = [w for w in dict.fromkeys(_vocabulary(kind)) if len(w) >= 7]
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    found = [(r["word"], r["near"]) for r in spelling.near_words(df, size).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if _edit(a, b)}


def test_forms_follow_each_other(spark):
    rows = [(1, " ".join(["aaaaaaaa"] * 4000 + ["aaaaaaab"] * 300 + ["aaaaaabb"] * 25 + ["aaaaabbb"] * 2 + ["aaaabbbb"] * 2)), (2, "zzzzzzzz " * 20 + "zzzzzzzy " * 2), (3, "qqqqqqqa " * 40 + "qqqqqqqb " * 40 + "qqqqqqqc " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.spelling_forms(df), *FORMS) == _forms(rows)
    roots = {r["word"]: r["root"] for r in spelling.spelling_forms(df).collect()}
    assert roots["aaaaabbb"] == "aaaaaaaa" and roots["qqqqqqqc"] == "qqqqqqqa" and roots["aaaabbbb"] == "aaaabbbb"


def test_spelling_awkward(awkward, empty, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(spelling.spelling_forms(awkward), *FORMS) == _forms(rows)
    monkeypatch.setattr(spelling, "COUNTED", 3)
    assert got(spelling.spelling_forms(awkward, size=2), *FORMS) == _forms(rows)
    assert spelling.spelling_forms(empty).count() == 0


# simhash -------------------------------------------------------------------------------------------------------------
def _fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _joined(words, most):
    """The smallest index of each component."""
    root = list(range(len(words)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(words)), 2):
        if (words[i] ^ words[j]).bit_count() <= most and (a := top(i)) != (b := top(j)):
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(words))]


def test_op13(spark, sf, docs):
    out = queries.op13_simhash(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    rows = sorted(docs[["doc_id", "text"]].itertuples(index=False))
    words = [_fingerprint(t) for _, t in rows]
    want = sorted(((int(i), f"{w:016x}", int(rows[k][0])) for (i, _), w, k in zip(rows, words, _joined(words, 4), strict=True)), key=str)
    assert got(out, "doc_id", "fingerprint", "component_id") == want


def _words(kind, n=160):
    rng = random.Random(11)
    if kind == "far":
        return [rng.getrandbits(64) for _ in range(n)]
    if kind == "ball":  # near copies of one text
        base = rng.getrandbits(64)
        return [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))) for _ in range(n)]
    if kind == "apart":  # all agree in most bits, few are within four: only those of another half
        return [sum(1 << b for b in rng.sample(range(20), 8)) for _ in range(n)]
    out = [rng.getrandbits(64)]
    while len(out) < n:  # chains
        out.append(out[-1] ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4, 4, 5]))))
    return out


@pytest.mark.parametrize(("kind", "rows", "probe"), [("far", 4096, 64), ("ball", 4096, 64), ("chain", 4096, 0.001), ("ball", 24, 64), ("apart", 24, 64)])
def test_every_link_is_found(spark, monkeypatch, kind, rows, probe):
    """Also where keys are large, and where probes are so cheap that few wide parts are best."""
    monkeypatch.setattr(simhash, "KEY_ROWS", rows)
    monkeypatch.setattr(simhash, "PROBE", probe)
    monkeypatch.setattr(simhash, "PAIRS", 100)
    words = sorted(set(_words(kind)))
    fps = spark.createDataFrame([(w - (w >> 63 << 64), 1) for w in words], "fp long, copies long")
    bits = np.array(words, np.uint64)
    chunks = simhash.chunks_of(simhash._together(bits).astype(float), len(words))
    assert sorted(itertools.chain(*chunks)) == list(range(64))
    plan = simhash.allocate(simhash.distances(simhash._cells(bits, chunks).astype(float)), len(words), 4)
    assert sum(t + 1 for _, t in plan) > 4
    found = simhash.links(fps, simhash.masks_of(chunks, plan), len(words), 4, [])
    at = {w: i for i, w in enumerate(words)}
    pairs = [(at[r["a"] % 2**64], at[r["b"] % 2**64]) for r in found.collect()]
    assert all((words[a] ^ words[b]).bit_count() <= 4 for a, b in pairs)
    root = list(range(len(words)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    assert [top(i) for i in range(len(words))] == _joined(words, 4)


def test_bits_that_go_together_share_a_chunk():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (4000, 64), np.uint8)
    bits[:, [3, 17, 40]] = bits[:, [60]]
    words = np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    chunks = simhash.chunks_of(simhash._together(words).astype(float), len(words))
    assert any({3, 17, 40, 60} <= set(c) for c in chunks)
    apart = simhash.distances(simhash._cells(words, chunks).astype(float))
    assert np.allclose(apart.sum(1), 1)
    # the chunk of bits that go together tells less apart, so that it is asked for fewer differing bits than others
    plan = simhash.allocate(apart, 10**7, 4)
    assert sum(t + 1 for _, t in plan) == 5


def test_simhash_awkward(awkward, empty, monkeypatch):
    out = simhash.simhash_components(awkward)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    rows = [(r["doc_id"], _fingerprint(r["text"])) for r in awkward.collect()]
    root = _joined([w for _, w in rows], 4)
    ids = {k: min((i for (i, _), r in zip(rows, root, strict=True) if r == k and i is not None), default=None) for k in root}
    want = sorted(((i, f"{w:016x}", ids[k]) for (i, w), k in zip(rows, root, strict=True)), key=str)
    assert got(out) == want
    assert simhash.simhash_components(empty).count() == 0
    monkeypatch.setattr(simhash, "HASHES", 7)
    assert got(simhash.simhash_components(awkward)) == want
