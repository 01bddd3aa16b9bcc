"""The corpus pipeline, stage by stage, against brute force on a small table of planted cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stridewell.llm import common, packing
from stridewell.llm.queries import tokenizer_spec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, sf):
    rng = np.random.default_rng(20)

    def prose(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n))

    bench = [r.text for r in common.table(spark, sf, "benchmark").orderBy("item_id").limit(5).collect()]
    passage = prose(70)
    base = prose(120)
    rows = [(i, prose(100)) for i in range(20)]
    rows += [(100, base), (101, base), (102, base + " tail"), (103, base.replace(base.split()[60], "changed"))]
    rows += [(200 + i, f"{prose(60)} {passage} {prose(60)}") for i in range(4)]
    rows += [(300 + i, f"{prose(50)} {b} {prose(50)}") for i, b in enumerate(bench)]
    rows += [(400, "the idiot and the moron said stupid trash to the loser scum of pathetic clown worthless " + prose(30)), (500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def without_repeats(texts, n):
    """Without each word of a run of n that occurs anywhere else too, and what stands before the next word."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "") for k, t in texts.items()}
    runs = {k: [tuple(x.strip() for x in w[i : i + n]) for i in range(len(w) - n + 1)] for k, w in words.items()}
    count = Counter(r for x in runs.values() for r in x)
    out = {}
    for k, t in texts.items():
        gone = {j for i, r in enumerate(runs[k]) if count[r] > 1 for j in range(i, i + n)}
        out[k] = t and t[: len(t) - len(t.lstrip())] + "".join(w for j, w in enumerate(words[k]) if j not in gone)
    return out


def test_stages(spark, sf, planted):
    everything = ids(planted)
    near = corpus_pipeline.drop_near_copies(spark, planted, sf)
    assert near.columns == COLUMNS and ids(near) == everything - {101, 102, 103}
    cut = corpus_pipeline.cut_repeated_passages(spark, common.stored(near, "near"), sf)
    left = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == COLUMNS and set(left) == ids(near)
    texts = {r.doc_id: r.text for r in planted.collect() if r.doc_id in left}
    assert {i: r.text for i, r in left.items()} == without_repeats(texts, 51)
    assert all(r.n_chars == len(r.text) for r in left.values() if r.text is not None) and left[500].text is None
    assert all(900 < left[200 + i].n_chars < 970 for i in range(4))
    clean = corpus_pipeline.drop_contaminated(spark, planted, sf)
    assert clean.columns == COLUMNS and ids(clean) == everything - {300, 301, 302, 303, 304}
    packed = corpus_pipeline.pack(spark, planted, sf)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).where("n <> d").count()
    assert tokens == 0 and ids(packed) == everything


STAGES = [f for _, f in corpus_pipeline.STAGES]


def test_awkward_rows(spark, sf):
    """Repeated and null ids, nulls, columns with names that stages use: each row has its own fate, all columns pass on."""
    rng = np.random.default_rng(3)

    def prose(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n))

    a, b, c, d, passage = prose(90), prose(90), prose(90), prose(90), prose(55)
    item = common.table(spark, sf, "benchmark").orderBy("item_id").first().text
    names = "doc_id long, text string, lang string, source string, n_chars long, toxicity_score string, component_id long, _row long, _spans_words long"
    made = lambda rows: spark.createDataFrame([(i, t, "en", None, len(t) if t is not None else None, "mine", 7, 8, 9) for i, t in rows], names)
    had = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    near = made([(1, a), (5, a + " tail"), (5, b), (6, c), (None, d), (None, d), (None, None), (7, None), (8, "")])
    want = [(1, a), (5, b), (6, c), (None, d), (None, None), (7, None), (8, "")]
    assert had(corpus_pipeline.drop_near_copies(spark, near, sf)) in (sorted(want, key=str), sorted([(5, a + " tail"), *want[1:]], key=str))
    cut = made([(1, f"{a} {passage}"), (1, f"{passage} {b}"), (None, c), (2, None), (3, "")])
    assert had(corpus_pipeline.cut_repeated_passages(spark, cut, sf)) == sorted([(1, f"{a} "), (1, b), (None, c), (2, None), (3, "")], key=str)
    leak = made([(1, f"{a} {item} {b}"), (1, c), (None, f"{item}"), (None, d), (2, None), (2, "")])
    assert had(corpus_pipeline.drop_contaminated(spark, leak, sf)) == sorted([(1, c), (None, d), (2, None), (2, "")], key=str)
    assert had(corpus_pipeline.drop_toxic(spark, leak, sf)) == had(leak)
    for stage in STAGES[:-1]:
        out = stage(spark, near, sf)
        assert out.columns == near.columns and {(r.toxicity_score, r.component_id, r._row, r._spans_words) for r in out.collect()} == {("mine", 7, 8, 9)}


def test_empty_tables(spark, sf, planted):
    for stage in STAGES:
        assert stage(spark, planted.limit(0), sf).count() == 0


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    kept = ids(corpus_pipeline.drop_toxic(spark, docs, sf))
    labels = {r.doc_id: r.toxic for r in common.table(spark, sf, "labels").collect()}
    clean = [i for i, t in labels.items() if not t]
    toxic = [i for i, t in labels.items() if t]
    assert np.mean([i in kept for i in clean]) > 0.98 and np.mean([i in kept for i in toxic]) < 0.2


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {packing.LENGTH}").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    assert tokenizer_spec()
