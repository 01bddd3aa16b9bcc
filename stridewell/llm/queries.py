"""The queries of this subpackage: thin wrappers that give each operator its whole table."""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, context_mixing, decontam, divergence, fingerprint, html_extract, langid, learning, packing, quality, shingle_join, simhash, spelling, suffix_dedup, toxicity

LOG2_10 = math.log2(10)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(common.table(spark, sf_dir, "documents"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.plain(common.table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    labels = common.plain(common.table(spark, sf_dir, "labels"), doc_id="doc_id", label="quality")
    weights = quality.quality_model(docs, labels.where(~learning.held(F.col("doc_id"), 5, 0)))
    out = quality.quality_scores(docs, weights)
    return out.select("doc_id", learning.held(F.col("doc_id"), 5, 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    labels = common.plain(common.table(spark, sf_dir, "labels"), doc_id="doc_id", label="toxic")
    model = toxicity.toxicity_model(docs, labels.where(~learning.held(F.col("doc_id"), 3, 1)))
    out = toxicity.toxicity_scores(docs, model)
    return out.select("doc_id", learning.held(F.col("doc_id"), 3, 1).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.7).cast("int").alias("predicted"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(common.table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.plain(common.table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    model = langid.language_model(docs.where(~learning.held(F.col("doc_id"), 4, 2)))
    out = langid.languages(docs, model)
    return out.select("doc_id", learning.held(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measure_repeats(common.table(spark, sf_dir, "documents"), length=400, passage=51)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(common.table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir).withColumn("held", learning.held(F.col("doc_id"), 10, 0))
    out = context_mixing.mixing_scores(docs)
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * LOG2_10 / F.col("n_bytes"))).drop("n_bytes")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokenizer_spec(), keep_ids=False).drop("ids")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(common.table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(common.table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(common.table(spark, sf_dir, "documents"))


def tokenizer_spec(path: str | None = None) -> str:
    """A tokenizer's JSON; by default the public one that the packing query names."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language_id": op6_language_id,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_simhash": op13_simhash,
}
OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
o AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0)::BIGINT + v.v) AS p
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
l AS (
    SELECT lang, term, 1 + (1000000000 * (sum(c)::BIGINT + 1)) // (any_value(t.n)::BIGINT + any_value(v.v)) AS p
    FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY ALL) t USING (lang) GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN found f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - l.p) * (p.p - l.p)) // l.p AS value
    FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE p.c > 0 AND p.p > l.p)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
#: The other methods have no form in SQL; tests/llm hold them against brute force, round trips or held-out labels.
ORACLES: dict[str, str] = {"op11_source_divergence": OP11_SQL}
