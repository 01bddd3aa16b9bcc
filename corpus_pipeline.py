"""The corpus pipeline: toxic documents, near copies, repeated passages and benchmark copies go; the rest is packed.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.llm import common, decontam, packing, shingle_join, suffix_dedup, toxicity
from stridewell.llm.queries import tokenizer_spec

#: Rows that may be broadcast by their number (8 bytes each), after counting them; more are joined by shuffle.
MOST_BROADCAST = 500_000
#: Bytes that packing tokenizes at once, and words that it keeps: few, as what earlier stages used is still held by executors.
PACKED_AT_ONCE, WORDS_KEPT = 1 << 20, 60_000
#: Words of the shortest passage that goes: "over 50".
PASSAGE = 51


def _without(rows: DataFrame, key: str, gone: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` of the rows whose number `key` is not among those in gone's column of that name."""
    gone = common.stored(gone.select(key).distinct(), "dropped")
    return rows.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, key, "left_anti").select(names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.7; it learns from all labelled ones.

    A null or empty text is scored as one without terms; every row of a repeated id has its own score. An empty table
    gives an empty one. Columns pass on whatever their names.
    """
    labels = common.plain(common.table(spark, sf_dir, "labels"), doc_id="doc_id", label="toxic")
    model = toxicity.toxicity_model(common.plain(docs, doc_id="doc_id", text="text"), labels)
    score = common.fresh(docs, "toxicity_score")
    return toxicity.toxicity_scores(docs, model, out=score).where(F.col(score) < 0.7).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles: the one with the smallest id.

    Rows of a repeated or null id are rows of their own: of equal ones the first stays, others stay. Texts without words
    (null, empty) are in no group.
    """
    rows, key = common.keyed(docs)
    groups = shingle_join.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), k=5, num=4, den=5)
    return _without(rows, key, groups.where("component_id <> doc_id").select(F.col("doc_id").alias(key)), docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any run of over 50 words that occurs twice among them; n_chars follows the text.

    No row goes, also where nothing of its text is left. A null text stays null and keeps its n_chars.
    """
    out = suffix_dedup.cut_repeats(docs, suffix_dedup.of_words(PASSAGE))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited; of a repeated id only the rows that hold one go."""
    rows, key = common.keyed(docs)
    found = decontam.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    return _without(rows, key, found.select(F.col("doc_id").alias(key)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 tokens, with their ids."""
    return packing.pack_documents(docs, tokenizer_spec(), block=PACKED_AT_ONCE, most_kept=WORDS_KEPT)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]
#: None: the stages have no form in SQL; tests/llm hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
