"""Source divergence audit: how the terms of each source of a language depart from other sources and from the language.

Workers count terms batch by batch. Counts are dealt to shards by language and term; DuckDB takes a shard as a stream of
Arrow batches and aggregates it with SQL: first it keeps the terms of enough documents, then, with totals known, it sums
over each pair of sources what their common terms add, ranks terms of a source within the shard, and tells how many
terms of a source have each count. Spark merges sums and ranks. Terms that a source lacks all have the same share there,
so of these the numbers of terms by count say all: no shard writes a row for a term that does not occur.

All numbers are integers; sums that may exceed 64 bits before terms cancel are decimals of 38 digits.

Defined results: null text, language and source are ''; every row is a document, whatever its id; a language without kept
terms has its pairs with value 0, and no terms.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The letters of a term (A-Z have become a-z), and the scale of shares.
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCALE = 1_000_000_000
#: Different terms that a worker counts at once, bytes of text for each shard, rows of a batch that DuckDB gives.
COUNTED, SHARD_BYTES, OUT_ROWS = 1 << 17, 8 << 20, 1 << 15
#: Groups (lang, source) that may be broadcast, after counting them; more are joined by shuffle.
MOST_BROADCAST = 10_000

COUNTS = "lang string, source string, term string, c long, d long"
KEPT = "lang string, source string, term string, c long"
FOUND = "kind string, lang string, source string, item string, value long, q long"


def _count(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), d (documents), with a row or a few for each task."""
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def batch(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (c, d) in counts.items():
            n = len(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64()), pa.array([d[t] for t in c], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(lambda: (Counter(), Counter()))
        held = 0
        for b in batches:
            data, offsets = common.utf8(b.column(2))
            for lang, source, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                terms = Counter(TERM.findall(data[i:j].tobytes().lower().decode("utf-8", "replace")))
                c, d = counts[lang, source]
                held -= len(c)
                c.update(terms)
                d.update(terms.keys())
                held += len(c)
                if held >= COUNTED:
                    yield from batch(counts)
                    counts.clear()
                    held = 0
        yield from batch(counts)

    return docs.mapInArrow(common.trimmed(run), COUNTS)


def _by_shard(rows: DataFrame, shards: int, statements: list[str], out: str) -> DataFrame:
    """DuckDB's last statement over each shard (by lang and term) of rows, which is the relation `shard`, read once."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        def stream() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with tempfile.TemporaryDirectory() as spilled, duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": spilled}) as con:
            con.register("shard", pa.RecordBatchReader.from_batches(first.schema, stream()))
            for s in statements[:-1]:
                con.execute(s)
            for b in con.execute(statements[-1]).to_arrow_reader(OUT_ROWS):
                yield pa.RecordBatch.from_arrays([b.column(n).cast(pa.int64() if t == "long" else pa.string()) for n, t in zip(names, (x.split()[1] for x in out.split(", ")), strict=True)], names=names)

    return rows.repartition(shards, "lang", "term").mapInArrow(common.trimmed(run), out)


#: A row for each term and source, and one with source null for the language, of the terms of enough documents.
KEEP = """
    WITH s AS (SELECT lang, source, term, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM shard GROUP BY ALL),
         t AS (SELECT lang, term, sum(c)::BIGINT AS c FROM s GROUP BY ALL HAVING sum(d) >= {least})
    SELECT s.lang, s.source, s.term, s.c FROM s JOIN t USING (lang, term)
    UNION ALL SELECT lang, NULL, term, c FROM t
"""

#: p: share of the term here, z: of a term that does not occur; n, v are the group's. f is `divergence`.
SHARES = """
    CREATE TABLE e AS SELECT lang, source, term, c, {p} AS p, {z} AS z FROM shard
"""
RESULTS = """
    SELECT 'both' AS kind, a.lang, a.source, b.source AS item,
           sum({pp}::HUGEINT - {pz} - {zp} + {zz})::BIGINT AS value, NULL::BIGINT AS q
    FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    UNION ALL
    SELECT 'times', lang, source, NULL, c, count(*) FROM e WHERE source IS NOT NULL GROUP BY ALL
    UNION ALL
    SELECT 'term', a.lang, a.source, a.term, {pp}, NULL
    FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source IS NOT NULL AND b.source IS NULL WHERE a.p > b.p
    QUALIFY row_number() OVER (PARTITION BY a.lang, a.source ORDER BY {pp} DESC, a.term) <= {top}
"""


def divergence(p: str, q: str, div: str) -> str:
    """floor((p - q)**2 / q) in SQL; div is the operator of integer division."""
    return f"((({p} - {q}) * ({p} - {q})) {div} {q})"


def share(c: str, n: str, v: str, div: str) -> str:
    return f"(1 + ({SCALE} * ({c} + 1)) {div} ({n} + {v}))"


def _joined(rows: DataFrame, groups: DataFrame, few: bool, on: list[Column]) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, on)


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: see the contract of op11; least: documents of a term, top: terms of a source."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held: list[str] = []
    src = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"), docs[text].alias("text"))
    shards = max(1, -(-common.input_bytes(src)[1] // SHARD_BYTES))
    kept = common.stored(_by_shard(_count(src), shards, [KEEP.format(least=least)], KEPT), "kept")

    # groups that occur, also those without kept terms: n occurrences, v terms of the language; source null: the language
    seen = src.select("lang", "source").distinct()
    seen = seen.union(seen.select("lang", F.lit(None).cast("string")).distinct())
    totals = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    langs = totals.where("source is null").select("lang", F.col("k").alias("v"))
    groups = seen.alias("s").join(totals.alias("t"), (F.col("s.lang") == F.col("t.lang")) & F.col("s.source").eqNullSafe(F.col("t.source")), "left")
    groups = groups.select("s.lang", "s.source", F.coalesce("n", F.lit(0)).alias("n")).join(langs, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    groups = common.stored(groups, "groups")
    few = groups.count() <= MOST_BROADCAST

    named = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "n", "v")
    marked = _joined(kept, named, few, [F.col("lang") == F.col("l"), F.col("source").eqNullSafe(F.col("s"))]).select("lang", "source", "term", "c", "n", "v")
    forms = {f"{x}{y}": divergence(f"a.{x}", f"b.{y}", "//") for x in "pz" for y in "pz"}
    shares = SHARES.format(p=share("c", "n", "v", "//"), z=share("0", "n", "v", "//"))
    found = common.stored(_by_shard(marked, shards, [shares, RESULTS.format(top=top, **forms)], FOUND), "found", held)

    # a pair's terms that only one of both has, by how many have each count, and those that neither has
    wide = "decimal(38,0)"
    here = groups.where("source is not null").select("lang", "source", "v", F.expr(f"if(v = 0, 1, {share('0', 'n', 'v', 'div')})").alias("z"))
    other = here.select("lang", F.col("source").alias("item"), F.col("z").alias("zi"))
    times = found.where("kind = 'times'").groupBy("lang", "source", F.col("value").alias("c")).agg(F.sum("q").alias("k"))
    times = _joined(times, named, few, [F.col("lang") == F.col("l"), F.col("source") == F.col("s")]).select("lang", "source", "k", F.expr(share("c", "n", "v", "div")).alias("p"), F.expr(share("0", "n", "v", "div")).alias("z"))
    both_ways = times.join(other, "lang").where("source <> item")
    none = divergence("z", "zi", "div"), divergence("zi", "z", "div")
    ahead = both_ways.select("lang", "source", "item", F.expr(f"cast(k as {wide}) * ({divergence('p', 'zi', 'div')} - {none[0]})").cast(wide).alias("value"))
    behind = both_ways.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"cast(k as {wide}) * ({divergence('zi', 'p', 'div')} - {none[1]})").cast(wide).alias("value"))
    base = here.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"cast(v as {wide}) * {none[0]}").cast(wide).alias("value"))
    both = found.where("kind = 'both'").select("lang", "source", "item", F.col("value").cast(wide).alias("value"))
    pairs = base.union(ahead).union(behind).union(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = found.where("kind = 'term'").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).union(terms.select(columns))
