"""Queries through files: each writes what Spark derives from a table to the shared folder, and reads it back.

Sources and sinks are thus exercised as a user has them: JSON lines, documents of any size, CSV, discovery, conversations,
file health, results kept by configuration.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import returns, sampling, steps
from ..sources import cache, documents, readers, rollouts, writers
from ..sources.shared import shared_dir
from .base import EV, episodes, frames, labelled, query, r6, table


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query("s3_blank_lines", "SELECT o_orderkey AS task_index, o_orderpriority AS task FROM orders WHERE o_orderkey % 4 <> 0")
def _(spark, sf):
    """JSON lines among blank ones."""
    at = _folder(spark, "lines")
    line = F.when(F.col("o_orderkey") % 4 != 0, F.to_json(F.struct(F.col("o_orderkey").alias("task_index"), F.col("o_orderpriority").alias("task")))).otherwise(F.lit("  "))
    table(spark, sf, "orders").select(line).write.text(at)
    return readers.json_lines(spark, at, "task_index long, task string")


@query("k2_json_lines", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    at = _folder(spark, "lines")
    writers.write_json_lines(table(spark, sf, "customer").select("c_custkey", "c_name"), at)
    return readers.json_lines(spark, at, "c_custkey long, c_name string")


@query("k4_csv_rows", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, sf):
    at = _folder(spark, "csv")
    writers.write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), at)
    return spark.read.option("header", "true").schema("s_suppkey long, s_name string, s_acctbal double").csv(at)


def _returns(spark, sf):
    df = returns.return_to_go(labelled(spark, sf), "episode", "success", 10.0)
    return df.select("episode", "step", F.col("return_to_go").alias("g"), F.to_json(F.struct("task", F.array(F.struct("event_type")).alias("seen"))).alias("note"))


@query("s5_incremental_json", f"WITH {EV}, g AS (SELECT episode, step, -((max(step) OVER (PARTITION BY episode)) - step) + CASE WHEN success THEN 0.0 ELSE -10.0 END AS g, task, event_type FROM lab) SELECT episode, step, CAST(g AS DOUBLE) AS g, '{{\"task\":\"' || task || '\",\"seen\":[{{\"event_type\":\"' || event_type || '\"}}]}}' AS note, 5 AS n_step, CAST(0.99 AS DOUBLE) AS gamma FROM g")
def _(spark, sf):
    """A document with every frame's return, written by ranges and read by byte ranges; notes hold braces and quotes."""
    at = _folder(spark, "document")
    documents.write_document(_returns(spark, sf), at, "advantages", ["episode", "step"], n_step=5, gamma=0.99)
    rows, fields = documents.records(spark, at, "advantages", "episode long, step long, g double, note string")
    return rows.drop("_range", "_place").withColumns({k: F.lit(fields[k]) for k in ("n_step", "gamma")})


@query("k3_json_document", f"WITH {EV} SELECT 'returns' AS name, count(*) AS entries, max(length) AS longest FROM epi")
def _(spark, sf):
    at = _folder(spark, "document")
    documents.write_document(episodes(frames(spark, sf)).select("episode", "length"), at, "episodes", ["episode"], name="returns")
    rows, fields = documents.records(spark, at, "episodes", "episode long, length long")
    return rows.agg(F.lit(fields["name"]).alias("name"), F.count(F.lit(1)).alias("entries"), F.max("length").alias("longest"))


@query("s7_dataset_discovery", "SELECT 'set' || (s_nationkey % 5) AS name, CAST(1.0 AS DOUBLE) AS weight FROM supplier WHERE s_nationkey % 5 < 3 GROUP BY 1")
def _(spark, sf):
    """Folders with data and metadata are data sets; those that lack either are not."""
    root = _folder(spark, "sets")
    rows = table(spark, sf, "supplier").withColumn("set", (F.col("s_nationkey") % 5).cast("int"))
    for r in rows.select("set").distinct().orderBy("set").collect():  # at most five
        own = rows.where(F.col("set") == r["set"]).drop("set")
        if r["set"] != 3:
            own.write.parquet(f"{root}/set{r['set']}/data/chunk-000")
        if r["set"] != 4:
            own.agg(F.count(F.lit(1)).alias("rows")).select(F.to_json(F.struct("rows"))).write.text(f"{root}/set{r['set']}/meta/modality.json")
    found = readers.data_sets(spark, root)
    return found.select(tx.base_name(F.col("dataset")).alias("name"), F.lit(1.0).alias("weight"))


@query("s10_conversation_sources", "SELECT conv_id, count(*) AS turns, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS data_path FROM conversations GROUP BY conv_id")
def _(spark, sf):
    """Half of the conversations as JSON arrays, half as JSON lines."""
    root = _folder(spark, "talks")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    arrays = c.where("conv_id % 2 = 0").groupBy(F.floor(F.col("conv_id") / 1000)).agg(F.to_json(F.collect_list(F.struct("conv_id", "turns"))).alias("text"))
    arrays.select("text").write.option("maxRecordsPerFile", 1).text(f"{root}/a.json")
    c.where("conv_id % 2 = 1").write.json(f"{root}/b.jsonl")
    read = readers.conversations(spark, {f"{root}/a.json": "a", f"{root}/b.jsonl": "b"})
    return read.select("conv_id", F.size("turns").cast("long").alias("turns"), "data_path")


#: What befalls the file of a user on a day, by the user's number: nothing of it is written, no bytes, or not all rows.
FATES = "CASE user_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'truncated' ELSE 'ok' END"


@query("f12_file_health", f"WITH u AS (SELECT user_id // 10 AS user_id, event_id FROM events) SELECT user_id, count(*) AS rows, CASE WHEN count(*) = 1 AND {FATES} = 'truncated' THEN 'missing' ELSE {FATES} END AS state FROM u GROUP BY user_id")
def _(spark, sf):
    """A file for ten users; some were never written, some have no bytes, some lost their last row."""
    root = _folder(spark, "health")
    rows = table(spark, sf, "events").withColumn("user_id", F.expr("user_id div 10"))
    user = F.concat(F.lit("u"), F.coalesce(F.col("user_id").cast("string"), F.lit("none"))).alias("user")
    rows = rows.select("user_id", user, "event_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("line"), F.expr(FATES).alias("fate"))
    whole = rows.groupBy("user_id", "user", "fate").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    back = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("event_id")))
    kept = rows.where("fate in ('ok', 'truncated')").withColumn("back", back).where("fate = 'ok' or back > 1")
    kept.select("user", "line").write.partitionBy("user").text(root)
    # Spark names the files; what is wanted is known by folder
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.regexp_extract("path", r"/user=(u-?\w+)/", 1).alias("user"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in whole.where("fate = 'empty'").select("user").toLocalIterator():
        fs.create(hadoop(f"{root}/user={r['user']}/empty.txt")).close()
    wanted = whole.join(names, "user", "left").select("user_id", "rows", "bytes", F.coalesce("path", F.concat(F.lit(f"{root}/user="), F.col("user"), F.lit("/empty.txt"))).alias("path"))
    return readers.health(spark, wanted, "path", root, "bytes").select("user_id", "rows", "state")


@query("s8_rollouts", f"WITH {EV} SELECT episode, step AS frame, round(value, 3) AS s0, CAST(step % 5 AS DOUBLE) AS s1, CAST(event_id % 1000 AS DOUBLE) AS a0, success, false AS broken FROM lab WHERE episode % 7 <> 3 UNION ALL SELECT episode, NULL, NULL, NULL, NULL, NULL, true FROM epi WHERE episode % 7 = 3")
def _(spark, sf):
    """Episodes as pickled rollouts, many to a file; the length that some of them state is not that of their rows."""
    root = _folder(spark, "rollouts")
    lab = labelled(spark, sf).where("episode is not null").withColumns({"s1": F.col("step") % 5, "a0": F.col("event_id") % 1000, "a1": F.lit(1.0), "length": F.col("length") + (F.col("episode") % 7 == 3).cast("int")})
    rollouts.write_rollouts(lab.withColumn("run", F.concat(F.lit("e"), F.col("episode").cast("string"))), root, "run", "step", ["value", "s1"], ["a0", "a1"], ["length", "success"])
    read = rollouts.unpickle(spark.read.parquet(root), 2, errors="report").withColumn("episode", F.regexp_extract("path", r"^run=e(-?\d+)$", 1).cast("long"))
    s0 = F.nullif(F.round(F.col("state")[0].cast("double"), 3), F.lit(float("nan")))
    return read.select("episode", F.col("frame_index").alias("frame"), s0.alias("s0"), F.col("state")[1].cast("double").alias("s1"), F.col("action")[0].cast("double").alias("a0"), "success", F.col("problem").isNotNull().alias("broken"))


@query("s12_config_key", "SELECT l_returnflag || l_linestatus AS name, substring(md5('v2|stride=3|' || l_returnflag || l_linestatus), 1, 12) AS key FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    """The key of each configuration that a table names."""
    name = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf, "lineitem").select(name.alias("name")).distinct().select("name", tx.short_hash(F.concat(F.lit("v2|stride=3|"), F.col("name"))).alias("key"))


@query("s12_cached_steps", f"WITH {EV} SELECT episode, step, event_id, true AS reused FROM ev WHERE step % 3 = 0")
def _(spark, sf):
    """Strided steps, stored under settings and the state of their input: the second read finds what the first stored."""
    folder, config, inputs = _folder(spark, "cache"), {"stride": 3, "version": 2}, [f"{sf}/events.parquet"]

    def make():
        return steps.stride(frames(spark, sf), 3).select("episode", "step", "event_id")

    cache.cached(spark, folder, config, inputs, make)
    kept, reused = cache.cached(spark, folder, dict(reversed(config.items())), inputs, make)
    return kept.withColumn("reused", F.lit(reused))


@query("l9_bounded_sample", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (ORDER BY ('0x' || substring(md5('31|' || vec_id), 1, 15))::BIGINT, vec_id) AS r FROM embeddings) WHERE r <= 100")
def _(spark, sf):
    return sampling.sample(table(spark, sf, "embeddings").select("vec_id", "label"), ["vec_id"], 31, 100)


@query("l9_reservoir", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ('0x' || substring(md5('17|' || event_id), 1, 15))::BIGINT, event_id) AS r FROM events) WHERE r <= 25")
def _(spark, sf):
    """25 rows of each type."""
    return sampling.reservoir(table(spark, sf, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 17, 25)


@query("l9_return_quantiles", f"WITH {EV}, g AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ('0x' || substring(md5('5|' || event_id), 1, 15))::BIGINT, event_id) AS r FROM ev) SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM g WHERE r <= 400 GROUP BY event_type")
def _(spark, sf):
    """Quantiles of a reservoir, which is what one is for."""
    some = sampling.reservoir(frames(spark, sf).select("event_type", "event_id", "value"), ["event_type"], ["event_id"], 5, 400)
    return some.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("value", F.lit(0.5)), "median"))
