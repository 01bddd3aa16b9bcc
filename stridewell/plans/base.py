"""Stand-ins: the driver's tables as episodes, tasks and vectors, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that gives the same rows; without SQL, tests hold it against something else."""
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, column: str):
    """Microseconds since 1970, whatever the session's time zone."""
    if df.schema[column].dataType.simpleString() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")
    return F.unix_micros(column)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of an episode for each user: episode, step, event_id, event_type, value, us, props."""
    df = table(spark, sf_dir, "events")
    df = df.select(F.col("user_id").alias("episode"), "event_id", "event_type", "value", "ts", micros(df, "ts").alias("us"), "props")
    return steps.number_steps(df, "episode", ["ts", "event_id"]).drop("ts")


def episodes(ev: DataFrame) -> DataFrame:
    """episode, length, task (the last event's type) and success (it is no error)."""
    last = F.max_by("event_type", "step")
    return ev.groupBy("episode").agg(F.count(F.lit(1)).alias("length"), last.alias("task")).withColumn("success", F.col("task") != "error")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with length, task and success of their episode, over the windows that number them."""
    whole = Window.partitionBy("episode")
    df = frames(spark, sf_dir).withColumns({"length": F.count(F.lit(1)).over(whole), "task": F.max_by("event_type", "step").over(whole)})
    return df.withColumn("success", F.col("task") != "error")


EV = """ev AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_id, event_type, value, epoch_us(ts) AS us, props FROM events),
epi AS (SELECT episode, count(*) AS length, arg_max(event_type, step) AS task, arg_max(event_type, step) <> 'error' AS success FROM ev GROUP BY episode),
lab AS (SELECT ev.*, epi.length, epi.task, epi.success FROM ev JOIN epi USING (episode))"""

VEC = """vec AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
st AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM vec GROUP BY dim)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v (array of doubles)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def r6(column, name: str):
    return F.round(column, 6).alias(name)
