"""Sinks: re-keyed episodes, JSON lines and documents, CSV, statistics files, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling


def write_episodes(frames: DataFrame, path: str, episode: str = "episode_index", chunk: int = 1000) -> None:
    """Frames as parquet, a directory for each chunk of episodes."""
    frames.withColumn("chunk", F.floor(F.col(episode) / chunk).cast("long")).repartition("chunk", episode).sortWithinPartitions(episode).write.mode("overwrite").partitionBy("chunk").parquet(path)


def rekeyed(frames: DataFrame, episodes: DataFrame, episode: str, order: list[str], step: str) -> DataFrame:
    """Frames under new episode numbers, with an index over all of them, ready to be written."""
    out = sampling.rekey(frames, episodes, episode, order, step)
    return out.drop(episode).withColumnRenamed("new_episode", episode)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def statistics_document(stats: DataFrame, tag: str, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """tag, json: for each tag the keys' statistics as vectors in order, as JSON."""
    from ..operators.vectors import ordered_concat

    parts = ordered_concat(stats, [tag, key], order, columns)
    each = parts.groupBy(tag).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, F.struct(*columns))))).alias("_m"))
    return each.select(tag, F.to_json("_m").alias("json"))


def manifest(episodes: DataFrame, success: str, length: str) -> DataFrame:
    """One row of counts: episodes and frames of either kind, and the ratio of frames."""
    ok = F.col(success)
    out = episodes.agg(
        F.count(F.lit(1)).alias("episodes"), F.sum(ok.cast("long")).alias("success_episodes"), F.sum((~ok).cast("long")).alias("failure_episodes"),
        F.sum(F.when(ok, F.col(length)).otherwise(0)).alias("success_frames"), F.sum(F.when(~ok, F.col(length)).otherwise(0)).alias("failure_frames"),
    )
    return out.withColumn("ratio", F.when(F.col("success_frames") > 0, F.col("failure_frames") / F.col("success_frames")))


def info(episodes: DataFrame, length: str, chunk: int) -> DataFrame:
    """One row: totals, chunks (rounded up), and the split 'train' as '0:n'."""
    n = F.count(F.lit(1))
    return episodes.agg(n.alias("total_episodes"), F.sum(length).alias("total_frames"), F.ceil(n / F.lit(chunk)).cast("long").alias("total_chunks"), F.concat(F.lit("0:"), n.cast("string")).alias("train"))
