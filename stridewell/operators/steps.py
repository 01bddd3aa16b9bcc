"""Ordered steps of episodes: filters, strides, fixed-offset windows with padding, histories.

An episode is a group of rows with one key; its steps are ordered. Windows are partitioned by episode, so an episode is
the unit that one task holds; everything else is joined or aggregated across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def number_steps(df: DataFrame, episode: str, order: list[str], step: str = "step") -> DataFrame:
    """df with steps 0, 1, ... of each episode, in an order that must be total."""
    return df.withColumn(step, (F.row_number().over(Window.partitionBy(episode).orderBy(*order)) - 1).cast("long"))


def stride(df: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Rows whose step is a multiple of `every`; under 1 counts as 1."""
    return df.where(F.col(step) % max(1, int(every or 1)) == 0)


def annotated(df: DataFrame, index: str) -> DataFrame:
    """Rows whose annotation index is not negative (a null index is no annotation)."""
    return df.where(F.col(index) >= 0)


def with_language(df: DataFrame, episode: str, text: str, step: str = "step") -> DataFrame:
    """Rows of episodes that have a text at step 0."""
    valid = df.where((F.col(step) == 0) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")).select(episode)
    return df.join(valid, episode, "left_semi")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """df with the value of its key; an unknown key raises an error when it is read."""
    found = df.join(table.select(key, value, F.lit(True).alias("_found")), key, "left")
    checked = F.when(F.col("_found"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("unknown key: "), F.col(key).cast("string"))))
    return found.withColumn(value, checked).drop("_found")


def episode_texts(df: DataFrame, tasks: DataFrame, key: str, text: str) -> DataFrame:
    """df with the task's text: '' for a negative index; rows whose text is null are left out."""
    found = df.join(tasks.select(key, text), key, "left")
    return found.withColumn(text, F.when(F.col(key) < 0, F.lit("")).otherwise(F.col(text))).where(F.col(text).isNotNull())


def lengths_match(frames: DataFrame, episodes: DataFrame, episode: str, length: str = "length") -> DataFrame:
    """episode, length, rows, matches: whether metadata and frames agree."""
    counted = frames.groupBy(episode).agg(F.count(F.lit(1)).alias("rows"))
    return episodes.join(counted, episode, "left").select(episode, length, F.coalesce("rows", F.lit(0)).alias("rows"), (F.col(length) == F.coalesce("rows", F.lit(0))).alias("matches"))


def offset_windows(df: DataFrame, episode: str, value: str, offsets: list[int], pad: str = "first_last", step: str = "step") -> DataFrame:
    """episode, step, offset, value: of every step and offset, padded by the nearest step, by zero, or clamped.

    Steps must be 0, 1, ... without gaps. One join on (episode, step), whatever the number of offsets.
    """
    if pad not in ("first_last", "zero", "clamp"):
        raise ValueError(f"unknown padding: {pad}")
    ends = df.groupBy(episode).agg(F.max(step).alias("_last"))
    wanted = df.select(episode, step).join(ends, episode).withColumn("offset", F.explode(F.array(*[F.lit(int(d)) for d in offsets])))
    at = F.col(step) + F.col("offset")
    wanted = wanted.withColumn("_at", F.greatest(F.lit(0), F.least(F.col("_last"), at))).withColumn("_in", (at >= 0) & (at <= F.col("_last")))
    source = df.select(F.col(episode).alias("_e"), F.col(step).alias("_at2"), F.col(value).alias("_v"))
    joined = wanted.join(source, (F.col(episode) == F.col("_e")) & (F.col("_at") == F.col("_at2")))
    got = F.col("_v") if pad != "zero" else F.when(F.col("_in"), F.col("_v")).otherwise(F.lit(0).cast(df.schema[value].dataType))
    return joined.select(episode, step, F.col("offset").cast("long").alias("offset"), got.alias(value))


def history(df: DataFrame, episode: str, value: str, n: int, step: str = "step", every: int = 1) -> DataFrame:
    """df with an array of the last n values, oldest first, `every` steps apart; the first value fills what is missing."""
    w = Window.partitionBy(episode).orderBy(step)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    items = [F.when(F.lag(F.lit(1), k * every).over(w).isNull() & F.lit(k > 0), first).otherwise(F.lag(value, k * every).over(w) if k else F.col(value)) for k in range(n - 1, -1, -1)]
    return df.withColumn("history", F.array(*items))


def last_of(array: Column, deltas: list[int]) -> Column:
    """Elements of an array at (its last place) + delta, for deltas of 0 and less; null before its start."""
    return F.array(*[F.try_element_at(array, F.lit(d - 1)) for d in deltas])


def tiles(df: DataFrame, horizon: int, step: str = "step") -> DataFrame:
    """df with the chunk a step falls in, and its place in it."""
    return df.withColumn("chunk", F.floor(F.col(step) / horizon).cast("long")).withColumn("place", (F.col(step) % horizon).cast("long"))


def moving_average(df: DataFrame, value: str, order: list[str], by: list[str], size: int = 100) -> DataFrame:
    """df with the mean of the last `size` values; rows that have fewer are left out, and groups of no more than size.

    The order must be total. A group is cut into segments, so that it is not one task's work.
    """
    out = ranges.moving(df, by, order, size, {"smooth": F.avg(value)})
    full = out.where(F.col("_n") >= size - 1).drop("_n")
    long = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") > size)
    return full.alias("d").join(long.alias("g"), ranges.same("d", "g", by), "left_semi")


def start_index(df: DataFrame, length: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with the sum of the lengths before each row (of its group), by ranges, so that no task holds a whole group."""
    return ranges.running_sum(df, length, order, "start", inclusive=False, by=by).withColumn("start", F.col("start").cast("long"))
