"""Batches of token lists: padded at their end to the longest of their group, or packed end to end with offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import same


def pad(df: DataFrame, by: list[str], ids: str, filler: int) -> DataFrame:
    """df with padded (as long as the longest of the group, a null list counting as empty) and length, of what is no filler."""
    have = F.coalesce(F.col(ids), F.array().cast(df.schema[ids].dataType))
    longest = df.groupBy(*by).agg(F.max(F.size(have)).alias("_longest"))
    out = df.alias("d").join(longest.alias("g"), same("d", "g", by)).select("d.*", "_longest")
    return out.withColumn("length", F.size(have)).withColumn("padded", F.concat(have, F.array_repeat(F.lit(filler), F.col("_longest") - F.size(have)))).drop("_longest")


def pack(df: DataFrame, by: list[str], order: list[str], ids: str) -> DataFrame:
    """by, packed, offsets: a group's lists end to end in order, and where each begins, with the whole length last.

    A group is one batch, which one task holds.
    """
    lists = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(ids), F.array().cast(df.schema[ids].dataType)).alias("_ids")))), lambda s: s["_ids"])
    out = df.groupBy(*by).agg(lists.alias("_l"))
    ends = F.aggregate("_l", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(x))))
    return out.select(*by, F.flatten("_l").alias("packed"), ends.alias("offsets"))
