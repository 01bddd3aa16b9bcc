"""As-of joins, grids and intervals over ordered keys, without a cross join.

Both sides are laid into one table and ordered by group and time; the last or first frame before or after a probe is
carried to it, over ranges of (group, time), so that a group of most rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def _union(probes: DataFrame, frames: DataFrame, by: list[str], time: str, id_: str, frame_first: bool) -> DataFrame:
    p = probes.select(*by, F.col(time).alias("_t"), F.col(id_).alias("probe"), F.lit(None).cast(frames.schema[time].dataType).alias("_f"), F.lit(None).cast(frames.schema[id_].dataType).alias("_fid"), F.lit(1 if frame_first else 0).alias("_side"))
    f = frames.select(*by, F.col(time).alias("_t"), F.lit(None).cast(probes.schema[id_].dataType).alias("probe"), F.col(time).alias("_f"), F.col(id_).alias("_fid"), F.lit(0 if frame_first else 1).alias("_side"))
    return p.union(f)


def _order() -> list[Column]:
    return [F.col("_t"), F.col("_side"), F.col("_fid").asc_nulls_last(), F.col("probe").asc_nulls_last()]


def _carried(u: DataFrame, by: list[str], frame: int, back: str | None = None, fore: str | None = None) -> DataFrame:
    """u with the last frame (back) up to each row, the first one (fore) from it on; frame: the frames' side."""
    row = F.struct("_fid", "_f")
    return ranges.carried(u, by, _order(), F.struct("_f", "_fid"), F.when(F.col("_side") == frame, row), back, fore)


def asof_backward(probes: DataFrame, frames: DataFrame, by: list[str], time: str, id_: str) -> DataFrame:
    """by, probe, probe_time, frame, frame_time: the last frame at or before each probe (null if none)."""
    u = _union(probes, frames, by, time, id_, True)
    return _carried(u, by, 0, back="_g").where("_side = 1").select(*by, "probe", F.col("_t").alias("probe_time"), F.col("_g._fid").alias("frame"), F.col("_g._f").alias("frame_time"))


def asof_forward(probes: DataFrame, frames: DataFrame, by: list[str], time: str, id_: str, slack: float = 0.0) -> DataFrame:
    """The first frame at or after each probe less a slack; after the last frame, the last one."""
    named = F.struct(F.col(id_).alias("id"), F.col(time).alias("at"))  # a probe keeps its own time
    shifted = probes.withColumn(id_, named).withColumn(time, F.col(time) - F.lit(slack) if slack else F.col(time))
    u = _union(shifted, frames, by, time, id_, False)
    got = _carried(u, by, 1, back="_b", fore="_a").where("_side = 0").withColumn("_g", F.coalesce("_a", "_b"))
    return got.select(*by, F.col("probe.id").alias("probe"), F.col("probe.at").alias("probe_time"), F.col("_g._fid").alias("frame"), F.col("_g._f").alias("frame_time"))


def asof_nearest(probes: DataFrame, frames: DataFrame, by: list[str], time: str, id_: str) -> DataFrame:
    """The nearest frame to each probe; of two equally near ones the earlier, of several at one time the smallest id."""
    heads = frames.groupBy(*by, time).agg(F.min(id_).alias(id_))
    u = _union(probes, heads, by, time, id_, True)
    u = _carried(u, by, 0, back="_b", fore="_a").where("_side = 1")
    back, fore = F.col("_t") - F.col("_b._f"), F.col("_a._f") - F.col("_t")
    g = F.when(F.col("_a").isNull() | (back <= fore), F.col("_b")).otherwise(F.col("_a"))
    return u.withColumn("_g", F.coalesce(g, F.col("_a"))).select(*by, "probe", F.col("_t").alias("probe_time"), F.col("_g._fid").alias("frame"), F.col("_g._f").alias("frame_time"))


def resample(frames: DataFrame, by: list[str], time: str, id_: str, step, eps: float = 1e-9) -> DataFrame:
    """by, slot, frame: a grid of equal steps from a group's first frame to its last; in each, its first frame, or, if
    it has none, the one before. Times in floating point may miss a step's start by eps steps."""
    first = frames.groupBy(*by).agg(F.min(time).alias("_first"))
    slotted = frames.alias("d").join(first.alias("g"), ranges.same("d", "g", by)).select("d.*", "_first")
    slotted = slotted.withColumn("slot", F.floor((F.col(time) - F.col("_first")) / F.lit(step) + F.lit(eps)).cast("long"))
    heads = slotted.groupBy(*by, "slot").agg(F.min(F.struct(F.col(time).alias("_t"), F.col(id_).alias("_id"))).alias("_h"))
    # each slot up to the next one that has a frame
    nxt = F.coalesce(F.lead("slot").over(Window.partitionBy(*by).orderBy("slot")), F.col("slot") + 1)
    return heads.withColumn("_n", nxt).select(*by, F.explode(F.sequence(F.col("slot"), F.col("_n") - 1)).alias("slot"), F.col("_h._id").alias("frame"))


def intervals(frames: DataFrame, spans: DataFrame, by: list[str], step: str, label: str, before: int) -> DataFrame:
    """by, step, labels: of the spans [start - before, end) that a step lies in, sorted; '' if none.

    Spans are laid out into their steps, so the join is on equal keys. A span without steps labels none.
    """
    spans = spans.where(F.col("end") > F.greatest(F.lit(0), F.col("start") - before))
    at = spans.select(*by, label, F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - before), F.col("end") - 1)).alias(step)).distinct()
    got = at.groupBy(*by, step).agg(F.concat_ws(",", F.sort_array(F.collect_set(label))).alias("labels"))
    return frames.select(*by, step).join(got, [*by, step], "left").select(*by, step, F.coalesce("labels", F.lit("")).alias("labels"))
