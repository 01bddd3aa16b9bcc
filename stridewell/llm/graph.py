"""Connected components of a link table, by joins alone: no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root: for links (a, b) of longs, the smallest node of each node's component.

    Each round a node takes the smallest label among its own and its neighbours', then the label of its label, until
    nothing changes. A hub's links are only ever counted by partial aggregates or joined where skewed joins are split.
    Nodes without links are absent; an empty link table gives an empty result. rows: that links has, about.
    """
    spark, held = links.sparkSession, []
    way = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = common.stored(links.where("a <> b").select(way).select("way.a", "way.b").distinct(), "links", held, rows)
    size = both.count()
    now = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root")
    while True:
        near = both.join(common.shuffled(now), F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("low"))
        took = now.join(common.shuffled(near), F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("far"))
        nxt = took.join(common.shuffled(jump), "root", "left").select("node", "old", F.least("root", "far").alias("root"))
        moved = Observation()
        path = []
        now = common.stored(nxt.observe(moved, F.count(F.when(F.col("root") != F.col("old"), 1)).alias("n")), "labels", path, size).select("node", "root")
        if not moved.get.get("n"):
            common.discard(spark, held)
            return now
        held += path
