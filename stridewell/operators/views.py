"""Camera views of data sets that are mixed: one name for what means the same, and the views that a mixture can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import same


def canonical(name: Column, synonyms: dict[str, str]) -> Column:
    """The name that stands for a view's."""
    names = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.coalesce(F.try_element_at(names, name), name)


def choose(views: DataFrame, mixture: str, dataset: str, view: str, pixels: str, synonyms: dict[str, str]) -> DataFrame:
    """mixture, name, pixels, dataset, common: the views of each mixture, with their smallest configuration.

    Views are those that all data sets of the mixture have; if there are none, those of its first data set by name
    (common is then false). Of two views of a data set with one name the last counts. The configuration is that of least
    pixels; of equal ones, that of the first data set. Key sets are compared by counts: a view is common if as many data
    sets have it as there are.
    """
    own = views.withColumn("name", canonical(F.col(view), synonyms)).groupBy(mixture, dataset, "name").agg(F.max_by(pixels, view).alias("_px"))
    sets = own.groupBy(mixture).agg(F.count_distinct(dataset).alias("_sets"), F.min(dataset).alias("_first"))
    marked = own.alias("o").join(sets.alias("s"), same("o", "s", [mixture])).select("o.*", "_sets", "_first")
    each = marked.groupBy(mixture, "name").agg((F.count(F.lit(1)) == F.max("_sets")).alias("common"), F.bool_or(F.col(dataset) == F.col("_first")).alias("_in_first"), F.min(F.struct("_px", dataset)).alias("_best"))
    some = each.groupBy(mixture).agg(F.bool_or("common").alias("_some"))
    kept = each.alias("e").join(some.alias("a"), same("e", "a", [mixture])).select("e.*", "_some").where("common or (not _some and _in_first)")
    return kept.select(mixture, "name", F.col("_best._px").alias(pixels), F.col(f"_best.{dataset}").alias(dataset), "common")


def available(views: DataFrame, mixture: str, view: str, synonyms: dict[str, str], order: list[str]) -> DataFrame:
    """mixture, views: all names that occur, those of `order` first and in it, the others by name."""
    name = canonical(F.col(view), synonyms)
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)]), name), F.lit(len(order)))
    found = views.groupBy(mixture).agg(F.array_sort(F.collect_set(F.struct(place.alias("place"), name.alias("name")))).alias("_v"))
    return found.select(mixture, F.transform("_v", lambda v: v["name"]).alias("views"))
