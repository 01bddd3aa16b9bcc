"""Deterministic shuffles, samples, splits, greedy selection to a number of frames, and mixtures of data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered, order_statistics, running_sum

#: Rows of a sample that one task may hold.
MOST_TAKEN = 100_000


def order_key(keys: list[str], seed: int) -> Column:
    """A pseudo-random order of rows, the same at every run and in any engine: the first 60 bits of the md5 of seed and keys."""
    named = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with 0, 1, ... in a total order over the whole table, without one task for all rows."""
    return numbered(df, order, name)


def shuffled(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """df with its place in a shuffle that has every row once."""
    return ranked(df.withColumn("_key", order_key(keys, seed)), ["_key", *keys], "place").drop("_key")


def split(df: DataFrame, keys: list[str], seed: int, train: float) -> DataFrame:
    """df with a split: the first int(n * train) rows of the shuffle, then half of the rest (rounded down), then the rest."""
    n = df.count()
    first = int(n * train)
    second = first + (n - first) // 2
    out = shuffled(df, keys, seed)
    return out.withColumn("split", F.when(F.col("place") < first, "train").when(F.col("place") < second, "val").otherwise("test"))


def smallest(df: DataFrame, key: str, ties: list[str], n: int) -> DataFrame:
    """The n rows of the smallest keys; of equal keys those that come first by `ties`.

    Up to MOST_TAKEN rows are merged from each task's first n. For more, the last key that is in is an order statistic, so
    that nothing is sorted and no task holds the sample.
    """
    if n <= MOST_TAKEN:
        return df.orderBy(key, *ties).limit(n)
    total = df.count()
    if n >= total:
        return df
    _, found = order_statistics(df.select(key).withColumn("_all", F.lit(0)), ["_all"], key, [(n / total, [F.lit(n - 1)])])
    cut = found.first()["x"]
    below, last = df.where(F.col(key) < F.lit(cut)), df.where(F.col(key) == F.lit(cut))
    left = n - below.count()
    return below.union(smallest(last, ties[0], ties[1:], left) if ties else last.limit(left))


def sample(df: DataFrame, keys: list[str], seed: int, n: int) -> DataFrame:
    """n rows without replacement."""
    return smallest(df.withColumn("_key", order_key(keys, seed)), "_key", keys, n).drop("_key")


def reservoir(df: DataFrame, by: list[str], keys: list[str], seed: int, n: int) -> DataFrame:
    """n rows of each group without replacement (all of a smaller one): those of the smallest keys.

    Spark keeps n rows a group in each task before the shuffle, so that samples of parts are merged, not groups sorted.
    """
    w = Window.partitionBy(*by).orderBy("_key", *keys)
    return df.withColumn("_key", order_key(keys, seed)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_key", "_r")


def sample_share(df: DataFrame, keys: list[str], seed: int, share: float) -> DataFrame:
    """int(rows * share) rows."""
    return sample(df, keys, seed, int(df.count() * share))


def weighted_sample(df: DataFrame, keys: list[str], weight: Column, seed: int, n: int) -> DataFrame:
    """n rows without replacement, drawn in proportion to weights (1e-8 at least): the smallest -ln(u) / w."""
    u = (order_key(keys, seed) % (1 << 40) + 1) / F.lit(float((1 << 40) + 1))
    return smallest(df.withColumn("_key", -F.log(u) / F.greatest(weight, F.lit(1e-8))), "_key", keys, n).drop("_key")


def greedy(df: DataFrame, length: str, order: list[str], target: float, by: list[str] | None = None) -> DataFrame:
    """Rows in order until their lengths reach the target; the row that crosses it stays unless leaving it out comes
    strictly nearer and another row stays."""
    summed = running_sum(df, length, order, "_cum", by=by)
    before = F.col("_cum") - F.col(length)
    keep = (F.col("_cum") < target) | (before == 0) | ((before < target) & (F.abs(before - target) >= F.abs(F.col("_cum") - target)))
    return summed.where(keep & F.lit(target > 0)).drop("_cum")


def cycled(df: DataFrame, keys: list[str], length: str, seed: int, target: float) -> DataFrame:
    """Rows over and over, each cycle in an order of its own, until their lengths reach the target (greedy's rule).

    Nothing to draw from gives nothing.
    """
    total = df.agg(F.coalesce(F.sum(length), F.lit(0)).alias("t")).first()["t"]
    if not total or target <= 0:
        return df.limit(0).withColumn("cycle", F.lit(0).cast("long"))
    cycles = int(target // total) + 1
    again = df.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cycles - 1).cast("long")))).withColumn("_key", order_key(["cycle", *keys], seed))
    return greedy(again, length, ["cycle", "_key", *keys], target).drop("_key")


def mixture_weights(datasets: DataFrame, weight: str = "weight", length: str = "length") -> DataFrame:
    """datasets with share: weight * length (1e-8 at least), divided by the sum."""
    raw = F.greatest(F.col(weight) * F.col(length), F.lit(1e-8))
    total = datasets.agg(F.sum(raw).alias("_total"))
    return datasets.crossJoin(F.broadcast(total)).withColumn("share", raw / F.col("_total")).drop("_total")  # one row


def epoch_length(datasets: DataFrame, weight: str = "weight", length: str = "length") -> DataFrame:
    """epoch_length: the largest length / share among the primary data sets (weight 1, else the largest weight)."""
    shares = mixture_weights(datasets, weight, length)
    top = datasets.agg(F.when(F.max((F.col(weight) == 1).cast("int")) == 1, F.lit(1.0)).otherwise(F.max(weight)).alias("_top"))
    primary = shares.crossJoin(F.broadcast(top)).where(F.col(weight) == F.col("_top"))  # one row
    return primary.agg(F.floor(F.max(F.col(length) / F.col("share"))).cast("long").alias("epoch_length"))


def even_frames(n: Column, low: int, high: int, duration: Column, interval: float) -> Column:
    """Numbers of evenly spaced frames: unique(int(linspace(0, n - 1, k))), k = round(duration / interval) in range."""
    k = F.greatest(F.lit(low), F.least(F.lit(high), F.rint(duration / F.lit(interval)))).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("long")))


def zip_cycled(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """left with, at its place, the row of right at that place, right being repeated as often as needed."""
    n = right.count()
    a = ranked(left, left_order, "_p")
    b = ranked(right, right_order, "_q")
    return a.withColumn("_q", F.col("_p") % F.lit(max(n, 1))).join(b, "_q").drop("_q").withColumnRenamed("_p", "place")


def rekey(frames: DataFrame, episodes: DataFrame, episode: str, order: list[str], step: str) -> DataFrame:
    """Frames of the episodes with new episode numbers in order, and an index that runs over all frames."""
    numbered = ranked(episodes.select(episode, *[c for c in order if c != episode]).distinct(), order, "new_episode")
    out = frames.join(numbered.select(episode, "new_episode"), episode)
    return ranked(out, ["new_episode", step], "index")
