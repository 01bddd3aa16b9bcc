"""Reports: errors, correlations, distributions, per-episode and macro summaries, success tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def average_rank(df: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """df with ranks from 0; equal values share the mean of theirs.

    Equal values are counted first; different ones are dealt by ranges, whose counts are summed over the ranges before.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = ranges.running_sum(counts, "_c", [value], "_start", inclusive=False, by=by).withColumn(name, F.col("_start") + (F.col("_c") - 1) / 2)
    return df.alias("d").join(ranks.alias("r"), ranges.same("d", "r", [*by, value])).select("d.*", f"r.{name}")


def fit(df: DataFrame, pred: str, target: str, by: list[str]) -> DataFrame:
    """by: n, mse, mae, pearson and spearman of values clipped to [0, 1]."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    d = df.select(*by, clip(pred).alias("_p"), clip(target).alias("_t"))
    d = average_rank(average_rank(d, "_p", "_rp", by), "_t", "_rt", by)
    err = F.col("_p") - F.col("_t")
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.corr("_p", "_t").alias("pearson"), F.corr("_rp", "_rt").alias("spearman"))


def bucket(value: Column, edges: list[float]) -> Column:
    """Number of the half-open interval a value lies in; the last is closed; null outside."""
    out = F.when(value == F.lit(edges[-1]), F.lit(len(edges) - 2))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = out.when((value >= F.lit(a)) & (value < F.lit(b)), F.lit(i))
    return out.cast("long")


def bucketed_errors(df: DataFrame, pred: str, target: str, edges: list[float]) -> DataFrame:
    """bucket, n, mse, mae by the target's interval; empty intervals are absent."""
    err = F.col(pred) - F.col(target)
    return df.withColumn("bucket", bucket(F.col(target), edges)).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"))


def episode_errors(df: DataFrame, episode: str, step: str, pred: str, target: str) -> DataFrame:
    err = F.col(pred) - F.col(target)
    return df.groupBy(episode).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.max(F.abs(err)).alias("max_abs_err"),
        F.min_by(pred, step).alias("first_pred"), F.max_by(pred, step).alias("last_pred"), F.min_by(target, step).alias("first_target"), F.max_by(target, step).alias("last_target"),
        F.min_by(err, F.col(step)).alias("first_err"), F.max_by(err, F.col(step)).alias("last_err"), F.avg(pred).alias("mean_pred"), F.avg(target).alias("mean_target"),
    )


def distribution(df: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """by: n, min, max, mean, std (population) and exact quantiles, by linear interpolation."""
    return ranges.quantiles(df.select(*by, value), by, value, points, F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """value, n, share: of every value, null included."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_n")).drop("_n")  # one row


def value_range(df: DataFrame, value: str, margin: float = 0.0) -> DataFrame:
    """low, high: the ends, widened by a share of the span."""
    span = (F.max(value) - F.min(value)) * F.lit(margin)
    return df.agg((F.min(value) - span).alias("low"), (F.max(value) + span).alias("high"))


def aggregated(df: DataFrame, by: list[str], value: str, how: str) -> DataFrame:
    """by, value: max, min, mean or sum, by name."""
    known = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}
    if how not in known:
        raise ValueError(f"unknown aggregation: {how}")
    return df.groupBy(*by).agg(known[how](value).alias(value))


def success_table(df: DataFrame, task: str, success: str) -> DataFrame:
    """Of each task and of all (task null): episodes, successes, rate."""
    return df.rollup(task).agg(F.count(F.lit(1)).alias("episodes"), F.sum(F.col(success).cast("long")).alias("successes"), F.avg(F.col(success).cast("double")).alias("rate"))


def mean_of_means(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias(value))


def ensemble(chunks: DataFrame, keys: list[str], made: str, chunk: str, alpha: float, most: int) -> DataFrame:
    """Mean of the predictions for a step by chunks made at and before it, the newest `most`, weighted by
    exp(alpha * cosine with the newest prediction).

    chunks: keys, step made, chunk (an array of vectors, the first for the step made).
    """
    rows = chunks.select(*keys, F.col(made).alias("_made"), F.posexplode(chunk).alias("_k", "_v")).withColumn("step", F.col("_made") + F.col("_k"))
    newest = Window.partitionBy(*keys, "step").orderBy(F.col("_made").desc())
    rows = rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most).withColumn("_top", F.first("_v").over(newest))
    from .vectors import dot, norm

    cos = dot(F.col("_v"), F.col("_top")) / (norm(F.col("_v")) * norm(F.col("_top")) + F.lit(1e-7))
    rows = rows.withColumn("_w", F.exp(F.lit(alpha) * cos))
    long = rows.select(*keys, "step", "_w", F.posexplode("_v").alias("dim", "x"))
    return long.groupBy(*keys, "step", F.col("dim").cast("long").alias("dim")).agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("x"))
