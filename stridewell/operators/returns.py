"""Rewards, returns, n-step advantages, value bins and label fractions of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import ranges


def resolve_success(frames: DataFrame, episodes: DataFrame, episode: str, columns: list[str], step: str = "step") -> DataFrame:
    """episode, success: the first frame's flag from the first column that has one, else the episode table's, else true."""
    have = [c for c in columns if c in frames.columns]
    first = frames.groupBy(episode).agg(*[F.min_by(c, step).alias(f"_{i}") for i, c in enumerate(have)], F.count(F.lit(1)).alias("_n"))
    joined = first.join(episodes.select(episode, F.col("success").alias("_meta")), episode, "left")
    return joined.select(episode, F.coalesce(*[F.col(f"_{i}") for i in range(len(have))], F.col("_meta"), F.lit(True)).alias("success"))


def rewards(df: DataFrame, episode: str, success: str, penalty: float, step: str = "step") -> DataFrame:
    """df with -1 a step; at the last step 0 after success, else minus the penalty."""
    last = F.max(step).over(Window.partitionBy(episode))
    end = F.when(F.col(success), F.lit(0.0)).otherwise(F.lit(-float(penalty)))
    return df.withColumn("reward", F.when(F.col(step) == last, end).otherwise(F.lit(-1.0)))


def return_to_go(df: DataFrame, episode: str, success: str, penalty: float, gamma: float = 1.0, step: str = "step") -> DataFrame:
    """df with G(t) = r(t) + gamma G(t + 1), in closed form: k = steps left, -(1 - g^k) / (1 - g) + g^k r(T)."""
    left = (F.max(step).over(Window.partitionBy(episode)) - F.col(step)).cast("double")
    end = F.when(F.col(success), F.lit(0.0)).otherwise(F.lit(-float(penalty)))
    if gamma == 1.0:
        return df.withColumn("return_to_go", -left + end)
    decay = F.pow(F.lit(float(gamma)), left)
    return df.withColumn("return_to_go", -(1 - decay) / F.lit(1 - gamma) + decay * end)


def horizons(episodes: DataFrame, task: str | None, length: str = "length") -> DataFrame:
    """episodes with a horizon: max(1, length - 1), of the episode or the longest of its task."""
    own = F.greatest(F.lit(1), F.col(length) - 1)
    if task is None:
        return episodes.withColumn("horizon", own.cast("double"))
    longest = episodes.groupBy(task).agg(F.max(own).cast("double").alias("horizon"))
    return episodes.alias("d").join(longest.alias("h"), ranges.same("d", "h", [task])).select("d.*", "h.horizon")


def normalised(value: Column, horizon: Column, penalty: float = 0.0) -> Column:
    """clip(G / max(1, H + C), -1, 0)."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(0.0), value / F.greatest(F.lit(1.0), horizon + F.lit(float(penalty)))))


def value_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value, rounding halves to even, clipped to 0 .. bins - 1."""
    delta = (high - low) / max(bins - 1, 1)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.rint((value - F.lit(low)) / F.lit(delta)))).cast("long")


def two_bin(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """A row for each bin that a value lies between, with its weight; on a bin, that bin has weight 1."""
    delta = (high - low) / max(bins - 1, 1)
    b = (F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))) - F.lit(low)) / F.lit(delta)
    lower, upper = F.floor(b).cast("long"), F.ceil(b).cast("long")
    pairs = F.when(lower == upper, F.array(F.struct(lower.alias("bin"), F.lit(1.0).alias("weight")))).otherwise(
        F.array(F.struct(lower.alias("bin"), (upper - b).alias("weight")), F.struct(upper.alias("bin"), (b - lower).alias("weight")))
    )
    return df.withColumn("_p", F.explode(pairs)).withColumn("bin", F.col("_p.bin")).withColumn("weight", F.col("_p.weight")).drop("_p")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def expected(probabilities: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(probabilities, values, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def ahead(df: DataFrame, keys: list[str], step: str, n: int, columns: dict[str, str]) -> DataFrame:
    """df with the columns of the row n steps ahead, by step number: a gap gives null, unlike counting rows."""
    w = Window.partitionBy(*keys).orderBy(F.col(step).cast("long")).rangeBetween(n, n)
    for new, old in columns.items():
        df = df.withColumn(new, F.first(old).over(w))
    return df


def n_step(df: DataFrame, keys: list[str], n: int, gamma: float, scale: float = 1.0, step: str = "step") -> DataFrame:
    """df (return_to_go, pred_value) with n_step_reward, bootstrap_value, value_t, advantage_raw and advantage.

    Without a row n steps ahead, the reward is the whole return and the bootstrap value 0.
    """
    if scale <= 0:
        raise ValueError("the scale must be positive")
    g = float(gamma) ** n
    df = ahead(df, keys, step, n, {"_g": "return_to_go", "_v": "pred_value"})
    there = F.col("_g").isNotNull()
    df = df.withColumn("n_step_reward", F.when(there, F.col("return_to_go") - F.lit(g) * F.col("_g")).otherwise(F.col("return_to_go")))
    df = df.withColumn("bootstrap_value", F.when(there, F.col("_v")).otherwise(F.lit(0.0))).withColumn("value_t", F.col("pred_value"))
    df = df.withColumn("advantage_raw", F.col("n_step_reward") + F.lit(g) * F.col("bootstrap_value") - F.col("value_t"))
    return df.withColumn("advantage", F.col("advantage_raw") / F.lit(float(scale))).drop("_g", "_v")


def top_fraction(df: DataFrame, task: str, advantage: str, position: str, fraction: float, threshold: float = 0.0, least: int = 1) -> DataFrame:
    """df with label 1 for the best candidates (advantage over the threshold) of a task: ceil(fraction * candidates) of
    them, at least `least`, at most all; ties go to the smaller position.

    The last advantage that gets a label is an order statistic, found by counting; only rows that have just this one are
    ranked, by ranges of the position. So a task's rows are never together.
    """
    df = ranges.settled(df, "advantages")
    best = df.where(F.col(advantage) > F.lit(threshold)).select(task, advantage)
    k = F.least(F.col("n"), F.greatest(F.lit(least), F.ceil(F.lit(fraction) * F.col("n"))))
    groups, found = ranges.order_statistics(best, [task], advantage, [(max(0.0, 1.0 - fraction), [F.col("n") - k])])
    cut = found.where("x is not null").alias("f").join(groups.alias("g"), ranges.same("f", "g", [task])).select(f"f.{task}", F.col("x").alias("_cut"), k.alias("_k"))
    above = best.alias("d").join(cut.alias("c"), ranges.same("d", "c", [task])).groupBy(f"d.{task}", "_cut", "_k").agg(F.count_if(F.col(advantage) > F.col("_cut")).alias("_above"))
    cut = stored(above.select(task, "_cut", (F.col("_k") - F.col("_above")).alias("_left")), "cuts")  # a row for each task
    rows = df.alias("d").join(cut.alias("c"), ranges.same("d", "c", [task]), "left").select("d.*", "_cut", "_left")
    tie = F.coalesce(F.col(advantage) == F.col("_cut"), F.lit(False))
    clear = rows.where(~tie).withColumn("label", F.coalesce(F.col(advantage) > F.col("_cut"), F.lit(False)).cast("long"))
    ties = ranges.numbered(rows.where(tie), [position], "_r", [task])
    return clear.drop("_cut", "_left").union(ties.withColumn("label", (F.col("_r") < F.col("_left")).cast("long")).drop("_cut", "_left", "_r"))


def label_summary(df: DataFrame, task: str, advantage: str) -> DataFrame:
    """Of each task: count, sum, least, largest and mean advantage, and labels of either kind."""
    return df.groupBy(task).agg(
        F.count(F.lit(1)).alias("n"), F.sum(advantage).alias("total"), F.min(advantage).alias("least"), F.max(advantage).alias("most"),
        F.avg(advantage).alias("mean"), F.sum("label").alias("positive"), F.sum(1 - F.col("label")).alias("negative"),
    )


def last_write(df: DataFrame, keys: list[str], order: list[str], default: dict[str, str]) -> DataFrame:
    """One row for each key: the last in order; null keys take their default first."""
    for k, v in default.items():
        df = df.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def first_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")
