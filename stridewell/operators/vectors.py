"""Vector columns: slices, normalisers and their inverses, statistics and their merge, in long and in array form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges


def part(vector: Column, start: int, end: int) -> Column:
    """Elements start .. end - 1."""
    return F.slice(vector, start + 1, end - start)


def joined(vectors: list[Column], sizes: list[int] | None = None) -> Column:
    """Vectors end to end; with sizes, another size raises an error."""
    if sizes:
        vectors = [F.when(F.size(v) == n, v).otherwise(F.raise_error(F.lit(f"vector {i} has not {n} elements"))) for i, (v, n) in enumerate(zip(vectors, sizes, strict=True))]
    return F.concat(*vectors)


def split(vector: Column, sizes: dict[str, int]) -> dict[str, Column]:
    """The inverse of joined: named parts in order."""
    out, at = {}, 0
    for name, n in sizes.items():
        out[name] = part(vector, at, at + n)
        at += n
    return out


def _scale(kind: str, x, s) -> Column:
    if kind == "min_max":
        return F.when(s["max"] == s["min"], F.lit(0.0)).otherwise(2 * (x - s["min"]) / (s["max"] - s["min"]) - 1)
    if kind == "q99":
        y = F.when(s["q99"] == s["q01"], x).otherwise(2 * (x - s["q01"]) / (s["q99"] - s["q01"]) - 1)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y))
    if kind == "mean_std":
        return F.when(s["std"] == 0, x).otherwise((x - s["mean"]) / s["std"])
    if kind == "scale":
        top = F.greatest(F.abs(s["min"]), F.abs(s["max"]))
        return F.when(top == 0, F.lit(0.0)).otherwise(x / top)
    if kind == "binary":
        return (x > 0.5).cast("double")
    raise ValueError(f"unknown normaliser: {kind}")


def _unscale(kind: str, y, s) -> Column:
    if kind == "min_max":
        return (y + 1) / 2 * (s["max"] - s["min"]) + s["min"]
    if kind == "q99":
        return (y + 1) / 2 * (s["q99"] - s["q01"]) + s["q01"]
    if kind == "mean_std":
        return y * s["std"] + s["mean"]
    if kind == "binary":
        return (y > 0.5).cast("double")
    raise ValueError(f"no inverse: {kind}")


def normalise(kind: str, x: Column, stats: dict[str, Column]) -> Column:
    """One number by its dimension's statistics (long form)."""
    return _scale(kind, x, stats)


def unnormalise(kind: str, y: Column, stats: dict[str, Column]) -> Column:
    return _unscale(kind, y, stats)


def normalise_array(kind: str, vector: Column, stats: dict[str, Column]) -> Column:
    """A vector by vectors of statistics."""
    return F.transform(F.arrays_zip(vector.alias("x"), *[v.alias(k) for k, v in stats.items()]), lambda z: _scale(kind, z["x"], {k: z[k] for k in stats}))


def unnormalise_array(kind: str, vector: Column, stats: dict[str, Column]) -> Column:
    return F.transform(F.arrays_zip(vector.alias("x"), *[v.alias(k) for k, v in stats.items()]), lambda z: _unscale(kind, z["x"], {k: z[k] for k in stats}))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def normalise_close(x: Column, low: Column, high: Column) -> Column:
    """min-max to [-1, 1]; a dimension whose ends are close gives 0."""
    return F.when(close(low, high), F.lit(0.0)).otherwise(2 * (x - low) / (high - low) - 1)


def unnormalise_clipped(y: Column, low: Column, high: Column) -> Column:
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y))
    return (clipped + 1) / 2 * (high - low) + low


def masked_unnormalise(y: Column, low: Column, high: Column, mask: Column) -> Column:
    """Clipped and scaled back where the mask holds, else passed through after clipping."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y))
    return F.when(mask, 0.5 * (clipped + 1) * (high - low) + low).otherwise(clipped)


def masked_normalise(x: Column, low: Column, high: Column, mask: Column) -> Column:
    scaled = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (x - low) / (high - low + 1e-8) - 1))
    return F.when(mask, scaled).otherwise((x > 0.5).cast("double"))


def sin_cos(vector: Column) -> Column:
    return F.concat(F.transform(vector, F.sin), F.transform(vector, F.cos))


def padded(vector: Column, size: int) -> Column:
    """Cut or filled with zeros to a size; a null vector is all zeros."""
    v = F.coalesce(vector, F.array().cast("array<double>"))
    have = F.least(F.size(v), F.lit(size))
    return F.concat(F.slice(v, F.lit(1), have), F.array_repeat(F.lit(0.0), F.lit(size) - have))


def pad_mask(vector: Column, size: int) -> Column:
    have = F.least(F.coalesce(F.when(vector.isNotNull(), F.size(vector)), F.lit(0)), F.lit(size))
    return F.concat(F.array_repeat(F.lit(True), have), F.array_repeat(F.lit(False), F.lit(size) - have))


def padded_or_error(vector: Column, size: int) -> Column:
    return F.when(F.size(vector) <= size, padded(vector, size)).otherwise(F.raise_error(F.lit(f"vector has over {size} elements")))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def deltas(chunk: Column, first: Column | None = None) -> Column:
    """Differences of neighbouring vectors of a chunk; the first against a reference, or itself (zeros)."""
    before = F.concat(F.array(F.coalesce(first, chunk[0]) if first is not None else chunk[0]), F.slice(chunk, F.lit(1), F.size(chunk) - 1))
    return F.zip_with(chunk, before, lambda a, b: F.zip_with(a, b, lambda x, y: x - y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_angle(a: Column, b: Column) -> Column:
    """Angle between two vectors, in radians."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def distance_share(a: Column, b: Column) -> Column:
    """Euclidean distance divided by the number of elements."""
    d = minus(a, b)
    return F.sqrt(dot(d, d)) / F.size(d)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of boxes (x1, y1, x2, y2) as a share of their union."""
    def area(x):
        return (x[2] - x[0]) * (x[3] - x[1])

    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h / (area(a) + area(b) - w * h)


def axis_angle(q: list[Column]) -> list[Column]:
    """Axis times angle of a quaternion (x, y, z, w); no rotation gives zeros."""
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q[3]))
    den = F.sqrt(1 - w * w)
    scale = F.when(den <= 1e-9, F.lit(0.0)).otherwise(2 * F.acos(w) / F.when(den <= 1e-9, F.lit(1.0)).otherwise(den))
    return [x * scale for x in q[:3]]


def uniforms(keys: list[Column], seed: int) -> tuple[Column, Column]:
    """Two numbers over 0 and up to 1 of the keys: 52 bits each of the md5 of seed and keys, in any engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return tuple((F.conv(F.substr(digest, F.lit(i), F.lit(13)), 16, 10).cast("long") + 1) / F.lit(float(1 << 52)) for i in (1, 17))


def noisy(vector: Column, sigma: float, seed: int, keys: list[Column]) -> Column:
    """Noise of N(0, sigma) from hashes of keys and place, clamped to the vector's own range; sigma <= 0 leaves it."""
    if sigma <= 0:
        return vector
    low, high = F.array_min(vector), F.array_max(vector)

    def normal(i):
        u, v = uniforms([*keys, i], seed)
        return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)

    return F.transform(vector, lambda x, i: F.greatest(low, F.least(high, x + F.lit(sigma) * normal(i))))


def dropped(vector: Column, share: float, seed: int, keys: list[Column]) -> Column:
    """The vector, or zeros for about a share of the rows, chosen by hash."""
    return F.when(uniforms(keys, seed)[0] <= share, F.transform(vector, lambda x: x * 0)).otherwise(vector)


def long_form(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, dim, x: a row for each element."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).withColumn("dim", F.col("dim").cast("long")).withColumn("x", F.col("x").cast("double"))


def statistics(long: DataFrame, by: list[str], std: str = "population") -> DataFrame:
    """by, dim: n, mean, std, min, max, q01, q99. std: of the population, or of a sample with a floor of 1e-4."""
    if std == "population":
        spread = F.stddev_pop("x")
    elif std == "sample":
        spread = F.when(F.count("x") <= 1, F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.var_samp("x"), F.lit(1e-8))))
    else:
        raise ValueError(f"unknown std: {std}")
    return ranges.quantiles(long.select(*by, "x"), by, "x", {"q01": 0.01, "q99": 0.99}, F.avg("x").alias("mean"), spread.alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def partials(long: DataFrame, by: list[str]) -> DataFrame:
    return long.groupBy(*by).agg(F.count("x").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"), F.min("x").alias("min"), F.max("x").alias("max"))


def merge_partials(parts: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of all parts; the quantiles are the ends."""
    out = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sum").alias("s"), F.sum("sumsq").alias("ss"), F.min("min").alias("min"), F.max("max").alias("max"))
    mean = F.col("s") / F.col("n")
    return out.select(*by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)).alias("std"), "min", "max", F.col("min").alias("q01"), F.col("max").alias("q99"))


def merge_weighted(stats: DataFrame, by: list[str], weight: str, quantiles: str = "weighted") -> DataFrame:
    """Merged statistics of data sets; weights are made to sum to 1 for each key among the data sets that have it."""
    w = F.col(weight)
    total = F.sum(w)
    mean = F.sum(w * F.col("mean")) / total
    second = F.sum(w * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / total
    if quantiles == "weighted":
        q = [(F.sum(w * F.col(c)) / total).alias(c) for c in ("q01", "q99")]
    else:
        q = [F.min("q01").alias("q01"), F.max("q99").alias("q99")]
    return stats.groupBy(*by).agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), second - mean * mean)).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"), *q)


def ordered_concat(stats: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Statistics of sub-keys end to end, as vectors in order."""
    got = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("_s"))
    return got.select(*by, *[F.col("_s").getField(c).alias(c) for c in columns])


def action_mask(sizes: dict[str, int]) -> Column:
    """False for the dimensions of keys that name a gripper."""
    return F.concat(*[F.array_repeat(F.lit("gripper" not in k), n) for k, n in sizes.items()])
