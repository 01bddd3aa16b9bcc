"""Queries over vectors: slices, normalisers, statistics, merges, distances, rotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pose
from ..operators import returns
from ..operators import vectors as vec
from ..sources import writers
from .base import VEC, query, r6, table, vectors

STATS = ("n", "mean", "std", "min", "max", "q01", "q99")


def _long(spark, sf, start=0, end=64):
    v = vectors(spark, sf).withColumn("v", vec.part(F.col("v"), start, end))
    return vec.long_form(v, ["vec_id", "label"], "v").withColumn("dim", F.col("dim") + start)


def _with_stats(spark, sf, start=0, end=14):
    """Elements of the slice, with the statistics of their dimension."""
    long = _long(spark, sf, start, end)
    stats = vec.statistics(long, ["dim"])
    return long.join(F.broadcast(stats), "dim")  # a row for each dimension


def _sc():
    """The columns of statistics."""
    return {k: F.col(k) for k in ("mean", "std", "min", "max", "q01", "q99")}


S14 = f"{VEC}, j AS (SELECT vec.*, mean, std, mn, mx, q01, q99 FROM vec JOIN st USING (dim) WHERE dim < 14)"
CLIP = "greatest(-1.0, least(1.0, {}))"


@query("p1_slice", f"WITH {VEC} SELECT vec_id, dim - 6 AS dim, x FROM vec WHERE dim BETWEEN 6 AND 13")
def _(spark, sf):
    return vec.long_form(vectors(spark, sf).withColumn("v", vec.part(F.col("v"), 6, 14)), ["vec_id"], "v")


@query("p2_concat", f"WITH {VEC} SELECT vec_id, CASE WHEN dim >= 10 THEN dim - 10 ELSE dim + 4 END AS dim, x FROM vec WHERE dim < 3 OR dim BETWEEN 10 AND 13".replace("dim < 3", "dim < 3"))
def _(spark, sf):
    v = vectors(spark, sf).withColumn("v", vec.joined([vec.part(F.col("v"), 10, 14), vec.part(F.col("v"), 0, 3)], [4, 3]))
    return vec.long_form(v, ["vec_id"], "v")


@query("p3_split", f"WITH {VEC} SELECT vec_id, CASE WHEN dim < 6 THEN 'left_arm' WHEN dim < 7 THEN 'left_gripper' ELSE 'right_arm' END AS part, count(*) AS n, round(sum(x), 6) AS total FROM vec WHERE dim < 13 GROUP BY 1, 2")
def _(spark, sf):
    parts = vec.split(F.col("v"), {"left_arm": 6, "left_gripper": 1, "right_arm": 6})
    each = vectors(spark, sf).select("vec_id", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), c.alias("p")) for k, c in parts.items()])).alias("e"))
    return each.select("vec_id", "e.part", F.size("e.p").cast("long").alias("n"), r6(F.aggregate("e.p", F.lit(0.0), lambda a, x: a + x), "total"))


@query("p4_scalar_to_vector", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(1 AS BIGINT) AS n, CAST(l_quantity AS DOUBLE) AS x FROM lineitem")
def _(spark, sf):
    v = table(spark, sf, "lineitem").withColumn("v", F.array(F.col("l_quantity").cast("double")))
    return v.select("l_orderkey", "l_linenumber", "l_partkey", F.size("v").cast("long").alias("n"), F.col("v")[0].alias("x"))


NORMS = {
    "min_max": "CASE WHEN mx = mn THEN 0.0 ELSE 2 * (x - mn) / (mx - mn) - 1 END",
    "q99": CLIP.format("CASE WHEN q99 = q01 THEN x ELSE 2 * (x - q01) / (q99 - q01) - 1 END"),
    "mean_std": "CASE WHEN std = 0 THEN x ELSE (x - mean) / std END",
    "scale": "CASE WHEN greatest(abs(mn), abs(mx)) = 0 THEN 0.0 ELSE x / greatest(abs(mn), abs(mx)) END",
    "binary": "CAST(CASE WHEN x > 0.5 THEN 1 ELSE 0 END AS DOUBLE)",
}
for _id, _kind in (("p5", "min_max"), ("p6", "q99"), ("p7", "mean_std"), ("p8", "scale"), ("p9", "binary")):

    @query(f"{_id}_normalise_{_kind}", f"WITH {S14} SELECT vec_id, dim, round({NORMS[_kind]}, 6) AS y FROM j")
    def _(spark, sf, kind=_kind):
        return _with_stats(spark, sf).select("vec_id", "dim", r6(vec.normalise(kind, F.col("x"), _sc()), "y"))


TWO = f"{VEC}, t AS (SELECT vec_id, dim // 7 AS t, dim % 7 AS d, x FROM vec WHERE dim < 14), ts AS (SELECT t, d, min(x) AS mn, max(x) AS mx FROM t GROUP BY 1, 2)"


@query("p10_per_step_min_max", f"WITH {TWO} SELECT vec_id, t, d, round(CASE WHEN mx = mn THEN 0.0 ELSE 2 * (x - mn) / (mx - mn) - 1 END, 6) AS y FROM t JOIN ts USING (t, d)")
def _(spark, sf):
    long = _long(spark, sf, 0, 14).withColumn("t", F.floor(F.col("dim") / 7).cast("long")).withColumn("d", F.col("dim") % 7)
    stats = vec.statistics(long, ["t", "d"])
    return long.join(F.broadcast(stats), ["t", "d"]).select("vec_id", "t", "d", r6(vec.normalise("min_max", F.col("x"), _sc()), "y"))


@query("p11_round_trip", f"WITH {S14} SELECT vec_id, dim, round(x, 6) AS min_max, round(x, 6) AS mean_std, round(greatest(q01, least(q99, x)), 6) AS q99 FROM j")
def _(spark, sf):
    j = _with_stats(spark, sf)
    back = [r6(vec.unnormalise(k, vec.normalise(k, F.col("x"), _sc()), _sc()), k) for k in ("min_max", "mean_std", "q99")]
    return j.select("vec_id", "dim", *back)


@query("p12_close_min_max", f"WITH {S14} SELECT vec_id, dim, round(CASE WHEN abs(mn - mx) <= 1e-8 + 1e-5 * abs(mx) THEN 0.0 ELSE 2 * (x - mn) / (mx - mn) - 1 END, 6) AS y, round(x, 6) AS back FROM j")
def _(spark, sf):
    y = vec.normalise_close(F.col("x"), F.col("min"), F.col("max"))
    return _with_stats(spark, sf).select("vec_id", "dim", r6(y, "y"), r6(vec.unnormalise_clipped(y, F.col("min"), F.col("max")), "back"))


@query("p13_masked_unnormalise", f"WITH {S14} SELECT vec_id, dim, round(CASE WHEN dim NOT IN (6, 13) THEN 0.5 * ({CLIP.format('x * 3')} + 1) * (mx - mn) + mn ELSE {CLIP.format('x * 3')} END, 6) AS y FROM j")
def _(spark, sf):
    j = _with_stats(spark, sf)
    return j.select("vec_id", "dim", r6(vec.masked_unnormalise(F.col("x") * 3, F.col("min"), F.col("max"), ~F.col("dim").isin(6, 13)), "y"))


@query("p14_masked_normalise", f"WITH {S14} SELECT vec_id, dim, round(CASE WHEN dim < 12 THEN {CLIP.format('2 * (x - mn) / (mx - mn + 1e-8) - 1')} ELSE CAST(CASE WHEN x > 0.5 THEN 1 ELSE 0 END AS DOUBLE) END, 6) AS y FROM j")
def _(spark, sf):
    return _with_stats(spark, sf).select("vec_id", "dim", r6(vec.masked_normalise(F.col("x"), F.col("min"), F.col("max"), F.col("dim") < 12), "y"))


@query("p15_sin_cos", f"WITH {VEC} SELECT vec_id, dim, round(sin(x), 6) AS y FROM vec WHERE dim < 6 UNION ALL SELECT vec_id, dim + 6, round(cos(x), 6) FROM vec WHERE dim < 6")
def _(spark, sf):
    v = vectors(spark, sf).withColumn("v", vec.sin_cos(vec.part(F.col("v"), 0, 6)))
    return vec.long_form(v, ["vec_id"], "v").select("vec_id", "dim", r6("x", "y"))


@query("p16_padded_state", f"WITH {VEC}, g AS (SELECT vec_id, unnest(generate_series(0, 7)) AS dim FROM embeddings) SELECT g.vec_id, g.dim, CASE WHEN g.vec_id % 4 <> 0 AND g.dim < 5 THEN vec.x ELSE 0.0 END AS x, g.vec_id % 4 <> 0 AND g.dim < 5 AS real FROM g JOIN vec ON vec.vec_id = g.vec_id AND vec.dim = g.dim")
def _(spark, sf):
    state = F.when(F.col("vec_id") % 4 != 0, vec.part(F.col("v"), 0, 5))
    z = vectors(spark, sf).select("vec_id", F.posexplode(F.arrays_zip(vec.padded(state, 8).alias("x"), vec.pad_mask(state, 8).alias("real"))).alias("dim", "z"))
    return z.select("vec_id", F.col("dim").cast("long").alias("dim"), "z.x", "z.real")


@query("p17_padded_action", f"WITH {VEC} SELECT vec_id, count(*) + 4 AS n, round(sum(x), 6) AS total FROM vec WHERE dim < 12 GROUP BY 1")
def _(spark, sf):
    v = vec.padded_or_error(vec.part(F.col("v"), 0, 12), 16)
    return vectors(spark, sf).select("vec_id", F.size(v).cast("long").alias("n"), r6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), "total"))


@query("p18_relative_joints", f"WITH {VEC} SELECT a.vec_id, a.dim, round(a.x - b.x, 6) AS rel, round(a.x, 6) AS back FROM vec a JOIN vec b ON a.vec_id = b.vec_id AND b.dim = a.dim + 7 WHERE a.dim < 7")
def _(spark, sf):
    v = vectors(spark, sf).select("vec_id", vec.part(F.col("v"), 0, 7).alias("a"), vec.part(F.col("v"), 7, 14).alias("s"))
    v = v.withColumn("r", vec.minus(F.col("a"), F.col("s"))).withColumn("b", vec.plus(F.col("r"), F.col("s")))
    z = v.select("vec_id", F.posexplode(F.arrays_zip("r", "b")).alias("dim", "z"))
    return z.select("vec_id", F.col("dim").cast("long").alias("dim"), r6("z.r", "rel"), r6("z.b", "back"))


@query("p20_delta_chunk", f"WITH {VEC} SELECT a.vec_id, a.dim // 4 AS t, a.dim % 4 AS d, round(a.x - coalesce(b.x, a.x), 6) AS y FROM vec a LEFT JOIN vec b ON a.vec_id = b.vec_id AND b.dim = a.dim - 4 WHERE a.dim < 16")
def _(spark, sf):
    chunk = F.array(*[vec.part(F.col("v"), 4 * k, 4 * k + 4) for k in range(4)])
    d = vectors(spark, sf).select("vec_id", F.posexplode(vec.deltas(chunk)).alias("t", "p"))
    return d.select("vec_id", F.col("t").cast("long").alias("t"), F.posexplode("p").alias("d", "y")).select("vec_id", "t", F.col("d").cast("long").alias("d"), r6("y", "y"))


Q4 = f"{VEC}, q AS (SELECT vec_id, max(x) FILTER (WHERE dim = 0) AS a, max(x) FILTER (WHERE dim = 1) AS b, max(x) FILTER (WHERE dim = 2) AS c, max(x) FILTER (WHERE dim = 3) AS d FROM vec GROUP BY 1), w AS (SELECT *, greatest(-1.0, least(1.0, d)) AS w FROM q), s AS (SELECT *, sqrt(1 - w * w) AS den FROM w), f AS (SELECT *, CASE WHEN den <= 1e-9 THEN 0.0 ELSE 2 * acos(w) / den END AS k FROM s)"


@query("p23_axis_angle", f"WITH {Q4} SELECT vec_id, round(a * k, 6) AS x, round(b * k, 6) AS y, round(c * k, 6) AS z FROM f")
def _(spark, sf):
    q = [F.col("v")[i] for i in range(4)]
    return vectors(spark, sf).select("vec_id", *[r6(c, n) for c, n in zip(vec.axis_angle(q), "xyz", strict=True)])


SM = f"{VEC}, e AS (SELECT vec_id, dim, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM vec WHERE dim < 11), sm AS (SELECT vec_id, dim, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"


@query("p27_expected_value", f"WITH {SM} SELECT vec_id, round(sum(p * (dim / 10.0 - 1)), 6) AS value, arg_max(dim, p) AS best FROM sm GROUP BY 1")
def _(spark, sf):
    p = returns.softmax(vec.part(F.col("v"), 0, 11))
    values = F.array(*[F.lit(k / 10.0 - 1) for k in range(11)])
    return vectors(spark, sf).withColumn("p", p).select("vec_id", r6(returns.expected(F.col("p"), values), "value"), returns.argmax(F.col("p")).alias("best"))


@query("p28_softmax", f"WITH {SM} SELECT vec_id, dim, round(p, 6) AS p FROM sm")
def _(spark, sf):
    v = vectors(spark, sf).withColumn("v", returns.softmax(vec.part(F.col("v"), 0, 11)))
    return vec.long_form(v, ["vec_id"], "v").select("vec_id", "dim", r6("x", "p"))


@query("p29_concatenated_statistics", f"WITH {VEC}, s AS (SELECT label, dim, avg(x) AS mean FROM vec WHERE dim < 8 GROUP BY 1, 2) SELECT label, count(*) AS n, round(sum(mean * (CASE WHEN dim >= 5 THEN dim - 5 ELSE dim + 3 END + 1)), 5) AS weighted FROM s GROUP BY 1")
def _(spark, sf):
    # sub-key b (dimensions 5 to 7) stands before sub-key a (0 to 4)
    s = vec.statistics(_long(spark, sf, 0, 8), ["label", "dim"]).withColumn("sub", F.when(F.col("dim") >= 5, 0).otherwise(1))
    m = vec.ordered_concat(s, ["label"], ["sub", "dim"], ["mean"])
    total = F.aggregate(F.transform("mean", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return m.select("label", F.size("mean").cast("long").alias("n"), F.round(total, 5).alias("weighted"))


@query("p30_action_mask", f"WITH {VEC} SELECT vec_id, dim, dim NOT IN (6, 13) AS real, CASE WHEN dim NOT IN (6, 13) THEN round(x, 6) END AS x FROM vec WHERE dim < 14")
def _(spark, sf):
    """Each vector's elements with the mask of its sub-keys; what the mask leaves out is null."""
    mask = vec.action_mask({"left_arm": 6, "left_gripper": 1, "right_arm": 6, "right_gripper": 1})
    both = vectors(spark, sf).select("vec_id", F.posexplode(F.arrays_zip(vec.part(F.col("v"), 0, 14).alias("x"), mask.alias("real"))).alias("dim", "e"))
    return both.select("vec_id", F.col("dim").cast("long").alias("dim"), "e.real", F.when(F.col("e.real"), r6(F.col("e.x"), "x")).alias("x"))


PAIR = f"{VEC}, pr AS (SELECT a.vec_id, a.x AS x, b.x AS y FROM vec a JOIN vec b ON a.vec_id = b.vec_id AND b.dim = a.dim + 32 WHERE a.dim < 32)"


@query("p31_distance", f"WITH {PAIR} SELECT vec_id, round(sqrt(sum((x - y) * (x - y))) / count(*), 6) AS d FROM pr GROUP BY 1")
def _(spark, sf):
    a, b = vec.part(F.col("v"), 0, 32), vec.part(F.col("v"), 32, 64)
    return vectors(spark, sf).select("vec_id", r6(vec.distance_share(a, b), "d"))


@query("p35_cosine_angle", f"WITH {PAIR}, c AS (SELECT vec_id, acos(greatest(-1.0, least(1.0, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))))) AS a FROM pr GROUP BY 1) SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM c")
def _(spark, sf):
    a, b = vec.part(F.col("v"), 0, 32), vec.part(F.col("v"), 32, 64)
    return vectors(spark, sf).select(vec.cosine_angle(a, b).alias("a")).agg(r6(F.avg("a"), "mean"), r6(F.stddev_pop("a"), "std"))


BOX = "b AS (SELECT p_partkey, CAST(p_partkey % 7 AS DOUBLE) AS x1, CAST(p_partkey % 5 AS DOUBLE) AS y1, p_partkey % 7 + 1.0 + p_size AS x2, p_partkey % 5 + 1.0 + p_size % 9 AS y2 FROM part)"


@query("p32_box_iou", f"WITH {BOX}, i AS (SELECT *, greatest(0.0, least(x2, 20.0) - greatest(x1, 2.0)) * greatest(0.0, least(y2, 8.0) - greatest(y1, 1.0)) AS w FROM b) SELECT p_partkey, round(CAST(w / ((x2 - x1) * (y2 - y1) + 126.0 - w) AS DOUBLE), 6) AS iou FROM i")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    a = [(k % 7).cast("double"), (k % 5).cast("double"), k % 7 + 1.0 + s, k % 5 + 1.0 + s % 9]
    return table(spark, sf, "part").select("p_partkey", r6(vec.box_iou(a, [F.lit(x) for x in (2.0, 1.0, 20.0, 8.0)]), "iou"))


def _uniform(place: int, seed: int, keys: str) -> str:
    return f"((('0x' || substring(md5('{seed}|' || {keys}), {place}, 13))::BIGINT + 1) / CAST(4503599627370496 AS DOUBLE))"


@query("p33_perturbation", f"WITH {VEC}, b AS (SELECT vec_id, min(x) AS lo, max(x) AS hi FROM vec GROUP BY 1) SELECT vec_id, dim, round(greatest(lo, least(hi, x + 0.1 * sqrt(-2 * ln({_uniform(1, 23, "vec_id || '|' || dim")})) * cos(2 * pi() * {_uniform(17, 23, "vec_id || '|' || dim")}))), 5) AS y FROM vec JOIN b USING (vec_id) WHERE dim < 14")
def _(spark, sf):
    """Noise by value: the same hashes give the same normal numbers in either engine."""
    noisy = vectors(spark, sf).select("vec_id", F.posexplode(F.slice(vec.noisy(F.col("v"), 0.1, 23, [F.col("vec_id")]), 1, 14)).alias("dim", "y"))
    return noisy.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("y", 5).alias("y"))


@query("p33_noise_moments", "SELECT true AS centred, true AS spread, count(*) AS vectors FROM embeddings")
def _(spark, sf):
    """Of noise that no range cuts off: mean and standard deviation over all elements, within five standard errors."""
    wide = vectors(spark, sf).select("vec_id", F.concat(F.array(F.lit(-99.0)), F.array_repeat(F.lit(0.0), 62), F.array(F.lit(99.0))).alias("v"))
    x = wide.select("vec_id", F.explode(F.slice(vec.noisy(F.col("v"), 0.5, 23, [F.col("vec_id")]), 2, 62)).alias("x"))
    m = x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("x").alias("n"), F.count_distinct("vec_id").alias("vectors"))
    err = F.lit(0.5) / F.sqrt("n")
    return m.select((F.abs("m") < 5 * err).alias("centred"), (F.abs(F.col("s") - 0.5) < 5 * err).alias("spread"), "vectors")


@query("p34_dropout", f"WITH {VEC} SELECT vec_id, round(sum(CASE WHEN {_uniform(1, 29, 'vec_id')} <= 0.3 THEN 0 ELSE x END), 6) AS total, {_uniform(1, 29, 'vec_id')} <= 0.3 AS zeroed FROM vec GROUP BY vec_id")
def _(spark, sf):
    """Which vectors are zeroed, and what is left of each."""
    d = vectors(spark, sf).withColumn("y", vec.dropped(F.col("v"), 0.3, 29, [F.col("vec_id")]))
    return d.select("vec_id", r6(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), "total"), F.forall("y", lambda x: x == 0).alias("zeroed"))


@query("p36_relative_to_absolute", f"WITH {S14}, s AS (SELECT vec_id, dim AS d, x AS ref FROM vec) SELECT j.vec_id, j.dim, round(CASE WHEN j.dim < 6 THEN 0.5 * ({CLIP.format('x')} + 1) * (mx - mn) + mn + ref ELSE {CLIP.format('x')} END, 6) AS y FROM j JOIN s ON s.vec_id = j.vec_id AND s.d = j.dim + 20")
def _(spark, sf):
    ref = _long(spark, sf, 20, 34).select("vec_id", (F.col("dim") - 20).alias("dim"), F.col("x").alias("ref"))
    j = _with_stats(spark, sf).join(ref, ["vec_id", "dim"])
    y = vec.masked_unnormalise(F.col("x"), F.col("min"), F.col("max"), F.col("dim") < 6)
    return j.select("vec_id", "dim", r6(F.when(F.col("dim") < 6, y + F.col("ref")).otherwise(y), "y"))


def _stats_sql(std: str = "stddev_pop(x)") -> str:
    return f"SELECT label, dim, count(*) AS n, round(avg(x), 6) AS mean, round({std}, 6) AS std, min(x) AS \"min\", max(x) AS \"max\", round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99 FROM vec GROUP BY 1, 2"


def _rounded(s, by):
    return s.select(*by, "n", "min", "max", *[r6(c, c) for c in ("mean", "std", "q01", "q99")])


@query("a1_vector_statistics", f"WITH {VEC} {_stats_sql()}")
def _(spark, sf):
    return _rounded(vec.statistics(_long(spark, sf), ["label", "dim"]), ["label", "dim"])


@query("a2_sample_statistics", f"WITH {VEC} {_stats_sql('CASE WHEN count(*) <= 1 THEN 1.0 ELSE sqrt(greatest(var_samp(x), 1e-8)) END')}")
def _(spark, sf):
    return _rounded(vec.statistics(_long(spark, sf), ["label", "dim"], "sample"), ["label", "dim"])


@query("a3_merged_partials", f"WITH {VEC} SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(sqrt(greatest(0.0, avg(x * x) - avg(x) * avg(x))), 6) AS std, min(x) AS q01, max(x) AS q99 FROM vec GROUP BY dim")
def _(spark, sf):
    m = vec.merge_partials(vec.partials(_long(spark, sf), ["label", "dim"]), ["dim"])
    return m.select("dim", "n", r6("mean", "mean"), r6("std", "std"), "q01", "q99")


MERGE = f"{VEC}, s AS (SELECT label, dim, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99, label + 1.0 AS w FROM vec WHERE NOT (label = 3 AND dim < 5) GROUP BY label, dim), m AS (SELECT dim, sum(w * mean) / sum(w) AS mean, sum(w * (std * std + mean * mean)) / sum(w) AS second, min(mn) AS mn, max(mx) AS mx, sum(w * q01) / sum(w) AS q01, sum(w * q99) / sum(w) AS q99 FROM s GROUP BY dim)"


@query("a4_weighted_merge", f'WITH {MERGE} SELECT dim, round(mean, 6) AS mean, round(sqrt(greatest(0.0, second - mean * mean)), 6) AS std, mn AS "min", mx AS "max", round(q01, 6) AS q01, round(q99, 6) AS q99 FROM m')
def _(spark, sf):
    s = vec.statistics(_long(spark, sf).where("not (label = 3 and dim < 5)"), ["label", "dim"]).withColumn("w", F.col("label") + 1.0)
    m = vec.merge_weighted(s, ["dim"], "w")
    return m.select("dim", "min", "max", *[r6(c, c) for c in ("mean", "std", "q01", "q99")])


REL = f"{VEC}, r AS (SELECT a.vec_id AS i, b.vec_id - a.vec_id AS t, a.dim, b.x - a.x AS x FROM vec a JOIN vec b ON b.dim = a.dim AND b.label = b.label AND b.vec_id BETWEEN a.vec_id AND a.vec_id + 3 WHERE a.dim < 6 AND a.vec_id < (SELECT max(vec_id) FROM embeddings) - 2)"


@query("a5_relative_statistics", f'WITH {REL} SELECT t, dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS "min", max(x) AS "max", round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99 FROM r GROUP BY t, dim')
def _(spark, sf):
    v = vectors(spark, sf).select("vec_id", vec.part(F.col("v"), 0, 6).alias("v"))
    last = v.agg(F.max("vec_id").alias("last"))
    start = v.join(F.broadcast(last), F.col("vec_id") < F.col("last") - 2).select(F.col("vec_id").alias("i"), F.col("v").alias("s"))
    ahead = start.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("vec_id", F.col("i") + F.col("t")).join(v, "vec_id")
    long = ahead.select("t", F.posexplode(vec.minus(F.col("v"), F.col("s"))).alias("dim", "x")).select(F.col("t").cast("long").alias("t"), F.col("dim").cast("long").alias("dim"), "x")
    return _rounded(vec.statistics(long, ["t", "dim"]), ["t", "dim"])


@query("k5_statistics_document", f"WITH {VEC} SELECT label AS tag, dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS least, round(max(x), 6) AS most, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99 FROM vec WHERE dim < 3 GROUP BY 1, 2")
def _(spark, sf):
    s = vec.statistics(_long(spark, sf, 0, 3), ["label", "dim"]).withColumn("key", F.lit("action")).withColumnRenamed("label", "tag")
    doc = writers.statistics_document(s, "tag", "key", ["dim"], ["mean", "std", "min", "max", "q01", "q99"])
    kinds = ("mean", "std", "min", "max", "q01", "q99")
    read = doc.select("tag", F.from_json("json", f"action struct<{','.join(f'{k}:array<double>' for k in kinds)}>")["action"].alias("a"))
    each = read.select("tag", F.posexplode(F.arrays_zip(*[F.col(f"a.{k}").alias(k) for k in kinds])).alias("dim", "s"))
    return each.select("tag", F.col("dim").cast("long").alias("dim"), *[r6(F.col(f"s.{k}"), {"min": "least", "max": "most"}.get(k, k)) for k in kinds])


@query("r8_transform_chain", f"WITH {S14} SELECT vec_id, round(sum(x), 5) AS total FROM j GROUP BY 1")
def _(spark, sf):
    """Slice, normalise, join and back again, in reverse order."""
    j = _with_stats(spark, sf).withColumn("y", vec.normalise("min_max", F.col("x"), _sc())).withColumn("z", vec.unnormalise("min_max", F.col("y"), _sc()))
    return j.groupBy("vec_id").agg(F.round(F.sum("z"), 5).alias("total"))


# rotations and poses --------------------------------------------------------------------------------------------------
def _e(i: int) -> str:
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


def _unit(names: str, place: int) -> str:
    """The quaternion at a place of the vector, of length 1, as columns."""
    size = " + ".join(f"{_e(place + k)} * {_e(place + k)}" for k in range(4))
    return ", ".join(f"{_e(place + k)} / sqrt({size}) AS {n}" for k, n in enumerate(names.split()))


#: Of a unit quaternion x, y, z, w, the rows of its matrix.
MATRIX = ["1 - 2 * ({y} * {y} + {z} * {z})", "2 * ({x} * {y} - {z} * {w})", "2 * ({x} * {z} + {y} * {w})", "2 * ({x} * {y} + {z} * {w})", "1 - 2 * ({x} * {x} + {z} * {z})", "2 * ({y} * {z} - {x} * {w})", "2 * ({x} * {z} - {y} * {w})", "2 * ({y} * {z} + {x} * {w})", "1 - 2 * ({x} * {x} + {y} * {y})"]


def _m(i: int, **names: str) -> str:
    return "(" + MATRIX[i].format(**names) + ")"


_R = {"x": "rx", "y": "ry", "z": "rz", "w": "rw"}
P19 = f"""WITH q AS (SELECT vec_id, {_unit("rx ry rz rw", 3)}, {_unit("px py pz pw", 10)}, {", ".join(f"{_e(7 + i)} - {_e(i)} AS d{i}, {_e(7 + i)} AS b{i}" for i in range(3))} FROM embeddings),
r AS (SELECT *, rw * px - rx * pw - ry * pz + rz * py AS x, rw * py + rx * pz - ry * pw - rz * px AS y, rw * pz - rx * py + ry * px - rz * pw AS z, rw * pw + rx * px + ry * py + rz * pz AS w FROM q)
SELECT vec_id, {", ".join(f"round({' + '.join(f'{_m(3 * k + i, **_R)} * d{k}' for k in range(3))}, 6) AS r{i}" for i in range(3))},
{", ".join(f"round(CASE WHEN w < 0 THEN -{c} ELSE {c} END, 6) AS r{3 + i}" for i, c in enumerate("xyzw"))}, {", ".join(f"round(b{i}, 6) AS b{i}" for i in range(3))} FROM r"""
P21 = f"""WITH a AS (SELECT vec_id, {", ".join(f"{_e(14 + i)} AS a{i}, {_e(17 + i)} AS b{i}" for i in range(3))} FROM embeddings),
x AS (SELECT *, {", ".join(f"a{i} / sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS x{i}" for i in range(3))} FROM a),
o AS (SELECT *, {", ".join(f"b{i} - (x0 * b0 + x1 * b1 + x2 * b2) * x{i} AS o{i}" for i in range(3))} FROM x),
y AS (SELECT *, {", ".join(f"o{i} / sqrt(o0 * o0 + o1 * o1 + o2 * o2) AS y{i}" for i in range(3))} FROM o)
SELECT vec_id, {", ".join(f"round({v}, 6) AS m{i}" for i, v in enumerate(["x0", "x1", "x2", "y0", "y1", "y2", "x1 * y2 - x2 * y1", "x2 * y0 - x0 * y2", "x0 * y1 - x1 * y0"]))} FROM y"""
P22 = f"""WITH q AS (SELECT vec_id, {_unit("rx ry rz rw", 3)} FROM embeddings), s AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS s FROM q)
SELECT vec_id, round(atan2(-{_m(5, **_R)}, {_m(8, **_R)}), 6) AS e0, round(asin(greatest(-1, least(1, {_m(2, **_R)}))), 6) AS e1, round(atan2(-{_m(1, **_R)}, {_m(0, **_R)}), 6) AS e2,
{", ".join(f"round(CASE WHEN rw < 0 THEN -{c} ELSE {c} END * 2 * atan2(s, abs(rw)) / s, 6) AS a{i}" for i, c in enumerate(("rx", "ry", "rz")))} FROM s"""
P24 = f"""WITH q AS (SELECT vec_id // 10 AS chunk, CAST(vec_id % 10 AS DOUBLE) AS t, {", ".join(f"{_e(i)} AS p{i}" for i in range(3))}, {_unit("p3 p4 p5 p6", 3)} FROM embeddings),
n AS (SELECT *, {", ".join(f"lead(p{i}) OVER w AS n{i}, lag(p{i}) OVER w AS l{i}" for i in range(7))}, lead(t) OVER w AS nt, lag(t) OVER w AS lt FROM q WINDOW w AS (PARTITION BY chunk ORDER BY t)),
d AS (SELECT *, CASE WHEN {" + ".join(f"p{i} * n{i}" for i in range(3, 7))} < 0 THEN -1 ELSE 1 END AS g, CASE WHEN nt IS NULL AND lt IS NOT NULL AND {" + ".join(f"p{i} * l{i}" for i in range(3, 7))} < 0 THEN -1 ELSE 1 END AS h FROM n),
m AS (SELECT *, sqrt({" + ".join(f"(p{i} + g * n{i}) * (p{i} + g * n{i})" for i in range(3, 7))}) AS size FROM d)
SELECT chunk, t, {", ".join(f"round({'' if i < 3 else 'h * '}p{i}, 6) AS p{i}" for i in range(7))} FROM m
UNION ALL SELECT chunk, t + 0.5, {", ".join(f"round((p{i} + n{i}) / 2, 6)" if i < 3 else f"round((p{i} + g * n{i}) / size, 6)" for i in range(7))} FROM m WHERE nt IS NOT NULL"""


def _poses(spark, sf):
    return vectors(spark, sf).select("vec_id", vec.part(F.col("v"), 0, 7).alias("ref"), vec.part(F.col("v"), 7, 14).alias("pose"), vec.part(F.col("v"), 14, 20).alias("r6"))


@query("p19_relative_pose", P19)
def _(spark, sf):
    p = _poses(spark, sf).withColumn("rel", pose.relative_pose(F.col("ref"), F.col("pose"))).withColumn("back", pose.absolute_pose(F.col("ref"), F.col("rel")))
    return p.select("vec_id", *[r6(F.col("rel")[i], f"r{i}") for i in range(7)], *[r6(F.col("back")[i], f"b{i}") for i in range(3)])


@query("p21_rotation_6d", P21)
def _(spark, sf):
    m = pose.convert(F.col("r6"), "rotation_6d", "matrix")
    return _poses(spark, sf).withColumn("m", m).select("vec_id", *[r6(F.col("m")[i], f"m{i}") for i in range(9)])


@query("p22_rotation_conversion", P22)
def _(spark, sf):
    p = _poses(spark, sf).withColumn("e", pose.convert(vec.part(F.col("ref"), 3, 7), "quaternion", "euler_xyz")).withColumn("a", pose.convert(F.col("e"), "euler_xyz", "axis_angle"))
    return p.select("vec_id", *[r6(F.col("e")[i], f"e{i}") for i in range(3)], *[r6(F.col("a")[i], f"a{i}") for i in range(3)])


@query("p24_pose_interpolation", P24)
def _(spark, sf):
    v = vectors(spark, sf).select((F.floor(F.col("vec_id") / 10)).cast("long").alias("chunk"), (F.col("vec_id") % 10).cast("double").alias("t"), vec.part(F.col("v"), 0, 7).alias("p"))
    v = v.withColumn("p", F.concat(vec.part(F.col("p"), 0, 3), F.transform(vec.part(F.col("p"), 3, 7), lambda x: x / vec.norm(vec.part(F.col("p"), 3, 7)))))
    ends = v.groupBy("chunk").agg(F.max("t").alias("last"))
    grid = ends.select("chunk", F.explode(F.transform(F.sequence(F.lit(0), (F.col("last") * 2).cast("int")), lambda i: i / 2)).alias("t"))
    out = pose.interpolate_chunks(v, "chunk", "t", "p", grid, True)
    return out.select("chunk", "t", *[r6(F.col("p")[i], f"p{i}") for i in range(7)])
