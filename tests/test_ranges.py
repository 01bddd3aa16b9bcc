"""Order statistics, ranks, windows and as-of joins where one group holds most rows, over many ranges."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.operators import alignment, metrics, ranges, returns, steps
from stridewell.operators import vectors as vec


@pytest.fixture
def many(spark):
    """More ranges than the session's, and no merging of small ones."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(seed, n=3000):
    """g, id, x: one group has nine tenths of the rows, one value a third, some values and one group's key are null."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None, "one"])
        x = None if rng.random() < 0.02 else 5.0 if rng.random() < 0.33 else rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), float(rng.randint(-3, 3))])
        out.append((g, i, x))
    return out + [("single", n, 1.5), ("empty", n + 1, None)]


def grouped(rows):
    out = {}
    for g, i, x in rows:
        out.setdefault(g, []).append((i, x))
    return out


@pytest.mark.parametrize("accuracy", [10_000, 2])
def test_quantiles_are_exact(many, monkeypatch, accuracy):
    """Whatever the sketch proposes: with an accuracy of 2 its stretches are far off."""
    monkeypatch.setattr(ranges, "ACCURACY", accuracy)
    rows, points = rows_of(1), {"p0": 0.0, "p01": 0.01, "p33": 1 / 3, "p50": 0.5, "p99": 0.99, "p1": 1.0}
    df = many.createDataFrame(rows, "g string, id long, x double")
    got = {r["g"]: r for r in ranges.quantiles(df, ["g"], "x", points, F.max("x").alias("top")).collect()}
    assert set(got) == {"hot", "a", "b", None, "one", "single", "empty"}
    for g, mine in grouped(rows).items():
        have = [x for _, x in mine if x is not None]
        assert got[g]["n"] == len(have)
        for k, p in points.items():
            assert got[g][k] is None if not have else math.isclose(got[g][k], np.quantile(have, p), rel_tol=1e-12, abs_tol=1e-12)
    whole = ranges.quantiles(df, [], "x", points).collect()
    assert len(whole) == 1 and math.isclose(whole[0]["p33"], np.quantile([x for *_, x in rows if x is not None], 1 / 3), rel_tol=1e-12)
    assert ranges.quantiles(df.limit(0), [], "x", points).collect()[0]["p50"] is None
    assert ranges.quantiles(df.limit(0), ["g"], "x", points).count() == 0


def test_no_percentile_over_all_values(spark):
    """What is aggregated are counts and a sketch; the only sort is of different values in a stretch."""
    df = spark.createDataFrame(rows_of(2, 50), "g string, id long, x double")
    for out in (metrics.distribution(df, "x", ["g"], {"p50": 0.5}), vec.statistics(df.withColumnRenamed("g", "dim"), ["dim"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile_approx" in plan and " percentile(" not in plan


@pytest.mark.parametrize(("fraction", "threshold", "least"), [(0.4, 0.0, 1), (0.3, 0.25, 3), (1.0, -1e9, 1), (0.001, 4.0, 40), (0.5, 1e12, 2)])
def test_top_fraction_of_a_hot_task(many, fraction, threshold, least):
    rows = rows_of(3)
    df = many.createDataFrame(rows, "g string, id long, x double").withColumn("other", F.lit(1))
    out = returns.top_fraction(df, "g", "x", "id", fraction, threshold, least)
    assert out.columns == ["g", "id", "x", "other", "label"]
    got = {r["id"]: r["label"] for r in out.collect()}
    assert len(got) == len(rows)
    for mine in grouped(rows).values():
        best = sorted((-x, i) for i, x in mine if x is not None and x > threshold)
        k = min(len(best), max(least, math.ceil(fraction * len(best))))
        assert {i for i, _ in mine if got[i]} == {i for _, i in best[:k]}


@pytest.mark.parametrize("segment", [100, 1 << 16])
@pytest.mark.parametrize("size", [1, 100])
def test_moving_average_of_a_hot_group(many, monkeypatch, segment, size):
    monkeypatch.setattr(ranges, "SEGMENT", segment)
    rows = [(g, i, x) for g, i, x in rows_of(4) if x is not None]
    df = many.createDataFrame(rows, "g string, id long, x double")
    got = {r["id"]: r["smooth"] for r in steps.moving_average(df, "x", ["id"], ["g"], size).collect()}
    want = {}
    for mine in grouped(rows).values():
        if len(mine) > size:
            for k in range(size - 1, len(mine)):
                want[mine[k][0]] = float(np.mean([x for _, x in mine[k - size + 1 : k + 1]]))
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-6) for i in want)


def test_running_sums_and_numbers_of_groups(many):
    rows = [(g, i, i % 7) for g, i, _ in rows_of(5)]
    df = many.createDataFrame(rows, "g string, id long, n long")
    got = {r["id"]: (r["start"], r["k"]) for r in steps.start_index(ranges.numbered(df, ["id"], "k", ["g"]), "n", ["id"], ["g"]).collect()}
    for mine in grouped(rows).values():
        for k, (i, _) in enumerate(mine):
            assert got[i] == (sum(n for _, n in mine[:k]), k)


def test_average_ranks_of_a_hot_group(many):
    rows = rows_of(6)
    df = many.createDataFrame(rows, "g string, id long, x double")
    got = {r["id"]: r["r"] for r in metrics.average_rank(df, "x", "r", ["g"]).collect()}
    assert len(got) == len(rows)
    for mine in grouped(rows).values():
        order = sorted((-math.inf if x is None else x) for _, x in mine)  # nulls come first
        for i, x in mine:
            v = -math.inf if x is None else x
            assert got[i] == (bisect.bisect_left(order, v) + bisect.bisect_right(order, v) - 1) / 2


@pytest.mark.parametrize("shape", ["dense", "sparse", "ties", "one side"])
def test_asof_joins_of_a_hot_group(many, shape):
    """Ranges without any frame take what the nearest range that has one holds."""
    rng = random.Random(shape)
    groups = ["hot"] * 9 + ["a", None]
    span = {"dense": 500, "ties": 20}.get(shape, 10_000)
    probes = [(rng.choice(groups), rng.randrange(span), i) for i in range(800)]
    frames = [(rng.choice(groups), rng.randrange(span) if shape != "one side" else span // 2, i) for i in range(5 if shape == "sparse" else 600)]
    p, f = many.createDataFrame(probes, "g string, t long, id long"), many.createDataFrame(frames, "g string, t long, id long")
    back = {r["probe"]: (r["frame"], r["probe_time"]) for r in alignment.asof_backward(p, f, ["g"], "t", "id").collect()}
    fore = {r["probe"]: r["frame"] for r in alignment.asof_forward(p, f, ["g"], "t", "id").collect()}
    near = {r["probe"]: r["frame"] for r in alignment.asof_nearest(p, f, ["g"], "t", "id").collect()}
    assert len(back) == len(fore) == len(near) == len(probes)
    for g, t, i in probes:
        mine = [(ft, fi) for fg, ft, fi in frames if fg == g]
        before, after = max((x for x in mine if x[0] <= t), default=None), min((x for x in mine if x[0] >= t), default=None)
        assert back[i] == (before and before[1], t)
        assert fore[i] == ((after or max(mine, default=None)) or (None, None))[1]
        best = min(mine, key=lambda x: (abs(x[0] - t), x[0], x[1]), default=None)
        assert near[i] == (best and best[1])
