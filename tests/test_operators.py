"""Golden values, invariants and edge cases of the operators."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stridewell.functions import pose
from stridewell.functions import text as tx
from stridewell.operators import alignment, metrics, ranges, returns, sampling, steps
from stridewell.operators import vectors as vec
from stridewell.sources import readers, writers


def episode(spark, n, success):
    return spark.range(n).select(F.lit(1).alias("e"), F.col("id").alias("step"), F.lit(success).alias("ok"))


def values(df, column, order="step"):
    return [r[0] for r in df.orderBy(order).select(column).collect()]


def test_golden_returns(spark):
    assert values(returns.return_to_go(episode(spark, 4, True), "e", "ok", 10), "return_to_go") == [-3, -2, -1, 0]
    assert values(returns.return_to_go(episode(spark, 4, False), "e", "ok", 10), "return_to_go") == [-13, -12, -11, -10]


def test_golden_normalised(spark):
    df = returns.return_to_go(episode(spark, 400, True), "e", "ok", 10)
    got = values(df.select("step", returns.normalised(F.col("return_to_go"), F.lit(1199.0)).alias("v")), "v")
    assert got[-1] == 0 and got[-2] == pytest.approx(-1 / 1199)
    df = returns.return_to_go(episode(spark, 1200, False), "e", "ok", 1200)
    got = values(df.select("step", returns.normalised(F.col("return_to_go"), F.lit(1199.0)).alias("v")), "v")
    assert got[0] == got[-1] == got[-2] == -1


def test_discount_matches_recursion(spark):
    got = values(returns.return_to_go(episode(spark, 30, False), "e", "ok", 7, 0.9), "return_to_go")
    want = [-7.0]
    for _ in range(29):
        want.append(-1 + 0.9 * want[-1])
    assert got == pytest.approx(want[::-1])


def test_success_resolution(spark):
    frames = spark.createDataFrame([(1, 0, False), (1, 1, True), (2, 0, None), (3, 0, None)], "e int, step int, success boolean")
    meta = spark.createDataFrame([(2, False)], "e int, success boolean")
    got = {r["e"]: r["success"] for r in returns.resolve_success(frames, meta, "e", ["success_col", "success"]).collect()}
    assert got[2] is False and got[3] is True and got[1] is False


def test_ahead_ignores_gaps(spark):
    df = spark.createDataFrame([(1, s, float(s)) for s in (0, 1, 3)], "e int, step long, v double")
    assert values(returns.ahead(df, ["e"], "step", 2, {"n": "v"}), "n") == [None, 3.0, None]


def test_labels_count(spark):
    rows = [("a", i, float(i)) for i in range(10)] + [("b", 1, -1.0), ("c", 1, 1.0), ("c", 2, 1.0)]
    df = spark.createDataFrame(rows, "task string, pos int, adv double")
    got = returns.top_fraction(df, "task", "adv", "pos", 0.4).where("label = 1").groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    assert {(r["task"], r["n"], r["p"]) for r in got.collect()} == {("a", 4, 6), ("c", 1, 1)}


def test_rounding_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,), (99.0,)], "v double")
    assert [r[0] for r in df.select(returns.value_bin(F.col("v"), 0.0, 10.0, 11)).collect()] == [0, 2, 2, 0, 10]


def test_windows_padding(spark):
    df = spark.createDataFrame([(1, i, float(i + 1)) for i in range(3)], "e int, step long, v double")
    def at(pad):
        return {(r["step"], r["offset"]): r["v"] for r in steps.offset_windows(df, "e", "v", [-1, 0, 1], pad).collect()}
    assert at("first_last")[0, -1] == 1 and at("first_last")[2, 1] == 3
    assert at("zero")[0, -1] == 0 and at("zero")[2, 1] == 0 and at("zero")[1, 0] == 2
    with pytest.raises(ValueError):
        at("other")


def test_lookup_of_unknown_key_fails(spark):
    df = spark.createDataFrame([(1,), (9,)], "k int")
    table = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="unknown key"):
        steps.lookup(df, table, "k", "v").collect()


def test_running_sum_over_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v")).repartition(13)
    got = ranges.running_sum(df, "v", ["id"], "s").orderBy("id").toPandas()
    assert (got["s"].to_numpy() == np.cumsum(np.arange(5000) % 7)).all()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 60))
def test_greedy_matches_loop(spark, lengths, target):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "g int, i int, n int")
    got = [r["i"] for r in sampling.greedy(df, "n", ["i"], target, ["g"]).orderBy("i").collect()]
    want, total = [], 0
    for i, n in enumerate(lengths):
        if total >= target:
            break
        if want and total + n > target and abs(total - target) < abs(total + n - target):
            break
        want.append(i)
        total += n
    assert got == want


def test_cycles_reach_target(spark):
    df = spark.createDataFrame([(i, 10) for i in range(5)], "i int, n int")
    assert sampling.cycled(df, ["i"], "n", 1, 120).agg(F.sum("n")).first()[0] == 120
    assert sampling.cycled(df.where("i > 9"), ["i"], "n", 1, 120).count() == 0


def test_split_is_disjoint(spark):
    df = spark.range(101)
    got = sampling.split(df, ["id"], 3, 0.8).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 80, "val": 10, "test": 11}
    assert sampling.shuffled(df, ["id"], 3).select("place").distinct().count() == 101


def test_asof_against_brute_force(spark):
    rng = np.random.default_rng(5)
    frames = [(g, int(t), i) for i, (g, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 40, 60), strict=True))]
    probes = [(g, int(t), i) for i, (g, t) in enumerate(zip(rng.integers(0, 4, 40), rng.integers(0, 45, 40), strict=True))]
    f, p = (spark.createDataFrame([(int(a), b, c) for a, b, c in x], "g int, t long, id int") for x in (frames, probes))
    near = {r["probe"]: r["frame_time"] for r in alignment.asof_nearest(p, f, ["g"], "t", "id").collect()}
    back = {r["probe"]: r["frame_time"] for r in alignment.asof_backward(p, f, ["g"], "t", "id").collect()}
    fore = {r["probe"]: r["frame_time"] for r in alignment.asof_forward(p, f, ["g"], "t", "id").collect()}
    for g, t, i in probes:
        times = sorted(x[1] for x in frames if x[0] == g)
        assert near[i] == (min(times, key=lambda x: (abs(x - t), x)) if times else None)
        assert back[i] == max((x for x in times if x <= t), default=None)
        assert fore[i] == (min((x for x in times if x >= t), default=times[-1]) if times else None)


def test_normalisers_and_inverses(spark):
    df = spark.createDataFrame([([1.0, 5.0, 3.0], [0.0, 5.0, 1.0], [4.0, 5.0, 5.0])], "x array<double>, min array<double>, max array<double>")
    s = {"min": F.col("min"), "max": F.col("max")}
    r = df.select(vec.normalise_array("min_max", F.col("x"), s).alias("y"), "min", "max").select("y", vec.unnormalise_array("min_max", F.col("y"), s).alias("b")).first()
    assert r["y"] == [-0.5, 0.0, 0.0] and r["b"] == [1.0, 5.0, 3.0]
    with pytest.raises(ValueError):
        vec.normalise("none", F.col("x"), s)
    with pytest.raises(ValueError):
        vec.unnormalise("scale", F.col("x"), s)


def test_vector_sizes_are_checked(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    with pytest.raises(Exception, match="elements"):
        df.select(vec.joined([F.col("v")], [3])).collect()
    with pytest.raises(Exception, match="elements"):
        df.select(vec.padded_or_error(F.col("v"), 1)).collect()
    assert df.select(vec.padded(F.col("v"), 3), vec.pad_mask(F.col("v"), 3)).first()[:] == ([1.0, 2.0, 0.0], [True, True, False])


def test_statistics_match_numpy(spark):
    x = np.random.default_rng(1).normal(size=(50, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    got = vec.statistics(vec.long_form(df, ["i"], "v"), ["dim"]).orderBy("dim").toPandas()
    assert np.allclose(got["std"], x.std(0)) and np.allclose(got["q01"], np.quantile(x, 0.01, 0)) and np.allclose(got["q99"], np.quantile(x, 0.99, 0))


def test_weighted_merge_is_pooled(spark):
    x = np.random.default_rng(2).normal(size=90)
    parts = [(n, float(len(p)), float(p.mean()), float(p.std()), float(p.min()), float(p.max()), 0.0, 0.0) for n, p in (("a", x[:30]), ("b", x[30:]))]
    df = spark.createDataFrame(parts, "d string, w double, mean double, std double, min double, max double, q01 double, q99 double").withColumn("dim", F.lit(0))
    r = vec.merge_weighted(df, ["dim"], "w").first()
    assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std())


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 3)], "i int, v int").withColumn("g", F.lit(0))
    assert values(metrics.average_rank(df, "v", "r", ["g"]), "r", "i") == [0, 1.5, 1.5, 3]


def test_buckets_close_the_last(spark):
    df = spark.createDataFrame([(-600.0,), (-50.0,), (0.0,), (1.0,), (-700.0,)], "v double")
    assert [r[0] for r in df.select(metrics.bucket(F.col("v"), [-600.0, -50.0, 0.0])).collect()] == [0, 1, 1, None, None]


@pytest.mark.parametrize("kind", [k for k in pose.KINDS if k != "matrix"])
def test_rotation_round_trips(kind):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(40, 4))
    m = pose.quaternion_to_matrix(q)
    assert np.allclose(m @ np.swapaxes(m, -1, -2), np.eye(3), atol=1e-9)
    assert np.allclose(pose.to_matrix(pose.from_matrix(m, kind), kind), m, atol=1e-7)


def test_relative_pose_identity():
    rng = np.random.default_rng(4)
    a, b = (np.concatenate([rng.normal(size=(20, 3)), pose.matrix_to_quaternion(pose.quaternion_to_matrix(rng.normal(size=(20, 4))))], 1) for _ in range(2))
    assert np.allclose(pose.absolute(a, pose.relative(a, b)), b, atol=1e-9)
    assert np.allclose(pose.relative(a, a), [[0, 0, 0, 0, 0, 0, 1]], atol=1e-9)


def test_interpolation():
    times, points = np.array([0.0, 1.0, 1.0, 2.0]), np.array([[0.0], [10.0], [99.0], [20.0]])
    assert pose.interpolate(times, points, np.array([0.5, 1.5]), False).ravel().tolist() == [5.0, 15.0]
    with pytest.raises(ValueError):
        pose.interpolate(times, points, np.array([3.0]), False)
    half = pose.slerp(np.array([[0, 0, 0, 1.0]]), np.array([[0, 0, 1.0, 0]]), np.array([[0.5]]))
    assert np.allclose(half, [[0, 0, np.sqrt(0.5), np.sqrt(0.5)]])


def test_text_functions(spark):
    rows = [("a@ b ",), ("x@null",), ("  ",), ("plain",), (None,), ("a@b@c",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(tx.task_text(F.col("t"))).collect()] == ["b", None, None, "plain", None, "b@c"]
    names = spark.createDataFrame([("..a b//c__d..",), ("///",)], "t string")
    assert [r[0] for r in names.select(tx.safe_name(F.col("t"))).collect()] == ["a_b_c_d", None]
    with pytest.raises(Exception, match="no name"):
        names.select(tx.safe_name_or_error(F.col("t"))).collect()
    js = spark.createDataFrame([('x {"a": {"b": 1}} y',), ("{broken",), ("none",)], "t string")
    assert [r[0] for r in js.select(tx.embedded_json(F.col("t"))).collect()] == ['{"a": {"b": 1}}', None, None]


def test_files_round_trip(spark, tmp_path):
    root = f"{tmp_path}/set"
    frames = spark.createDataFrame([(e, s, float(s)) for e in (7, 3) for s in range(3)], "episode int, step long, v double")
    eps = frames.select("episode").distinct()
    out = writers.rekeyed(frames, eps, "episode", ["episode"], "step")
    writers.write_episodes(out, f"{root}/data", "episode", 1000)
    back = readers.episodes(spark, root, ["episode", "step", "index"])
    assert [tuple(r) for r in back.select("episode", "step", "index", "dataset_key").orderBy("index").collect()] == [(e, s, e * 3 + s, "set") for e in range(2) for s in range(3)]
    (tmp_path / "t.jsonl").write_text('{"task_index": 1, "task": "a"}\n\n{"task_index": 2, "task": "b"}\n')
    assert readers.json_lines(spark, f"{tmp_path}/t.jsonl").count() == 2
    (tmp_path / "d.json").write_text('{"n_step": 3,\n "advantages": [{"step": 0}, {"step": 1}]}')
    assert [tuple(r) for r in readers.json_document(spark, f"{tmp_path}/d.json", "advantages").orderBy("step").collect()] == [(3, 0), (3, 1)]
    (tmp_path / "run.log").write_text("env_name=a/B\nsuccess rate: 0.25\nsuccess rate: 0.5\n")
    log = readers.logs(spark, f"{tmp_path}/run.log", r"success rate: ([0-9.]+)", r"env_name=(\S+)").first()
    assert (log["name"], log["value"]) == ("a/B", 0.5)
    (tmp_path / "set" / "meta").mkdir()
    (tmp_path / "set" / "meta" / "modality.json").write_text("{}")
    assert readers.data_sets(spark, str(tmp_path)).count() == 1
    (tmp_path / "empty.mp4").write_bytes(b"")
    wanted = spark.createDataFrame([(f"file:{tmp_path}/empty.mp4",), (f"file:{tmp_path}/no.mp4",), (f"file:{tmp_path}/run.log",)], "path string")
    assert {r["state"] for r in readers.health(spark, wanted, "path", str(tmp_path)).collect()} == {"empty", "missing", "ok"}
    made = []
    for _ in range(2):
        readers.kept(spark, f"{tmp_path}/kept", "k", lambda: made.append(1) or frames)
    assert made == [1]


def test_streams_match_batches(spark, tmp_path):
    from stridewell.streaming import stateful

    rows = [(e, s, float(s * s % 5)) for s in range(6) for e in (1, 2)]
    for k in range(3):
        part = [r for r in rows if r[1] // 2 == k]
        pd.DataFrame({"e": [r[0] for r in part], "step": [r[1] for r in part], "v": [r[2] for r in part]}).to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema("e long, step long, v double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path))
    q = stateful.history_stream(stream, "e", "step", "v", 3).writeStream.format("memory").queryName("hist").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["e"], r["step"]): list(r["history"]) for r in spark.table("hist").collect()}
    batch = steps.history(spark.createDataFrame(rows, "e long, step long, v double"), "e", "v", 3)
    assert got == {(r["e"], r["step"]): list(r["history"]) for r in batch.collect()}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "e int, step long, v double, ok boolean")
    assert returns.return_to_go(df, "e", "ok", 1).count() == 0
    assert steps.offset_windows(df, "e", "v", [0]).count() == 0
    assert ranges.running_sum(df, "v", ["step"], "s").count() == 0
    assert sampling.greedy(df, "v", ["step"], 5).count() == 0
    assert metrics.fit(df.withColumn("p", F.lit(1.0)), "p", "v", ["e"]).count() == 0


def test_alignment_edges(spark):
    """A probe keeps its own time whatever the slack; grid steps in floating point; a span without steps labels none."""
    probes = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0000004)], "g int, id int, t double")
    seen = spark.createDataFrame([(1, 1, 0.5), (1, 2, 2.0), (1, 3, 3.0)], "g int, id int, t double")
    got = {r.probe: (r.probe_time, r.frame) for r in alignment.asof_forward(probes, seen, ["g"], "t", "id", 1e-6).collect()}
    assert got == {10: (1.0, 2), 11: (2.0000004, 2)}
    grid = alignment.resample(spark.createDataFrame([(1, i, 0.1 * i) for i in range(30)], "g int, id int, t double"), ["g"], "t", "id", 0.1)
    assert {r.slot: r.frame for r in grid.collect()} == {i: i for i in range(30)}
    spans = spark.createDataFrame([(1, "a", 2, 1), (1, "b", 1, 3), (1, "c", 0, 0)], "g int, l string, start int, end int")
    steps = spark.createDataFrame([(1, i) for i in range(5)], "g int, s int")
    assert {r.s: r.labels for r in alignment.intervals(steps, spans, ["g"], "s", "l", 0).collect()} == {0: "", 1: "b", 2: "b", 3: "", 4: ""}


def test_match_task_cascade(spark):
    queries = spark.createDataFrame([("Pick",), ("x/put cup",), ("zz",), ("",), ("up",), ("put",), ("PUT pan",)], "q string")
    keys = spark.createDataFrame([("pick apple",), ("a/put cup",), ("PUT pan",)], "k string")
    got = {r["query"]: (r["key"], r["rank"]) for r in tx.match_task(queries, keys, "q", "k").collect()}
    assert got == {"Pick": ("pick apple", 3), "x/put cup": ("a/put cup", 2), "zz": (None, None), "": (None, None), "up": ("a/put cup", 3), "put": (None, None), "PUT pan": ("PUT pan", 0)}
