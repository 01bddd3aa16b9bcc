"""Documents by parts, results kept by configuration, file health, view choice, batches, reservoirs."""

import json
import os
import pickle
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from stridewell.operators import collate, sampling, views
from stridewell.plans import ORACLES, QUERIES, files
from stridewell.sources import cache, documents, readers, rollouts
from stridewell.sources.shared import shared_dir


@pytest.fixture
def small_ranges(spark):
    """Byte ranges far smaller than a document, so that strings and records lie across them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in names]
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(names, (n, 1), strict=True)]
    for k, v in zip(names, before, strict=True):
        spark.conf.set(k, v)


def document(seed, n):
    rng = random.Random(seed)
    odd = ['a"b', "}{][", "x\\", '"', "é}" * 3, '{"advantages": [1', "\\\\\"}", "plain", "\n}"]
    rows = [{"i": i, "s": rng.choice(odd), "n": {"a": [1, {"b": rng.choice(odd)}], "advantages": [{"z": i}]}} for i in range(n)]
    return rows, {"n_step": 3, "skip": {"advantages": [{"i": -1}]}, "gamma": 0.9, "advantages": rows, "after": {"q": [1, {"advantages": []}]}, "scale": 1.5}


SCHEMA = "i long, s string, n struct<a:array<string>,advantages:array<struct<z:long>>>"


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize(("n", "size"), [(0, 64), (30, 80), (60, 333), (60, 1 << 20)])
def test_document_by_byte_ranges(spark, tmp_path, small_ranges, indent, n, size):
    rows, whole = document(n + size, n)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(whole, ensure_ascii=False, indent=indent) + ("\n" if indent else ""))
    small_ranges(size)
    df, fields = documents.records(spark, str(path), "advantages", SCHEMA)
    got = df.orderBy("_range", "_place").collect()
    assert [(r["i"], r["s"], r["n"]["advantages"][0]["z"]) for r in got] == [(r["i"], r["s"], r["i"]) for r in rows]
    assert fields == {k: v for k, v in whole.items() if k != "advantages"}
    if n >= 30 and size < 1000:
        assert df.select("_range").distinct().count() > 10


def test_records_larger_than_a_range(spark, tmp_path, small_ranges):
    rows = [{"i": i, "s": "}" * 2000 + str(i)} for i in range(5)]
    (tmp_path / "d.json").write_text(json.dumps({"advantages": rows}))
    small_ranges(100)
    df, fields = documents.records(spark, str(tmp_path / "d.json"), "advantages", "i long, s string")
    assert [(r["i"], r["s"]) for r in df.orderBy("_range", "_place").collect()] == [(r["i"], r["s"]) for r in rows] and fields == {}


def test_document_without_the_array(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": 1, "list": [{"advantages": 2}]}')
    df, fields = documents.records(spark, str(tmp_path / "d.json"), "advantages", "i long")
    assert df.count() == 0 and fields == {"a": 1, "list": [{"advantages": 2}]}


def test_written_document_is_json_and_comes_back(spark, tmp_path, small_ranges):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _written_document(spark, tmp_path, small_ranges)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _written_document(spark, tmp_path, small_ranges):
    df = spark.range(500).select((499 - F.col("id")).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('"}'), F.col("id").cast("string"))).alias("s"))
    documents.write_document(df.repartition(7), f"{tmp_path}/out", "rows", ["k"], name="n", share=0.5)
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part-"))
    assert len(parts) > 1
    whole = json.loads("".join((tmp_path / "out" / p).read_text() for p in parts))
    assert [r["k"] for r in whole["rows"]] == list(range(500)) and (whole["name"], whole["share"]) == ("n", 0.5)
    assert whole["rows"][499] == {"k": 499, "s": None}
    small_ranges(200)
    back, fields = documents.records(spark, f"{tmp_path}/out", "rows", "k long, s string")
    assert fields == {"name": "n", "share": 0.5}
    assert [(r["k"], r["s"]) for r in back.orderBy("_range", "_place").collect()] == [(r["k"], r["s"]) for r in whole["rows"]]
    documents.write_document(df.limit(0), f"{tmp_path}/none", "rows", ["k"])
    back, fields = documents.records(spark, f"{tmp_path}/none", "rows", "k long, s string")
    assert back.count() == 0 and fields == {}


def test_cached_by_settings_inputs_and_schema(spark, tmp_path):
    data, folder, made = f"{tmp_path}/in", f"{tmp_path}/cache", []
    spark.range(10).write.parquet(data)

    def make(every, name="id"):
        made.append(every)
        return spark.read.parquet(data).where(F.col("id") % every == 0).withColumnRenamed("id", name)

    def use(every, name="id", **more):
        df, there = cache.cached(spark, folder, {"every": every, **more}, [data], lambda: make(every, name))
        return df.count(), there

    assert use(2, a=1, b=2) == (5, False)
    assert use(2, b=2, a=1) == (5, True)
    assert use(3, a=1, b=2) == (4, False)
    assert use(2, "other", a=1, b=2) == (5, False)  # another schema
    key = next(p for p in (tmp_path / "cache").iterdir() if (p / "_SUCCESS").exists())
    (key / "_SUCCESS").unlink()  # as if its writing had been broken off
    found = [use(2, a=1, b=2)[1], use(3, a=1, b=2)[1], use(2, "other", a=1, b=2)[1]]
    assert sorted(found) == [False, True, True]
    assert use(2, a=1, b=2) == (5, True)
    spark.range(10, 20).write.mode("append").parquet(data)  # another state of the inputs
    assert use(2, a=1, b=2) == (10, False)
    assert use(2, a=1, b=2) == (10, True)


def test_health_of_files(spark, tmp_path):
    for name, size in (("a/ok.bin", 10), ("a/short.bin", 4), ("empty.bin", 0), ("unknown.bin", 5)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    wanted = [(f"{tmp_path}/{n}", s) for n, s in (("a/ok.bin", 10), ("a/short.bin", 10), ("empty.bin", 10), ("gone.bin", 10), ("unknown.bin", None))]
    df = spark.createDataFrame([(f"file://{p}", s) for p, s in wanted], "path string, size long")
    got = {os.path.basename(r["path"]): r["state"] for r in readers.health(spark, df, "path", str(tmp_path), "size").collect()}
    assert got == {"ok.bin": "ok", "short.bin": "truncated", "empty.bin": "empty", "gone.bin": "missing", "unknown.bin": "ok"}


def test_health_of_a_shared_folder_without_a_scheme(spark, tmp_path, monkeypatch):
    """Users that are null or negative, and ids that occur twice, in a folder named by its path alone."""
    rows = [(k // 4, u, "click", 0.5) for k, u in enumerate(u for u in (*range(-30, 60, 5), None) for _ in range(5))] + [(7, 75, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/sf/events.parquet")
    monkeypatch.setattr(files, "shared_dir", lambda spark: f"{tmp_path}/shared")
    assert oracle.differences(QUERIES["f12_file_health"](spark, f"{tmp_path}/sf"), oracle.connect(f"{tmp_path}/sf"), ORACLES["f12_file_health"]) == []


class Evil:
    def __reduce__(self):
        return os.system, ("touch /tmp/never",)


def test_pickles_are_data_alone(spark, tmp_path):
    whole = {"states": np.arange(6.0).reshape(3, 2), "actions": np.ones((3, 2), np.float32), "length": np.int64(3), "timestamps": np.array([0.0, 0.5, 1.0])}
    cases = {
        "ok_success.pkl": whole, "plain.pkl": {"states": [[1, 2]], "actions": [[3, 4]], "success": True}, "wide.pkl": whole | {"states": np.zeros((3, 4))},
        "short.pkl": whole | {"length": 2}, "times.pkl": whole | {"timestamps": [1.0]}, "none.pkl": {"states": []}, "evil.pkl": {"states": Evil(), "actions": [[1, 2]]},
    }
    for name, x in cases.items():
        (tmp_path / name).write_bytes(pickle.dumps(x))
    got = {}
    for r in rollouts.rollouts(spark, str(tmp_path), 2, 10.0, "report").collect():
        got.setdefault(os.path.basename(r["path"]), []).append(r)
    assert [(r["frame_index"], r["state"], r["action"], r["timestamp"], r["success"]) for r in got["ok_success.pkl"]] == [(k, [2.0 * k, 2.0 * k + 1], [1.0, 1.0], 0.5 * k, True) for k in range(3)]
    assert got["plain.pkl"][0]["success"] and got["plain.pkl"][0]["problem"] is None
    assert {n: rs[0]["problem"] for n, rs in got.items() if rs[0]["problem"]}.keys() == {"wide.pkl", "short.pkl", "times.pkl", "none.pkl", "evil.pkl"}
    assert "not data" in got["evil.pkl"][0]["problem"] and "[3, 4]" in got["wide.pkl"][0]["problem"]
    with pytest.raises(Exception, match="not data"):
        rollouts.rollouts(spark, str(tmp_path / "evil.pkl"), 2).collect()


def test_initial_actions(spark, tmp_path):
    sets = [{"t0": {"arm": np.array([[1.0, 2.0], [3.0, 4.0]]), "hand": np.array([5.0])}, "t1": {"arm": np.zeros((0, 2))}}, {}]
    np.savez(tmp_path / "a.npz", sets)
    got = {(r["dataset"], r["trajectory"], r["key"]): (r["action"], r["shape"]) for r in rollouts.initial_actions(spark, str(tmp_path)).collect()}
    assert got == {(0, "t0", "arm"): ([1.0, 2.0, 3.0, 4.0], [2, 2]), (0, "t0", "hand"): ([5.0], [1]), (0, "t1", "arm"): ([], [0, 2])}
    np.savez(tmp_path / "b.npz", np.array([Evil()], dtype=object))
    with pytest.raises(Exception, match="not data"):
        rollouts.initial_actions(spark, str(tmp_path / "b.npz")).collect()


def test_views_of_a_mixture(spark):
    rows = [
        ("m", "a", "left_gripper", 9), ("m", "a", "head", 5), ("m", "b", "left_hand", 4), ("m", "b", "head", 5), ("m", "b", "extra", 1),
        ("n", "c", "head", 7), ("n", "d", "arm", 3), ("o", "e", "left_gripper", 2), ("o", "e", "left_hand", 8), (None, "f", "head", 1),
    ]
    df = spark.createDataFrame(rows, "mix string, ds string, view string, px int")
    got = {(r["mix"], r["name"]): (r["px"], r["ds"], r["common"]) for r in views.choose(df, "mix", "ds", "view", "px", {"left_gripper": "left_hand"}).collect()}
    assert got == {("m", "left_hand"): (4, "b", True), ("m", "head"): (5, "a", True), ("n", "head"): (7, "c", False), ("o", "left_hand"): (8, "e", True), (None, "head"): (1, "f", True)}
    seen = {r["mix"]: r["views"] for r in views.available(df, "mix", "view", {"left_gripper": "left_hand"}, ["head", "left_hand"]).collect()}
    assert seen["m"] == ["head", "left_hand", "extra"] and seen["n"] == ["head", "arm"]


def test_batches_are_padded_and_packed(spark):
    df = spark.createDataFrame([("a", 1, [5, 6]), ("a", 0, [7]), ("a", 2, []), ("b", 0, None), (None, 0, [1])], "g string, k int, ids array<int>")
    padded = {(r["g"], r["k"]): (r["padded"], r["length"]) for r in collate.pad(df, ["g"], "ids", -1).collect()}
    assert padded == {("a", 1): ([5, 6], 2), ("a", 0): ([7, -1], 1), ("a", 2): ([-1, -1], 0), ("b", 0): ([], 0), (None, 0): ([1], 1)}
    packed = {r["g"]: (r["packed"], r["offsets"]) for r in collate.pack(df, ["g"], ["k"], "ids").collect()}
    assert packed == {"a": ([7, 5, 6], [0, 1, 3, 3]), "b": ([], [0, 0]), None: ([1], [0, 1])}


def test_reservoirs_merge(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("g"), "id")
    want = {tuple(r) for r in sampling.reservoir(df.coalesce(1), ["g"], ["id"], 3, 50).collect()}
    assert {tuple(r) for r in sampling.reservoir(df.repartition(9), ["g"], ["id"], 3, 50).collect()} == want and len(want) == 100
    assert {tuple(r) for r in sampling.reservoir(df, ["g"], ["id"], 4, 50).collect()} != want
    assert sampling.reservoir(df, ["g"], ["id"], 3, 500).groupBy("g").count().collect()[0]["count"] in (400, 500)
    plan = sampling.reservoir(df, ["g"], ["id"], 3, 50)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan  # n rows a group leave each task
    # every row is as likely as any other: over many seeds, each of twenty is drawn about as often
    few = spark.range(20).withColumn("g", F.lit(1))
    drawn = [r["id"] for seed in range(40) for r in sampling.reservoir(few, ["g"], ["id"], seed, 5).collect()]
    assert all(2 <= drawn.count(i) <= 20 for i in range(20))


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
def test_large_samples_are_the_same_rows(spark, monkeypatch, n):
    """Also where keys tie: by the columns that settle ties."""
    df = spark.range(500).select("id", (F.col("id") % 7).alias("g"), (F.col("id") % 50).alias("k"))
    want = [tuple(r) for r in df.orderBy("k", "g", "id").limit(n).collect()]
    drawn = {tuple(r) for r in sampling.sample(df, ["id"], 9, n).collect()}
    monkeypatch.setattr(sampling, "MOST_TAKEN", 0)
    if n:
        assert sorted(tuple(r) for r in sampling.smallest(df, "k", ["g", "id"], n).collect()) == sorted(want)
        assert {tuple(r) for r in sampling.sample(df, ["id"], 9, n).collect()} == drawn


def test_weighted_sample_follows_weights(spark):
    """A row of three times the weight comes first about three times as often."""
    df = spark.createDataFrame([(0, 3.0), (1, 1.0)], "id long, w double")
    first = [sampling.weighted_sample(df, ["id"], F.col("w"), seed, 1).first()["id"] for seed in range(40)]
    assert 23 <= first.count(0) <= 37


def test_no_local_folder_on_a_cluster(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Elsewhere)


def test_rollouts_are_not_a_file_each(spark, tmp_path):
    """200 runs give no more files than there are tasks, and come back in order; a null is NaN."""
    df = spark.range(600).selectExpr("concat('r', id % 200) as run", "2 - id div 200 as step", "if(id = 7, null, id) as x", "id * 2.0 as y", "id % 2 = 0 as success").repartition(8)
    rollouts.write_rollouts(df, f"{tmp_path}/runs", "run", "step", ["x", "y"], ["y", "x"], ["success"])
    assert len(list((tmp_path / "runs").rglob("*.parquet"))) <= 8 and not any(p.is_dir() for p in (tmp_path / "runs").iterdir())
    got = rollouts.unpickle(spark.read.parquet(f"{tmp_path}/runs"), 2).orderBy("path", "frame_index").collect()
    assert len(got) == 600 and {r["path"] for r in got} == {f"run=r{k}" for k in range(200)}
    for r in got:
        i = 200 * (2 - r["frame_index"]) + int(r["path"][5:])
        assert r["state"][1] == r["action"][0] == 2 * i and r["success"] == (i % 2 == 0) and r["problem"] is None
        assert np.isnan(r["state"][0]) if i == 7 else r["state"][0] == r["action"][1] == i
