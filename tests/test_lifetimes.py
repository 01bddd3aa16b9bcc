"""Streams with rows out of order: histories by time, late rows, the end of state, restarts."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from stridewell.streaming import lifetimes

ZERO = datetime.datetime(2024, 1, 1)
SCHEMA = "e long, step long, ts timestamp, v double, done boolean"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(lifetimes.PROVIDER[0])
    spark.conf.set(*lifetimes.PROVIDER)
    yield spark
    spark.conf.set(lifetimes.PROVIDER[0], before)
    spark._jvm.org.apache.spark.sql.execution.streaming.state.StateStore.stop()  # closes what is open before the session ends


def row(e, step, minute, done=False):
    return (e, step, ZERO + datetime.timedelta(minutes=minute), float(10 * e + step), done)


def run(spark, tmp_path, batches, first):
    """Each list of rows as a micro-batch of its own, all in one run that goes on from the checkpoint; the state's rows."""
    for k, rows in enumerate(batches, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03d}")
        for p in (tmp_path / "in" / f"b{k:03d}").iterdir():
            os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))  # files come in order of their time
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = lifetimes.history_by_time(stream, "e", "step", "ts", "v", "done", 3, "2 minutes", 600).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/kept").trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]


def got(spark, tmp_path):
    return {(r["episode"], r["step"]): list(r["history"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_rows_out_of_order_across_batches_and_restarts(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [
        [row(1, 1, 1), row(2, 0, 0)],
        [row(1, 0, 0), row(1, 2, 2)],  # step 0 comes after step 1, but within two minutes
        [row(9, 0, 6)],  # time goes on: what waited leaves in order
        [row(1, 3, 1), row(2, 1, 7)],  # behind the watermark: dropped
        [row(1, 3, 7, True), row(9, 1, 12)],
    ]
    assert run(rocks, tmp_path, batches[:2], 0) > 0
    run(rocks, tmp_path, batches[2:], 2)
    histories = got(rocks, tmp_path)
    assert histories[1, 0] == [10.0, 10.0, 10.0]
    assert histories[1, 1] == [10.0, 10.0, 11.0]
    assert histories[1, 2] == [10.0, 11.0, 12.0]
    assert histories[1, 3] == [11.0, 12.0, 13.0]  # the row that came in time, once
    # the other episodes end an hour later, as nothing comes for ten minutes; only what keeps the time is left
    run(rocks, tmp_path, [[row(7, 0, 70)], [row(7, 1, 90, True)], [row(8, 0, 200, True)], [row(8, 1, 400, True)]], 5)
    histories = got(rocks, tmp_path)
    assert histories[9, 1] == [90.0, 90.0, 91.0] and histories[2, 1] == [20.0, 20.0, 21.0]
    assert rocks.read.parquet(f"{tmp_path}/out").groupBy("episode", "step").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def test_state_goes_with_its_episode(rocks, tmp_path):
    """However many episodes have ended, state holds the few that are open."""
    (tmp_path / "in").mkdir()
    many = [[row(e, s, 100 * k + s, s == 4) for e in range(50 * k, 50 * k + 50) for s in range(5)] for k in range(3)]
    states = [run(rocks, tmp_path, [b], k) for k, b in enumerate(many)]
    assert states[2] <= states[0] * 1.1
    assert len(got(rocks, tmp_path)) >= 2 * 250
