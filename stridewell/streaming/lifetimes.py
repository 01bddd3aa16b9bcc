"""Histories of episodes whose rows come in any order, with state that ends when the episode does.

Rows wait in state until the watermark has passed their time, as only then no earlier row can come; they leave in order
of their step. An episode ends with the row that says so, or when nothing has come for a while; then all of its state and
timers go. Rows behind the watermark are dropped. State is what waits and n numbers an episode; it is kept in the
stream's checkpoint (RocksDB), so a restart goes on where the last run stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session needs to keep such state.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _History(StatefulProcessor):
    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "step long", "at long, value double, last boolean")
        self.kept = handle.getValueState("kept", "values array<double>")
        self.closing = handle.getValueState("closing", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        times, passed = [], timerValues.getCurrentWatermarkInMs()
        for r in rows:
            if r["_at"] < passed:  # Spark itself drops only what the last batch's watermark had passed
                continue
            self.waiting.updateValue((r["_step"],), (r["_at"], r["_value"], bool(r["_last"])))
            times.append(r["_at"])
        if not times:
            return
        for at in {min(times), max(times)}:
            self.handle.registerTimer(at)
        close = max(times) + self.idle_ms
        before = self.closing.get()[0] if self.closing.exists() else None
        if before is None or close > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(close)
            self.closing.update((close,))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = self.closing.exists() and now == self.closing.get()[0]
        ready = sorted((k[0], v[1], v[2]) for k, v in self.waiting.iterator() if over or v[0] <= now)
        values = list(self.kept.get()[0]) if self.kept.exists() else []
        for step, value, last in ready:
            values = [*values, value][-self.n :] if values else [value] * self.n
            yield Row(episode=key[0], step=step, history=list(values))
            self.waiting.removeKey((step,))
            over = over or last
        if over:
            self.waiting.clear()
            self.kept.clear()
            self.closing.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        elif values:
            self.kept.update((values,))

    def close(self) -> None:
        pass


def history_by_time(stream: DataFrame, episode: str, step: str, time: str, value: str, last: str, n: int, late: str = "10 minutes", idle: int = 3600) -> DataFrame:
    """episode, step, history: the last n values at each step, the first filling what is missing, once per row.

    time: when a row happened; rows may come `late` after others. last: whether the row ends its episode. idle: seconds
    without rows after which an episode ends. Two rows of a step are one, the later to come; rows of an ended episode
    begin a new one.
    """
    rows = stream.withWatermark(time, late).select(F.col(episode).alias("episode"), F.col(step).cast("long").alias("_step"), F.col(time), F.unix_millis(F.col(time)).alias("_at"), F.col(value).cast("double").alias("_value"), F.coalesce(F.col(last), F.lit(False)).alias("_last"))
    kind = rows.schema["episode"].dataType.simpleString()
    return rows.groupBy("episode").transformWithState(_History(n, idle * 1000), f"episode {kind}, step long, history array<double>", "append", "eventTime")
