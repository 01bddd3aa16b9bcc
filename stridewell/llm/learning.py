"""What the trained operators share: a bounded sample of labelled texts, and models that travel as bytes."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, label: at most `rows` labelled texts, those whose hashed id is smallest, so any run takes the same.

    labels: doc_id, label. Rows with a null id or label are left out; an id labelled twice takes its larger label, and of
    an id that several texts have the last in order counts.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.withColumn("_h", F.xxhash64(F.col("doc_id"))).orderBy("_h", "doc_id").limit(rows)
    # the sample has at most `rows` ids of 8 bytes, which bounds the broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "_h", "label").agg(F.max("text").alias("text")).select("doc_id", "_h", "text", "label")


def train_once(sample: DataFrame, features: Callable, train: Callable[[list, np.ndarray], dict[str, np.ndarray]], kind: pa.DataType = pa.int64()) -> dict[str, np.ndarray] | None:
    """features: (data, offsets) -> a list with each row's features; train: (them, labels) -> arrays.

    Features are made where the texts are; the sample is bounded, so one task can learn from it. None without rows.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.gathered(batches, 1 << 20):
            got = features(*common.utf8(common.one(t.column("text"))))
            yield pa.RecordBatch.from_arrays([common.one(t.column("_h")), pa.array([pack(x) for x in got], pa.binary()), common.one(t.column("label")).cast(kind)], names=["h", "x", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(h, x, y) for b in batches for h, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if found:
            found.sort(key=lambda r: (r[0], r[1]))
            model = train([unpack(r[1]) for r in found], np.array([r[2] for r in found]))
            yield pa.RecordBatch.from_arrays([pa.array([pack(model)], pa.binary())], names=["model"])

    common.small_batches(sample.sparkSession)
    made = sample.mapInArrow(common.trimmed(make), f"h long, x binary, label {'string' if pa.types.is_string(kind) else 'long'}")
    got = made.repartition(1).mapInArrow(common.trimmed(learn), "model binary").collect()  # the sample alone moves
    return unpack(bytes(got[0]["model"])) if got else None


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held(column: Column, by: int, rest: int) -> Column:
    """Whether a row is held out; a null id never is."""
    return F.coalesce(common.crc_rest(column, by) == F.lit(rest), F.lit(False))
