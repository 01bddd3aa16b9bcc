"""Helpers that the text operators share: input columns, shared storage, Arrow rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch, which bound what the JVM sends at once (a row is never cut).
ARROW_ROWS, ARROW_BYTES = 1024, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator needs, under the operator's own names, so that others cannot clash."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where none is named and all of Spark is here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='stridewell-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Spark deletes an execution's shuffle files at its end, on every executor, where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a stored table's file, about, where their number is known beforehand; there are FEWEST files at least.
FILE_ROWS, FEWEST = 200_000, 3


def compact(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows at most, or about, in partitions that are not small."""
    return df.coalesce(max(FEWEST, -(-rows // FILE_ROWS)))


def stored(df: DataFrame, what: str, held: list[str] | None = None, rows: int | None = None, sweep: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once.

    sweep: shuffle files of its making go with the write, as nothing reads them again.
    held: gets the table's path, for discard(). rows: that df has at most, or about; few rows are not written as many
    small files, each of which costs more than its rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    few = df if rows is None else compact(df, rows)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if sweep else before)
    try:
        few.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # the return of write says so
    finally:
        spark.conf.set(CLEANUP, before)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join whose tables grow with the input: by shuffle, whatever their size.

    Spark takes a table for small by its compressed bytes, of which a broadcast makes ten times as many in the driver.
    """
    return df.hint("merge")


def discard(spark: SparkSession, held: list[str]) -> None:
    """Deletes stored tables that nothing reads any more: what was made of them must be stored itself."""
    while held:
        path = spark._jvm.org.apache.hadoop.fs.Path(held.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a column more, and its name: a long that tells rows apart.

    It is doc_id itself, unless an id is null or occurs twice; then rows are numbered and stored.
    """
    key = fresh(docs, "_row")
    ids = docs.select(F.col(doc_id).cast("long").alias("doc"))
    if ids.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc is null").isEmpty():
        return docs.withColumn(key, F.col(doc_id).cast("long")), key
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker gives its free memory back: workers live on beside later stages."""
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return out


def give_back() -> None:
    """A worker's free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def crc_rest(column: Column, by: int) -> Column:
    """crc32 of an id as text, modulo by; null ids give null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(by)


def input_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text (both at least 0)."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("c")).first()
    return int(row["n"]), int(row["c"])


def id_bounds(docs: DataFrame, buckets: int, column: str = "doc_id") -> list[int]:
    """Upper ends of id ranges with about equally many rows; each end is an id that occurs, the last is the largest."""
    shares = [k / buckets for k in range(1, buckets)] + [1.0]
    row = docs.agg(F.percentile_approx(column, shares, 100 * buckets).alias("q"), F.max(column).alias("m")).first()
    return sorted({*(row["q"] or []), row["m"]} - {None})


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the offsets of its rows in them, without a copy where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offs = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def cuts(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row that is longer."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def gathered(batches: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.Table]:
    """Batches joined until their text has limit bytes."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(text).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A table's column as one array."""
    if isinstance(column, pa.Array):
        return column
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks() if column.num_chunks else pa.array([], column.type)
