"""Results kept by configuration: a stored table is used again only for the same settings, inputs and schema."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inputs_version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below paths: names, lengths and times of change. No file is opened, no listing collected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    each = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(each).alias("x"), F.sum(F.shiftright(each, 8)).alias("s")).first()
    return f"{row['n']}-{row['x'] or 0:x}-{row['s'] or 0:x}"


def cache_key(config: dict, version: str, schema: str) -> str:
    """Twelve hexadecimal digits: the same for equal settings, inputs and schema, in whatever order settings are given."""
    return hashlib.md5(json.dumps([config, version, schema], sort_keys=True).encode()).hexdigest()[:12]


def _complete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, folder: str, config: dict, inputs: list[str], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, whether it was there): make()'s rows, from folder if they were stored for this config and these inputs.

    A table whose writing was broken off counts as absent and is written anew. Rows of an earlier state of the inputs stay
    in the folder under their own key.
    """
    df = make()
    path = f"{folder.rstrip('/')}/{cache_key(config, inputs_version(spark, inputs), df.schema.json())}"
    there = _complete(spark, path)
    if not there:
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    return spark.read.schema(df.schema).parquet(path), there
