"""Sources: episode data sets of parquet and JSON, logs, conversations, registries.

Paths are globs that Spark's readers open, so they may lie in any store that Spark reads. Whole directories are read in
one scan; no file is read by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def episodes(spark: SparkSession, root: str, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Frames of all episode files under root/data, with dataset_key; columns prunes the scan."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
    df = df.select(*columns) if columns else df
    return df.withColumn("dataset_key", F.lit(key or root.rstrip("/").rsplit("/", 1)[-1]))


def shared_episodes(spark: SparkSession, root: str, offsets: DataFrame, episode: str = "episode_index") -> DataFrame:
    """Frames of files that hold several episodes, with each episode's from_timestamp added to its timestamps.

    A filter on the episode reaches the scan."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
    return shift_times(df, offsets, episode)


def shift_times(frames: DataFrame, offsets: DataFrame, episode: str, time: str = "timestamp") -> DataFrame:
    out = frames.join(offsets.select(episode, F.col("from_timestamp").alias("_from")), episode, "left")
    return out.withColumn(time, F.col(time) + F.coalesce("_from", F.lit(0))).drop("_from")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A row for each line that is not blank."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def json_document(spark: SparkSession, path: str, array: str, schema: str | None = None) -> DataFrame:
    """The elements of a document's array, as columns, and its other fields. For one large file, JSON lines split better."""
    reader = spark.read.option("multiLine", "true")
    df = (reader.schema(schema) if schema else reader).json(path)
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.explode(array).alias("_e")).select(*rest, "_e.*")


def row_groups(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet with columns chosen; files that cannot be read are left out, as asked for here alone; max_files: the first
    by path."""
    df = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path)
    names = [c for c in df.columns if (not include or c in include) and c not in (exclude or [])]
    if max_files is not None:
        files = df.select(F.col("_metadata.file_path").alias("f")).distinct().orderBy("f").limit(max_files)
        df = df.withColumn("_f", F.col("_metadata.file_path")).join(F.broadcast(files), F.col("_f") == F.col("f"), "left_semi")
    return df.select(*names)


def data_sets(spark: SparkSession, root: str) -> DataFrame:
    """dataset, files: the directories under root that hold meta/modality.json (a file, or Spark's folder of parts) and data files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    found = files.select(F.regexp_extract("path", r"^(.*?)/(?:meta/modality\.json(?:/.+)?|data/.+)$", 1).alias("dataset"), F.col("path").rlike(r"/meta/modality\.json(/|$)").cast("int").alias("_m"), F.col("path").rlike(r"/data/.+").cast("int").alias("_d"))
    return found.where("dataset <> ''").groupBy("dataset").agg(F.max("_m").alias("_m"), F.sum("_d").alias("files")).where("_m = 1 and files > 0").select("dataset", "files")


def logs(spark: SparkSession, path: str, pattern: str, name_pattern: str) -> DataFrame:
    """file, name, value: of each log, the last line that matches; the name falls back to the cleaned file name."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return last_matches(lines, "file", "line", "value", pattern, name_pattern)


def last_matches(lines: DataFrame, file: str, line: str, text: str, pattern: str, name_pattern: str) -> DataFrame:
    value = F.regexp_extract(text, pattern, 1)
    name = F.regexp_extract(text, name_pattern, 1)
    out = lines.groupBy(file).agg(F.max_by(F.when(value != "", value), F.when(value != "", F.col(line))).alias("value"), F.max_by(F.when(name != "", name), F.when(name != "", F.col(line))).alias("name"))
    clean = F.regexp_replace(F.regexp_replace(tx.base_name(F.col(file)), r"\.[A-Za-z]+$", ""), r"[^A-Za-z0-9]+", "_")
    return out.select(file, F.coalesce("name", clean).alias("name"), F.col("value").try_cast("double").alias("value"))


def conversations(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Records of several JSON or JSON-lines files (by suffix), with the data_path of each."""
    out = None
    for path, data_path in sources.items():
        df = spark.read.option("multiLine", str(not path.endswith(".jsonl")).lower()).json(path).withColumn("data_path", F.lit(data_path))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def registry(paths: DataFrame, path: str, root: str, need_meta: bool = False) -> DataFrame:
    """name, weight: the directories right below root that a path lies in (with a meta directory, if needed), sorted."""
    rest = F.substring(F.col(path), len(root.rstrip("/")) + 2, 1 << 20)
    below = paths.where(F.col(path).startswith(root.rstrip("/") + "/")).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), rest.alias("_r"))
    below = below.where(F.col("_r").contains("/"))
    if need_meta:
        below = below.join(below.where(F.split_part("_r", F.lit("/"), F.lit(2)) == "meta").select("name").distinct(), "name", "left_semi")
    return below.select("name", F.lit(1.0).alias("weight")).distinct().orderBy("name")


def complete_runs(files: DataFrame, run: str, seed: str, expected: int) -> DataFrame:
    """run, seed, files of the runs with just as many files as expected, by seed and name."""
    return files.groupBy(run, seed).agg(F.count(F.lit(1)).alias("files")).where(F.col("files") == expected).orderBy(seed, run)


def health(spark: SparkSession, wanted: DataFrame, path: str, root: str, size: str | None = None) -> DataFrame:
    """wanted with state: missing, empty, truncated (fewer bytes than the column `size` says) or ok.

    One listing of root tells all lengths; no file is opened. Spark's sources leave files of no bytes out of their rows, so
    these alone are asked of the store by name. Paths without a scheme are those of the default store, as for Spark.
    """
    store = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getUri().toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = files.select(_qualified(F.col("path"), store).alias("_p"), F.col("length").alias("_n"))
    empty = spark.createDataFrame([(p,) for p in _empty_files(spark, root)], "_p string").select(_qualified(F.col("_p"), store).alias("_p"), F.lit(0).cast("long").alias("_n"))
    out = wanted.join(listed.union(empty), _qualified(F.col(path), store) == F.col("_p"), "left")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 0, "empty")
    if size:
        state = state.when(F.col("_n") < F.col(size), "truncated")
    return out.withColumn("state", state.otherwise("ok")).drop("_p", "_n")


def _qualified(path: Column, store: str) -> Column:
    """path with its store, and files of this machine in one of their spellings."""
    whole = F.when(path.startswith("/"), F.concat(F.lit(store), path)).otherwise(path)
    return F.regexp_replace(whole, "^file:/+", "file:/")


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, walk = [], at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    while walk.hasNext():
        f = walk.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
            found.append(f.getPath().toString())
    return found


def config_key(*parts: str) -> Column:
    """Twelve hexadecimal digits that name a configuration, for tables kept by it."""
    return tx.short_hash(F.concat_ws("|", *[F.lit(p) for p in parts]))


def kept(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table folder/key, made by make() where it is not there yet; cache.cached() chooses keys by what a table depends on."""
    path = f"{folder.rstrip('/')}/{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
