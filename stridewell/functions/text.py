"""Text, path, hash and conversation functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean no task.
NO_TASK = ("null", "unqualified", "qualified")
#: Roles of records, by who speaks.
ROLES = {"human": "user", "gpt": "assistant"}


def strip(text: Column) -> Column:
    """Without white space at either end, of every kind."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def task_text(text: Column) -> Column:
    """The part after the first @, stripped; null if it is empty or one of NO_TASK."""
    at = F.instr(text, "@")
    body = strip(F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text))
    return F.when((body != "") & ~F.lower(body).isin(*NO_TASK), body)


def safe_name(text: Column) -> Column:
    """Only letters, digits, dots, dashes and single underscores; null if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"_+", "_")
    name = F.regexp_replace(F.regexp_replace(name, r"^[._]+", ""), r"[._]+$", "")
    return F.when(name != "", name)


def safe_name_or_error(text: Column) -> Column:
    return F.coalesce(safe_name(text), F.raise_error(F.concat(F.lit("no name in: "), F.coalesce(text, F.lit("null")))).cast("string"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)


def with_prefix(prefix: Column, body: Column) -> Column:
    """'prefix, body'; what is null or empty is left out."""
    return F.concat_ws(", ", F.when(prefix != "", prefix), F.when(body != "", body))


def word_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def wrist_view(name: Column) -> Column:
    return F.lower(name).contains("wrist") | F.lower(name).contains("hand")


def key_parts(key: Column) -> tuple[Column, Column]:
    """Modality and sub-key of 'modality.subkey'."""
    return F.split_part(key, F.lit("."), F.lit(1)), F.regexp_replace(key, r"^[^.]*\.?", "")


def embedded_json(text: Column) -> Column:
    """The longest {...} of a text; null if there is none or it is no JSON."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 12)


def seed(text: Column) -> Column:
    """The first 128 bits of a SHA-256, in hexadecimal."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def episode_path(chunk: Column, episode: Column) -> Column:
    return F.format_string("chunk-%03d/episode_%06d.parquet", chunk, episode)


def step_number(path: Column) -> Column:
    """The number after 'steps_' in a checkpoint's name; null if there is none."""
    found = F.regexp_extract(path, r"steps_(\d+)", 1)
    return F.when(found != "", found.cast("long"))


def sampling_percent(name: Column) -> tuple[Column, Column]:
    """Name and share of 'name%NN'; without a percent, all."""
    percent = F.regexp_extract(name, r"%(\d+)$", 1)
    return F.regexp_replace(name, r"%\d+$", ""), F.when(percent != "", percent.cast("double") / 100).otherwise(F.lit(1.0))


def role(column: Column) -> Column:
    out = F.lower(column)
    for old, new in ROLES.items():
        out = F.when(F.lower(column) == old, F.lit(new)).otherwise(out)
    return out


def from_first_user(df: DataFrame, conversation: str, turn: str, role_: str) -> DataFrame:
    """Turns from a conversation's first user turn on."""
    first = df.where(F.col(role_) == "user").groupBy(conversation).agg(F.min(turn).alias("_first"))
    return df.join(first, conversation).where(F.col(turn) >= F.col("_first")).drop("_first")


def expanded(text: Column, tag: str, counts: Column, unit: str) -> Column:
    """The text with its k-th tag replaced by counts[k] units (0 if there is none)."""
    parts = F.split(text, tag.replace("<", "<").replace("|", r"\|"), -1)
    filled = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.repeat(F.lit(unit), F.coalesce(F.try_element_at(counts, i), F.lit(0))), p)))
    return F.array_join(filled, "")


def label_mask(role_: Column, ids: Column, skip: int = 3, ignored: int = -100) -> Column:
    """Labels of a turn's token ids: ignored but for the assistant's after its first `skip`."""
    return F.transform(ids, lambda x, i: F.when((role_ == "assistant") & (i >= skip), x).otherwise(F.lit(ignored)))


def longest_prefix(df: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """df with the longest key that its name is, or starts with, followed by an underscore.

    A name's own prefixes are looked up, so the join is on equal keys.
    """
    parts = F.split(F.col(name), "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    each = df.select(name).distinct().withColumn("_p", F.explode(prefixes))
    best = each.join(keys.select(F.col(key).alias("_p")).distinct(), "_p").groupBy(name).agg(F.max_by("_p", F.length("_p")).alias(key))
    return df.join(best, name, "left")


def match_task(queries: DataFrame, keys: DataFrame, query: str, key: str) -> DataFrame:
    """query, key, rank: the key a query names: exactly (0), by its last path segment (1), by its own last segment (2),
    or as the only key that contains it, whatever the case (3). Several keys at the best rank give none.
    """
    q = queries.select(F.col(query).alias("query")).distinct()
    k = keys.select(F.col(key).alias("key")).distinct().withColumn("_tail", base_name(F.col("key")))
    q = q.withColumn("_tail", base_name(F.col("query")))
    # a key that contains a query contains its first three characters, or all of a shorter one: a join on equal parts
    low = F.lower("key")
    each = F.transform(F.sequence(F.lit(0), F.length(low)), lambda i: F.transform(F.array(*map(F.lit, range(4))), lambda n: F.substr(low, i + 1, n)))
    parts = k.select("key", F.explode(F.array_distinct(F.flatten(each))).alias("_part"))
    begins = q.select("query", F.substring(F.lower("query"), 1, 3).alias("_part"))
    tries = [
        q.join(k.select("key"), F.col("query") == F.col("key")).select("query", "key", F.lit(0).alias("rank")),
        q.select("query").join(k, F.col("query") == F.col("_tail")).select("query", "key", F.lit(1).alias("rank")),
        q.join(k.withColumnRenamed("_tail", "_kt"), F.col("_tail") == F.col("_kt")).select("query", "key", F.lit(2).alias("rank")),
        parts.join(begins, "_part").where(F.lower("key").contains(F.lower("query"))).select("query", "key", F.lit(3).alias("rank")),
    ]
    found = tries[0]
    for t in tries[1:]:
        found = found.union(t)
    best = found.groupBy("query").agg(F.min("rank").alias("rank"))
    one = found.join(best, ["query", "rank"]).groupBy("query", "rank").agg(F.count_distinct("key").alias("_n"), F.min("key").alias("key")).where("_n = 1")
    return q.select("query").join(one.select("query", "key", "rank"), "query", "left")
