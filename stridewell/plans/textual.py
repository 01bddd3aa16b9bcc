"""Queries over texts, names, records and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import collate, sampling, views
from ..sources import readers
from .base import query, table

#: Other names of the same parts.
SYNONYMS = {"left_gripper": "left_hand", "right_gripper": "right_hand", "left_pose": "left_arm", "right_pose": "right_arm"}


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("t1_task_text", r"WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN instr(text, '@') > 0 THEN substring(text, instr(text, '@') + 1) ELSE text END, '^\s+', ''), '\s+$', '') AS t FROM documents) SELECT doc_id, length(CASE WHEN t <> '' AND lower(t) NOT IN ('null', 'unqualified', 'qualified') THEN t END) AS n, md5(CASE WHEN t <> '' AND lower(t) NOT IN ('null', 'unqualified', 'qualified') THEN t END) AS hash FROM b")
def _(spark, sf):
    t = _docs(spark, sf).withColumn("t", tx.task_text(F.col("text")))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("hash"))


@query("t2_safe_name", r"WITH a AS (SELECT p_partkey, '..' || p_name || ' / ' || p_type || '!' AS s FROM part), b AS (SELECT p_partkey, regexp_replace(regexp_replace(s, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g') AS s FROM a) SELECT p_partkey, regexp_replace(regexp_replace(s, '^[._]+', ''), '[._]+$', '') AS name FROM b")
def _(spark, sf):
    raw = F.concat(F.lit(".."), F.col("p_name"), F.lit(" / "), F.col("p_type"), F.lit("!"))
    return table(spark, sf, "part").select("p_partkey", tx.safe_name_or_error(raw).alias("name"))


@query("t3_base_name", "SELECT page_id, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.base_name(F.col("url")).alias("name"))


@query("t4_language_prefix", "SELECT c_custkey, concat_ws(', ', nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), nullif(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END, '')) AS text FROM customer")
def _(spark, sf):
    prefix = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    body = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", tx.with_prefix(prefix, body).alias("text"))


@query("t5_word_count", r"SELECT conv_id, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM conversations GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(tx.word_count(F.col("text"))).alias("words"))


@query("f6_short_conversations", r"WITH w AS (SELECT conv_id, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM conversations GROUP BY 1) SELECT conv_id, words FROM w WHERE words <= 120")
def _(spark, sf):
    w = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(tx.word_count(F.col("text"))).alias("words"))
    return w.where("words <= 120")


@query("t6_view_order", "WITH v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'wrist_left' WHEN s_suppkey % 4 = 1 THEN 'hand_cam' ELSE 'front' END AS view FROM supplier) SELECT s_suppkey, view, contains(view, 'wrist') OR contains(view, 'hand') AS wrist, row_number() OVER (ORDER BY contains(view, 'wrist') OR contains(view, 'hand'), s_suppkey) - 1 AS place FROM v")
def _(spark, sf):
    k = F.col("s_suppkey") % 4
    v = table(spark, sf, "supplier").select("s_suppkey", F.when(k == 0, "wrist_left").when(k == 1, "hand_cam").otherwise("front").alias("view")).withColumn("wrist", tx.wrist_view(F.col("view")))
    return sampling.ranked(v, ["wrist", "s_suppkey"], "place").withColumn("place", F.col("place").cast("long"))


@query("t7_key_grammar", "WITH k AS (SELECT p_partkey, lower(p_brand) || '.' || p_type || '.x' AS k FROM part) SELECT p_partkey, split_part(k, '.', 1) AS modality, regexp_replace(k, '^[^.]*\\.?', '') AS subkey FROM k")
def _(spark, sf):
    key = F.concat(F.lower("p_brand"), F.lit("."), F.col("p_type"), F.lit(".x"))
    modality, sub = tx.key_parts(key)
    return table(spark, sf, "part").select("p_partkey", modality.alias("modality"), sub.alias("subkey"))


@query("t8_embedded_json", """WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'no braces' WHEN event_id % 3 = 1 THEN 'x {broken y' ELSE 'so: ' || props || ' end' END AS t FROM events) SELECT event_id, CAST(json_extract(CASE WHEN event_id % 3 = 2 THEN regexp_extract(t, '(\\{.*\\})', 1) END, '$.k') AS BIGINT) AS k FROM t""")
def _(spark, sf):
    m = F.col("event_id") % 3
    t = F.when(m == 0, "no braces").when(m == 1, "x {broken y").otherwise(F.concat(F.lit("so: "), F.col("props"), F.lit(" end")))
    return table(spark, sf, "events").select("event_id", F.get_json_object(tx.embedded_json(t), "$.k").cast("long").alias("k"))


@query("t9_hashes", "SELECT p_partkey, substring(md5(p_name), 1, 12) AS config, substring(sha256(p_name), 1, 32) AS seed FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.short_hash(F.col("p_name")).alias("config"), tx.seed(F.col("p_name")).alias("seed"))


MATCH = """WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name, p_type, p_brand FROM part),
k AS (SELECT 'tasks/' || name AS key, name AS tail FROM n UNION SELECT p_brand || '/' || p_type, p_type FROM n UNION SELECT p_type, p_type FROM n),
q AS (SELECT DISTINCT unnest(['tasks/' || name, name, 'runs/' || name, upper(substring(name, 3)), substring(name, 2, 2), p_type, lower(p_brand), 'no ' || name]) AS q FROM n),
c AS (SELECT q, key, 0 AS r FROM q JOIN k ON q = key UNION ALL SELECT q, key, 1 FROM q JOIN k ON q = tail UNION ALL SELECT q, key, 2 FROM q JOIN k ON list_extract(string_split(q, '/'), -1) = tail UNION ALL SELECT q, key, 3 FROM q JOIN k ON contains(lower(key), lower(q))),
b AS (SELECT q, min(r) AS r FROM c GROUP BY q), o AS (SELECT c.q, c.r, min(key) AS key FROM c JOIN b ON c.q = b.q AND c.r = b.r GROUP BY c.q, c.r HAVING count(DISTINCT key) = 1)
SELECT q.q AS query, o.key, CAST(o.r AS BIGINT) AS rank FROM q LEFT JOIN o ON q.q = o.q"""


@query("t10_fuzzy_task", MATCH)
def _(spark, sf):
    """Exact names, last segments on either side, parts of names in another case, and names that are no key's or several."""
    n = table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), "p_type", "p_brand").distinct()
    keys = n.select(F.explode(F.array(F.concat(F.lit("tasks/"), "name"), F.concat_ws("/", "p_brand", "p_type"), "p_type")).alias("k"))
    asked = [F.concat(F.lit("tasks/"), "name"), F.col("name"), F.concat(F.lit("runs/"), "name"), F.upper(F.expr("substring(name, 3)")), F.substring("name", 2, 2), F.col("p_type"), F.lower("p_brand"), F.concat(F.lit("no "), "name")]
    m = tx.match_task(n.select(F.explode(F.array(*asked)).alias("q")), keys, "q", "k")
    return m.select("query", "key", F.col("rank").cast("long").alias("rank"))


@query("t11_placeholders", "SELECT n_nationkey, 'see ' || repeat('<pad>', n_nationkey % 3) || ' and ' || repeat('<pad>', 2) || ' end' AS text FROM nation")
def _(spark, sf):
    counts = F.array((F.col("n_nationkey") % 3).cast("int"), F.lit(2))
    return table(spark, sf, "nation").select("n_nationkey", tx.expanded(F.lit("see <image> and <image> end"), "<image>", counts, "<pad>").alias("text"))


@query("t12_roles", "WITH f AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY 1) SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN f ON c.conv_id = f.conv_id AND c.turn >= first")
def _(spark, sf):
    raw = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    c = table(spark, sf, "conversations").withColumn("role", tx.role(raw))
    return tx.from_first_user(c, "conv_id", "turn", "role").select("conv_id", "turn", "role")


@query("t13_label_mask", r"WITH w AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_transform(w, lambda x, i: CASE WHEN role = 'assistant' AND i > 3 THEN length(x) ELSE -100 END), ',') AS labels FROM w")
def _(spark, sf):
    """Labels by value; a word's length stands for its token."""
    ids = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.length(w))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(tx.label_mask(F.col("role"), ids), ",").alias("labels"))


@query("t14_paths", "SELECT o_orderkey, format('chunk-{:03d}/episode_{:06d}.parquet', o_orderkey // 1000, o_orderkey) AS path FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.episode_path(F.floor(F.col("o_orderkey") / 1000).cast("long"), F.col("o_orderkey")).alias("path"))


@query("t16_longest_prefix", "WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'pi_fast' WHEN p_partkey % 3 = 1 THEN 'pi_fast_base_' || p_size ELSE 'pix_' || p_size END AS name FROM part), k AS (SELECT unnest(['pi', 'pi_fast', 'pi_fast_base']) AS key), b AS (SELECT name, arg_max(key, length(key)) AS key FROM (SELECT DISTINCT name FROM r) JOIN k ON name = key OR starts_with(name, key || '_') GROUP BY name) SELECT p_partkey, r.name, b.key FROM r LEFT JOIN b ON r.name = b.name")
def _(spark, sf):
    m, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    runs = table(spark, sf, "part").select("p_partkey", F.when(m == 0, "pi_fast").when(m == 1, F.concat(F.lit("pi_fast_base_"), s)).otherwise(F.concat(F.lit("pix_"), s)).alias("name"))
    keys = spark.createDataFrame([("pi",), ("pi_fast",), ("pi_fast_base",)], "key string")
    return tx.longest_prefix(runs, "name", keys, "key").select("p_partkey", "name", "key")


@query("s11_sampling_percent", r"WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '%' || (s_suppkey % 90 + 10) ELSE s_name END AS n FROM supplier) SELECT s_suppkey, regexp_replace(n, '%\d+$', '') AS name, CASE WHEN regexp_extract(n, '%(\d+)$', 1) <> '' THEN CAST(regexp_extract(n, '%(\d+)$', 1) AS DOUBLE) / 100 ELSE 1.0 END AS share FROM n")
def _(spark, sf):
    n = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.col("s_name"), F.lit("%"), (F.col("s_suppkey") % 90 + 10).cast("string"))).otherwise(F.col("s_name"))
    name, share = tx.sampling_percent(n)
    return table(spark, sf, "supplier").select("s_suppkey", name.alias("name"), share.alias("share"))


@query("s14_registry", "SELECT DISTINCT lower(p_brand) AS name, CAST(1.0 AS DOUBLE) AS weight FROM part ORDER BY name")
def _(spark, sf):
    paths = table(spark, sf, "part").select(F.concat(F.lit("/data/"), F.lower("p_brand"), F.lit("/data/"), F.col("p_name")).alias("p"))
    return readers.registry(paths, "p", "/data")


VIEWS = """v AS (SELECT p_partkey, p_size, p_type, p_brand, CASE p_size % 5 WHEN 0 THEN 'left_gripper' WHEN 1 THEN 'right_pose' WHEN 2 THEN 'left_hand' WHEN 3 THEN 'head' ELSE 'right_gripper' END AS raw FROM part),
m AS (SELECT p_brand AS mixture, p_type AS dataset, raw, CASE raw WHEN 'left_gripper' THEN 'left_hand' WHEN 'right_gripper' THEN 'right_hand' WHEN 'right_pose' THEN 'right_arm' WHEN 'left_pose' THEN 'left_arm' ELSE raw END AS name, min(p_size) AS px FROM v GROUP BY 1, 2, 3, 4)"""


def _views(spark, sf):
    """mixture, dataset, raw, px: a data set's views and their pixels."""
    k = F.col("p_size") % 5
    raw = F.when(k == 0, "left_gripper").when(k == 1, "right_pose").when(k == 2, "left_hand").when(k == 3, "head").otherwise("right_gripper")
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("mixture"), F.col("p_type").alias("dataset"), raw.alias("raw")).agg(F.min("p_size").alias("px"))


@query("u5_view_synonyms", f"WITH {VIEWS} SELECT name, count(*) AS n, count(DISTINCT dataset) AS datasets, min(px) AS smallest FROM m GROUP BY name")
def _(spark, sf):
    v = _views(spark, sf).withColumn("name", views.canonical(F.col("raw"), SYNONYMS))
    return v.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset").alias("datasets"), F.min("px").alias("smallest"))


@query("u5_view_choice", f"""WITH {VIEWS}, o AS (SELECT mixture, dataset, name, arg_max(px, raw) AS px FROM m GROUP BY 1, 2, 3),
s AS (SELECT mixture, count(DISTINCT dataset) AS sets, min(dataset) AS first FROM o GROUP BY 1),
c AS (SELECT o.mixture, o.name, count(*) = any_value(s.sets) AS common, bool_or(o.dataset = s.first) AS in_first, min(o.px) AS px, arg_min(o.dataset, (o.px, o.dataset)) AS of FROM o JOIN s USING (mixture) GROUP BY 1, 2),
a AS (SELECT mixture, bool_or(common) AS has FROM c GROUP BY 1)
SELECT mixture, name, px, of AS dataset, common FROM c JOIN a USING (mixture) WHERE common OR (NOT has AND in_first)""")
def _(spark, sf):
    return views.choose(_views(spark, sf), "mixture", "dataset", "raw", "px", SYNONYMS)


@query("u5_available_views", f"""WITH {VIEWS} SELECT mixture, string_agg(DISTINCT name, ',' ORDER BY name) AS views FROM m GROUP BY 1""".replace("string_agg(DISTINCT name, ',' ORDER BY name)", "array_to_string(list_sort(list(DISTINCT CASE name WHEN 'head' THEN '0head' WHEN 'left_hand' THEN '1left_hand' WHEN 'right_hand' THEN '2right_hand' ELSE '3' || name END)), ',')"))
def _(spark, sf):
    v = views.available(_views(spark, sf), "mixture", "raw", SYNONYMS, ["head", "left_hand", "right_hand"])
    return v.select("mixture", F.array_join(F.transform("views", lambda x: F.concat(F.when(x == "head", "0").when(x == "left_hand", "1").when(x == "right_hand", "2").otherwise("3"), x)), ",").alias("views"))


R7 = r"WITH w AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''), lambda x: length(x)) AS ids FROM conversations)"


def _ids(spark, sf):
    """conv_id, turn, ids: a word's length stands for its token."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.transform(words, lambda w: F.length(w)).alias("ids"))


@query("r7_pad_and_pack", R7 + ", m AS (SELECT conv_id, max(len(ids)) AS longest FROM w GROUP BY 1) SELECT conv_id, turn, array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda x: 0)), ',') AS padded, len(ids) AS length FROM w JOIN m USING (conv_id)")
def _(spark, sf):
    """Rows of a conversation padded at their end to its longest, by value."""
    out = collate.pad(_ids(spark, sf), ["conv_id"], "ids", 0)
    return out.select("conv_id", "turn", F.array_join("padded", ",").alias("padded"), F.col("length").cast("long").alias("length"))


@query("r7_packed", R7 + ", t AS (SELECT conv_id, array_to_string(flatten(list(ids ORDER BY turn)), ',') AS packed, list(len(ids) ORDER BY turn) AS n FROM w GROUP BY 1) SELECT conv_id, packed, '0' || array_to_string(list_transform(range(1, len(n) + 1), lambda i: ',' || list_sum(n[1:i])::BIGINT), '') AS offsets FROM t")
def _(spark, sf):
    """Rows of a conversation end to end, with the offsets at which they begin and the last ends."""
    out = collate.pack(_ids(spark, sf), ["conv_id"], ["turn"], "ids")
    return out.select("conv_id", F.array_join("packed", ",").alias("packed"), F.array_join("offsets", ",").alias("offsets"))
