"""Queries over episodes: scans, filters, joins, windows, returns, advantages, labels, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pose
from ..operators import alignment, metrics, returns, sampling, steps
from ..sources import readers, writers
from .base import EV, episodes, frames, labelled, query, r6, table

PENALTY, GAMMA = 10.0, 0.99


def _valued(spark, sf):
    """Labelled frames with a return and a prediction."""
    df = returns.return_to_go(labelled(spark, sf), "episode", "success", PENALTY)
    return df.withColumn("pred_value", F.col("return_to_go") * 0.9 + F.col("step") % 7 - 3.0)


LAST = "max(step) OVER (PARTITION BY episode)"
G = f"(-(({LAST}) - step) + CASE WHEN success THEN 0.0 ELSE -10.0 END)"
VAL = f"""{EV}, g AS (SELECT *, CAST({G} AS DOUBLE) AS return_to_go FROM lab), val AS (SELECT *, return_to_go * 0.9 + step % 7 - 3.0 AS pred_value FROM g)"""


# scans ---------------------------------------------------------------------------------------------------------------
@query("s1_episode_scan", f"WITH {EV} SELECT episode, count(*) AS frames, max(step) AS last_step, 'events' AS dataset_key FROM ev GROUP BY episode")
def _(spark, sf):
    ev = frames(spark, sf).withColumn("dataset_key", F.lit("events"))
    return ev.groupBy("episode", "dataset_key").agg(F.count(F.lit(1)).alias("frames"), F.max("step").alias("last_step"))


@query("s2_shared_scan_offsets", f"WITH {EV}, o AS (SELECT episode, min(us) AS f FROM ev GROUP BY episode) SELECT ev.episode, ev.step, ev.us - o.f + 1000 AS timestamp FROM ev JOIN o USING (episode) WHERE ev.episode % 5 = 0")
def _(spark, sf):
    ev = frames(spark, sf)
    offsets = ev.groupBy("episode").agg((1000 - F.min("us")).alias("from_timestamp"))
    one = ev.where(F.col("episode") % 5 == 0).select("episode", "step", F.col("us").alias("timestamp"))
    return readers.shift_times(one, offsets, "episode")


@query("s4_document_explode", f"WITH {EV} SELECT episode, count(*) AS entries, round(sum(value), 6) AS total FROM ev GROUP BY episode")
def _(spark, sf):
    ev = frames(spark, sf)
    nested = ev.groupBy("episode").agg(F.collect_list(F.struct("step", "value")).alias("advantages"))
    return nested.select("episode", F.explode("advantages").alias("e")).groupBy("episode").agg(F.count(F.lit(1)).alias("entries"), r6(F.sum("e.value"), "total"))


@query("s6_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").where("l_quantity > 45")


@query("s9_log_last_match", "WITH l AS (SELECT conv_id, turn, regexp_extract(text, '([0-9]+)', 1) AS v FROM conversations) SELECT 'run/' || conv_id || '.log' AS file, 'run_' || conv_id AS x, arg_max(v, turn) FILTER (WHERE v <> '') AS y FROM l GROUP BY conv_id".replace("'run_' || conv_id AS x, arg_max(v, turn) FILTER (WHERE v <> '') AS y", "CAST(conv_id AS VARCHAR) AS name, CAST(arg_max(v, turn) FILTER (WHERE v <> '') AS DOUBLE) AS value"))
def _(spark, sf):
    lines = table(spark, sf, "conversations").select(F.concat(F.lit("run/"), F.col("conv_id").cast("string"), F.lit(".log")).alias("file"), "turn", "text")
    return readers.last_matches(lines, "file", "turn", "text", r"([0-9]+)", r"env_name=(\w+)")


# filters -------------------------------------------------------------------------------------------------------------
@query("f1_stride", f"WITH {EV} SELECT episode, step, value FROM ev WHERE step % 3 = 0")
def _(spark, sf):
    return steps.stride(frames(spark, sf), 3).select("episode", "step", "value")


INDEX = "CASE WHEN event_type = 'error' THEN -1 ELSE length(event_type) END"


@query("f2_drop_unannotated", f"WITH {EV} SELECT episode, step, CAST({INDEX} AS BIGINT) AS subtask_index FROM ev WHERE step % 2 = 0 AND ({INDEX}) >= 0")
def _(spark, sf):
    ev = frames(spark, sf).withColumn("subtask_index", F.when(F.col("event_type") == "error", -1).otherwise(F.length("event_type")).cast("long"))
    return steps.annotated(steps.stride(ev, 2), "subtask_index").select("episode", "step", "subtask_index")


@query("f3_first_step_language", f"WITH {EV}, ok AS (SELECT episode FROM ev WHERE step = 0 AND event_type <> 'error') SELECT episode, count(*) AS n FROM ev WHERE episode IN (SELECT episode FROM ok) GROUP BY episode")
def _(spark, sf):
    ev = frames(spark, sf).withColumn("lang", F.when(F.col("event_type") != "error", F.col("event_type")))
    return steps.with_language(ev, "episode", "lang").groupBy("episode").agg(F.count(F.lit(1)).alias("n"))


@query("f4_checked_lookup", "SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return steps.lookup(table(spark, sf, "customer"), nation, "c_nationkey", "nation").select("c_custkey", "nation")


@query("f5_nonempty_datasets", "SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) > 0")
def _(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("n")).where("n > 0")
    return table(spark, sf, "nation").join(n, "n_nationkey").select("n_nationkey", "n_name", "n")


@query("f7_keep_above_bin", f"WITH {VAL} SELECT episode, step, return_to_go FROM val WHERE return_to_go >= -20")
def _(spark, sf):
    return _valued(spark, sf).where("return_to_go >= -20").select("episode", "step", "return_to_go")


@query("f8_candidates", f"WITH {VAL} SELECT episode, step, round(return_to_go - pred_value, 6) AS advantage FROM val WHERE return_to_go - pred_value > 1.5")
def _(spark, sf):
    df = _valued(spark, sf).withColumn("advantage", F.col("return_to_go") - F.col("pred_value"))
    return df.where("advantage > 1.5").select("episode", "step", r6("advantage", "advantage"))


@query("f9_complete_runs", "SELECT l_orderkey AS run, min(o_orderpriority) AS seed, count(*) AS files FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING count(*) = 4")
def _(spark, sf):
    files = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("seed")), F.col("l_orderkey") == F.col("o_orderkey"))
    return readers.complete_runs(files.select(F.col("l_orderkey").alias("run"), "seed"), "run", "seed", 4)


@query("f11_length_guard", "SELECT o_orderkey, count(l_orderkey) AS length, count(l_orderkey) AS rows, true AS matches FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    meta = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("length")).join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return steps.lengths_match(lines, meta, "o_orderkey")


@query("f13_episode_exists", "WITH w AS (SELECT DISTINCT c_custkey AS id FROM customer) SELECT id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = id) AS found FROM w")
def _(spark, sf):
    want = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).distinct()
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return want.join(have, "id", "left_semi").withColumn("found", F.lit(True)).union(want.join(have, "id", "left_anti").withColumn("found", F.lit(False)))


# joins ---------------------------------------------------------------------------------------------------------------
TASKS = "tasks AS (SELECT DISTINCT length(event_type) AS task_index, event_type AS t FROM events), tk AS (SELECT task_index, min(t) AS text FROM tasks GROUP BY 1)"


@query("j1_task_text", f"WITH {EV}, {TASKS}, x AS (SELECT episode, step, CAST(CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'view' THEN 99 ELSE length(event_type) END AS BIGINT) AS task_index FROM ev) SELECT episode, step, CASE WHEN x.task_index < 0 THEN '' ELSE tk.text END AS text FROM x LEFT JOIN tk ON x.task_index = tk.task_index WHERE CASE WHEN x.task_index < 0 THEN '' ELSE tk.text END IS NOT NULL")
def _(spark, sf):
    ev = frames(spark, sf)
    tasks = ev.groupBy(F.length("event_type").cast("long").alias("task_index")).agg(F.min("event_type").alias("text"))
    x = ev.withColumn("task_index", F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 99).otherwise(F.length("event_type")).cast("long"))
    return steps.episode_texts(x, tasks, "task_index", "text").select("episode", "step", "text")


@query("j2_success_resolution", f"WITH {EV}, f AS (SELECT episode, arg_min(CASE WHEN event_type = 'error' THEN false WHEN event_type = 'purchase' THEN true END, step) AS a, bool_or(false) FILTER (WHERE step = 0 AND event_type = 'error') AS z, first(event_type ORDER BY step) AS t FROM ev GROUP BY episode) SELECT f.episode, CASE WHEN t = 'error' THEN false WHEN t = 'purchase' THEN true WHEN f.episode % 3 = 0 THEN epi.success ELSE true END AS success FROM f JOIN epi USING (episode)")
def _(spark, sf):
    ev = frames(spark, sf)
    flag = ev.withColumn("success", F.when((F.col("step") == 0) & (F.col("event_type") == "error"), False).when((F.col("step") == 0) & (F.col("event_type") == "purchase"), True))
    first = flag.where("step = 0")  # flags are read at an episode's first frame
    meta = episodes(ev).where("episode % 3 = 0").select("episode", "success")
    return returns.resolve_success(first, meta, "episode", ["success_col", "success", "episode_success"])


@query("j3_ahead_by_step", f"WITH {EV}, k AS (SELECT * FROM ev WHERE step % 5 <> 2) SELECT a.episode, a.step, b.value AS value_ahead FROM k a LEFT JOIN k b ON a.episode = b.episode AND b.step = a.step + 3")
def _(spark, sf):
    ev = frames(spark, sf).where("step % 5 <> 2")
    return returns.ahead(ev, ["episode"], "step", 3, {"value_ahead": "value"}).select("episode", "step", "value_ahead")


@query("j4_value_lookup", f"WITH {VAL} SELECT o_orderkey, return_to_go FROM orders JOIN val ON val.episode = o_custkey AND val.step = o_orderkey % 10")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("episode"), (F.col("o_orderkey") % 10).alias("step"))
    return o.join(_valued(spark, sf).select("episode", "step", "return_to_go"), ["episode", "step"]).select("o_orderkey", "return_to_go")


@query("j5_task_horizon", f"WITH {EV} SELECT episode, task, CAST(max(greatest(1, length - 1)) OVER (PARTITION BY task) AS DOUBLE) AS horizon FROM epi")
def _(spark, sf):
    return returns.horizons(episodes(frames(spark, sf)), "task").select("episode", "task", "horizon")


@query("j6_task_name_fallback", f"WITH {EV} SELECT episode, coalesce(r_name, 'task_' || (episode % 9)) AS split FROM epi LEFT JOIN region ON r_regionkey = episode % 9")
def _(spark, sf):
    e = episodes(frames(spark, sf)).withColumn("k", (F.col("episode") % 9).cast("int"))
    return e.join(table(spark, sf, "region"), F.col("k") == F.col("r_regionkey"), "left").select("episode", F.coalesce("r_name", F.concat(F.lit("task_"), F.col("k").cast("string"))).alias("split"))


PROBE = f"{EV}, p AS (SELECT episode, us, event_id FROM ev WHERE event_type = 'purchase'), f AS (SELECT episode, us, event_id FROM ev WHERE event_type = 'click')"


def _sides(spark, sf):
    ev = frames(spark, sf)
    return ev.where("event_type = 'purchase'").select("episode", "us", "event_id"), ev.where("event_type = 'click'").select("episode", "us", "event_id")


@query("j7_nearest", f"WITH {PROBE}, r AS (SELECT p.episode, p.event_id AS probe, p.us AS probe_time, f.event_id AS frame, f.us AS frame_time, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(f.us - p.us), f.us, f.event_id) AS k FROM p LEFT JOIN f ON p.episode = f.episode) SELECT episode, probe, probe_time, frame, frame_time FROM r WHERE k = 1")
def _(spark, sf):
    return alignment.asof_nearest(*_sides(spark, sf), ["episode"], "us", "event_id")


@query("j8_forward", f"WITH {PROBE}, r AS (SELECT p.episode, p.event_id AS probe, p.us AS probe_time, f.event_id AS frame, f.us AS frame_time, row_number() OVER (PARTITION BY p.event_id ORDER BY CASE WHEN f.us >= p.us THEN 0 ELSE 1 END, CASE WHEN f.us >= p.us THEN f.us ELSE -f.us END, CASE WHEN f.us >= p.us THEN f.event_id ELSE -f.event_id END) AS k FROM p LEFT JOIN f ON p.episode = f.episode) SELECT episode, probe, probe_time, frame, frame_time FROM r WHERE k = 1")
def _(spark, sf):
    return alignment.asof_forward(*_sides(spark, sf), ["episode"], "us", "event_id")


@query("j9_backward", f"WITH {PROBE}, r AS (SELECT p.episode, p.event_id AS probe, p.us AS probe_time, f.event_id AS frame, f.us AS frame_time, row_number() OVER (PARTITION BY p.event_id ORDER BY f.us DESC NULLS LAST, f.event_id DESC) AS k FROM p LEFT JOIN f ON p.episode = f.episode AND f.us <= p.us) SELECT episode, probe, probe_time, frame, frame_time FROM r WHERE k = 1")
def _(spark, sf):
    return alignment.asof_backward(*_sides(spark, sf), ["episode"], "us", "event_id")


HOUR = 3_600_000_000


@query("j10_resample", f"WITH {EV}, s AS (SELECT episode, event_id, us, CAST(floor((us - min(us) OVER (PARTITION BY episode)) / {HOUR}.0) AS BIGINT) AS slot FROM ev), h AS (SELECT episode, slot, arg_min(event_id, (us, event_id)) AS frame FROM s GROUP BY episode, slot), n AS (SELECT *, coalesce(lead(slot) OVER (PARTITION BY episode ORDER BY slot), slot + 1) AS nxt FROM h) SELECT episode, unnest(generate_series(slot, nxt - 1)) AS slot, frame FROM n".replace("arg_min(event_id, (us, event_id))", "first(event_id ORDER BY us, event_id)"))
def _(spark, sf):
    return alignment.resample(frames(spark, sf), ["episode"], "us", "event_id", HOUR)


@query("j11_common_keys", "SELECT l_suppkey AS k FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def _(spark, sf):
    line = table(spark, sf, "lineitem")
    n = line.agg(F.count_distinct("l_returnflag").alias("n"))
    return line.groupBy(F.col("l_suppkey").alias("k")).agg(F.count_distinct("l_returnflag").alias("c")).join(F.broadcast(n), F.col("c") == F.col("n")).select("k")


@query("j12_id_intersection", "SELECT c_custkey AS id FROM customer INTERSECT SELECT user_id FROM events")
def _(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, sf, "events").select(F.col("user_id").alias("id")))


@query("j13_interval_labels", f"WITH {EV}, s AS (SELECT episode, event_type AS label, step AS st, step + 3 AS en FROM ev WHERE event_type IN ('signup', 'error')) SELECT ev.episode, ev.step, coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM s WHERE s.episode = ev.episode AND ev.step >= st - 2 AND ev.step < en), '') AS labels FROM ev")
def _(spark, sf):
    ev = frames(spark, sf)
    spans = ev.where(F.col("event_type").isin("signup", "error")).select("episode", F.col("event_type").alias("label"), F.col("step").alias("start"), (F.col("step") + 3).alias("end"))
    return alignment.intervals(ev, spans, ["episode"], "step", "label", 2)


# windows -------------------------------------------------------------------------------------------------------------
def _offsets_sql(pad: str) -> str:
    at = "greatest(0, least(length - 1, step + o))"
    value = "b.value" if pad != "zero" else "CASE WHEN a.step + o BETWEEN 0 AND a.length - 1 THEN b.value ELSE 0.0 END"
    return f'WITH {EV}, a AS (SELECT episode, step, length, unnest([-2, 0, 3]) AS o FROM lab) SELECT a.episode, a.step, CAST(o AS BIGINT) AS "offset", {value} AS value FROM a JOIN ev b ON a.episode = b.episode AND b.step = {at.replace("step", "a.step").replace("length", "a.length")}'


for _name, _pad in (("w1_gather_first_last", "first_last"), ("w1_gather_zero", "zero"), ("w2_gather_clamp", "clamp")):

    @query(_name, _offsets_sql(_pad))
    def _(spark, sf, pad=_pad):
        return steps.offset_windows(frames(spark, sf), "episode", "value", [-2, 0, 3], pad)


@query("w3_reward", f"WITH {EV} SELECT episode, step, CASE WHEN step = {LAST} THEN CASE WHEN success THEN 0.0 ELSE -10.0 END ELSE -1.0 END::DOUBLE AS reward FROM lab".replace("END::DOUBLE AS reward", "END * CAST(1 AS DOUBLE) AS reward"))
def _(spark, sf):
    return returns.rewards(labelled(spark, sf), "episode", "success", PENALTY).select("episode", "step", "reward")


@query("w4_return_to_go", f"WITH {VAL} SELECT episode, step, return_to_go FROM val")
def _(spark, sf):
    return returns.return_to_go(labelled(spark, sf), "episode", "success", PENALTY).select("episode", "step", "return_to_go")


@query("w4_discounted_return", f"WITH {EV}, k AS (SELECT episode, step, success, CAST({LAST} - step AS DOUBLE) AS k FROM lab) SELECT episode, step, round(-(1 - pow(0.99, k)) / (1 - 0.99::DOUBLE) + pow(0.99, k) * CASE WHEN success THEN 0.0 ELSE -10.0 END, 6) AS return_to_go FROM k".replace("0.99::DOUBLE", "CAST(0.99 AS DOUBLE)"))
def _(spark, sf):
    df = returns.return_to_go(labelled(spark, sf), "episode", "success", PENALTY, GAMMA)
    return df.select("episode", "step", r6("return_to_go", "return_to_go"))


@query("w5_normalised_return", f"WITH {VAL}, h AS (SELECT *, CAST(max(greatest(1, length - 1)) OVER (PARTITION BY task) AS DOUBLE) AS hz FROM val) SELECT episode, step, round(greatest(-1.0, least(0.0, return_to_go / greatest(1.0, hz + 10.0))), 6) AS target FROM h")
def _(spark, sf):
    ev = _valued(spark, sf)
    hz = returns.horizons(episodes(frames(spark, sf)), "task").select("episode", "horizon")
    return ev.join(hz, "episode").select("episode", "step", r6(returns.normalised(F.col("return_to_go"), F.col("horizon"), PENALTY), "target"))


ADV = f"""{VAL}, q AS (SELECT a.*, b.return_to_go AS gn, b.pred_value AS vn FROM val a LEFT JOIN val b ON a.episode = b.episode AND b.step = a.step + 5),
adv AS (SELECT *, CASE WHEN gn IS NULL THEN return_to_go ELSE return_to_go - pow(0.99, 5) * gn END AS n_step_reward, CASE WHEN gn IS NULL THEN 0.0 ELSE vn END AS bootstrap_value FROM q),
ad AS (SELECT *, n_step_reward + pow(0.99, 5) * bootstrap_value - pred_value AS advantage_raw, (n_step_reward + pow(0.99, 5) * bootstrap_value - pred_value) / 4.0 AS advantage FROM adv)"""


def _advantages(spark, sf):
    return returns.n_step(_valued(spark, sf), ["episode"], 5, GAMMA, 4.0)


@query("w6_n_step_reward", f"WITH {ADV} SELECT episode, step, round(n_step_reward, 6) AS n_step_reward, round(CAST(bootstrap_value AS DOUBLE), 6) AS bootstrap_value FROM ad")
def _(spark, sf):
    return _advantages(spark, sf).select("episode", "step", r6("n_step_reward", "n_step_reward"), r6("bootstrap_value", "bootstrap_value"))


@query("w7_advantage", f"WITH {ADV} SELECT episode, step, round(advantage_raw, 6) AS advantage_raw, round(advantage, 6) AS advantage FROM ad")
def _(spark, sf):
    return _advantages(spark, sf).select("episode", "step", r6("advantage_raw", "advantage_raw"), r6("advantage", "advantage"))


def _label_sql(threshold: float, fraction: float, least: int) -> str:
    return f"""{ADV}, a6 AS (SELECT coalesce(task, '__unknown_task__') AS task, episode, step, event_id, round(advantage, 6) AS advantage FROM ad),
cnt AS (SELECT *, count(*) FILTER (WHERE advantage > {threshold}) OVER (PARTITION BY task) AS c, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN advantage > {threshold} THEN advantage END DESC NULLS LAST, event_id) AS r FROM a6),
lb AS (SELECT *, CAST(CASE WHEN advantage > {threshold} AND r <= least(c, greatest({least}, ceil({fraction} * c))) THEN 1 ELSE 0 END AS BIGINT) AS label FROM cnt)"""


def _labels(spark, sf, threshold, fraction, least):
    adv = _advantages(spark, sf).select(F.coalesce("task", F.lit("__unknown_task__")).alias("task"), "episode", "step", "event_id", r6("advantage", "advantage"))
    return returns.top_fraction(adv, "task", "advantage", "event_id", fraction, threshold, least)


@query("w8_top_fraction_labels", f"WITH {_label_sql(0.0, 0.4, 1)} SELECT task, episode, step, label FROM lb")
def _(spark, sf):
    return _labels(spark, sf, 0.0, 0.4, 1).select("task", "episode", "step", "label")


@query("w9_threshold_labels", f"WITH {_label_sql(0.25, 0.3, 3)} SELECT task, episode, step, label FROM lb WHERE label = 1")
def _(spark, sf):
    return _labels(spark, sf, 0.25, 0.3, 3).where("label = 1").select("task", "episode", "step", "label")


@query("w10_average_rank", f"WITH {EV}, v AS (SELECT event_type, event_id, floor(value / 10) AS b FROM ev) SELECT event_type, event_id, rank() OVER (PARTITION BY event_type ORDER BY b) - 1 + (count(*) OVER (PARTITION BY event_type, b) - 1) / 2.0 AS r FROM v".replace("/ 2.0 AS r", "/ CAST(2 AS DOUBLE) AS r"))
def _(spark, sf):
    ev = frames(spark, sf).select("event_type", "event_id", F.floor(F.col("value") / 10).alias("b"))
    return metrics.average_rank(ev, "b", "r", ["event_type"]).select("event_type", "event_id", "r")


@query("w11_moving_average", f"WITH {EV}, m AS (SELECT event_type, event_id, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 99 PRECEDING) AS s, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ev) SELECT event_type, event_id, round(s, 6) AS smooth FROM m WHERE r >= 100 AND n > 100")
def _(spark, sf):
    return steps.moving_average(frames(spark, sf), "value", ["event_id"], ["event_type"]).select("event_type", "event_id", r6("smooth", "smooth"))


@query("w12_start_index", f'WITH {EV} SELECT episode, length, CAST(sum(length) OVER (ORDER BY episode) - length AS BIGINT) AS "start" FROM epi')
def _(spark, sf):
    return steps.start_index(episodes(frames(spark, sf)), "length", ["episode"]).select("episode", "length", F.col("start").cast("long").alias("start"))


@query("w13_greedy_selection", f"WITH {EV}, t AS (SELECT CAST(sum(length) AS DOUBLE) * 0.37 AS target FROM epi), c AS (SELECT episode, length, sum(length) OVER (ORDER BY length, episode) AS cum FROM epi) SELECT episode, length FROM c, t WHERE cum < target OR cum - length = 0 OR (cum - length < target AND abs(cum - length - target) >= abs(cum - target))")
def _(spark, sf):
    e = episodes(frames(spark, sf))
    target = float(e.agg(F.sum("length")).first()[0] or 0) * 0.37
    return sampling.greedy(e, "length", ["length", "episode"], target).select("episode", "length")


@query("w15_history", f"WITH {EV} SELECT episode, step, CASE WHEN step >= 2 THEN lag(value, 2) OVER w ELSE first_value(value) OVER w END AS back2, CASE WHEN step >= 1 THEN lag(value, 1) OVER w ELSE first_value(value) OVER w END AS back1, value AS back0 FROM ev WINDOW w AS (PARTITION BY episode ORDER BY step)")
def _(spark, sf):
    h = steps.history(frames(spark, sf), "episode", "value", 3)
    return h.select("episode", "step", *[F.col("history")[i].alias(f"back{2 - i}") for i in range(3)])


ENS = f"""WITH {EV}, c AS (SELECT episode, step AS made, value AS a, lead(value, 1, 0.0) OVER w AS b, lead(value, 2, 1.0) OVER w AS c FROM ev WINDOW w AS (PARTITION BY episode ORDER BY step)),
v AS (SELECT episode, made, made AS step, a AS x, b AS y FROM c UNION ALL SELECT episode, made, made + 1, b, c FROM c),
t AS (SELECT *, first_value(x) OVER w AS tx, first_value(y) OVER w AS ty FROM v WINDOW w AS (PARTITION BY episode, step ORDER BY made DESC)),
k AS (SELECT *, exp(0.1 * ((x * tx + y * ty) / (sqrt(x * x + y * y) * sqrt(tx * tx + ty * ty) + 1e-7))) AS w FROM t)
SELECT episode, step, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM k GROUP BY episode, step"""


@query("w16_temporal_ensemble", ENS)
def _(spark, sf):
    w = Window.partitionBy("episode").orderBy("step")
    b, c = F.lead("value", 1, 0.0).over(w), F.lead("value", 2, 1.0).over(w)
    chunks = frames(spark, sf).select("episode", F.col("step").alias("made"), F.array(F.array(F.col("value"), b), F.array(b, c)).alias("chunk"))
    long = metrics.ensemble(chunks, ["episode"], "made", "chunk", 0.1, 10)
    return long.groupBy("episode", "step").agg(r6(F.sum(F.when(F.col("dim") == 0, F.col("x"))), "x"), r6(F.sum(F.when(F.col("dim") == 1, F.col("x"))), "y"))


@query("w17_packing_offsets", f"WITH {EV} SELECT task, episode, CAST(sum(length) OVER (PARTITION BY task ORDER BY episode) AS BIGINT) AS end_offset FROM epi")
def _(spark, sf):
    e = steps.start_index(episodes(frames(spark, sf)), "length", ["episode"], ["task"])
    return e.select("task", "episode", (F.col("start") + F.col("length")).cast("long").alias("end_offset"))


@query("w19_tiles", f"WITH {EV} SELECT episode, CAST(floor(step / 8.0) AS BIGINT) AS chunk, count(*) AS n, round(sum(value), 6) AS total FROM ev GROUP BY 1, 2")
def _(spark, sf):
    return steps.tiles(frames(spark, sf), 8).groupBy("episode", "chunk").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total"))


@query("w20_last_of_history", f"WITH {EV} SELECT episode, max(value) FILTER (WHERE step = length - 1) AS back0, max(value) FILTER (WHERE step = length - 3) AS back2 FROM lab GROUP BY episode")
def _(spark, sf):
    h = frames(spark, sf).groupBy("episode").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "value"))), lambda s: s["value"]).alias("h"))
    last = steps.last_of(F.col("h"), [0, -2])
    return h.select("episode", last[0].alias("back0"), last[1].alias("back2"))


# value bins ----------------------------------------------------------------------------------------------------------
BIN = "greatest(0, least(50, CAST(round_even((return_to_go + 100.0) / 2.0, 0) AS BIGINT)))"


@query("p25_value_bin", f"WITH {VAL} SELECT episode, step, {BIN} AS bin FROM val")
def _(spark, sf):
    return _valued(spark, sf).select("episode", "step", returns.value_bin(F.col("return_to_go"), -100.0, 0.0, 51).alias("bin"))


SOFT = """b AS (SELECT episode, step, (greatest(-100.0, least(0.0, pred_value)) + 100.0) / 2.0 AS b FROM val), l AS (SELECT *, CAST(floor(b) AS BIGINT) AS lo, CAST(ceil(b) AS BIGINT) AS hi FROM b),
w AS (SELECT episode, step, lo AS bin, CASE WHEN lo = hi THEN 1.0 ELSE hi - b END AS weight FROM l UNION ALL SELECT episode, step, hi, b - lo FROM l WHERE lo <> hi)"""


@query("p26_two_bin_projection", f"WITH {VAL}, {SOFT} SELECT episode, step, bin, round(CAST(weight AS DOUBLE), 6) AS weight FROM w")
def _(spark, sf):
    return returns.two_bin(_valued(spark, sf), "pred_value", -100.0, 0.0, 51).select("episode", "step", "bin", r6("weight", "weight"))


# aggregates and metrics ----------------------------------------------------------------------------------------------
@query("a6_label_statistics", f"WITH {_label_sql(0.0, 0.4, 1)} SELECT task, count(*) AS n, round(sum(advantage), 6) AS total, min(advantage) AS least, max(advantage) AS most, round(avg(advantage), 6) AS mean, CAST(sum(label) AS BIGINT) AS positive, CAST(sum(1 - label) AS BIGINT) AS negative FROM lb GROUP BY task")
def _(spark, sf):
    s = returns.label_summary(_labels(spark, sf, 0.0, 0.4, 1), "task", "advantage")
    return s.select("task", "n", r6("total", "total"), "least", "most", r6("mean", "mean"), "positive", "negative")


@query("a7_grand_totals", f"WITH {_label_sql(0.25, 0.3, 3)} SELECT task, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive, round(avg(label), 6) AS share FROM lb GROUP BY ROLLUP (task)")
def _(spark, sf):
    return _labels(spark, sf, 0.25, 0.3, 3).rollup("task").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive"), r6(F.avg("label"), "share"))


MANIFEST = "count(*) AS episodes, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS success_episodes, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS failure_episodes, CAST(sum(CASE WHEN success THEN length ELSE 0 END) AS BIGINT) AS success_frames, CAST(sum(CASE WHEN success THEN 0 ELSE length END) AS BIGINT) AS failure_frames"


@query("a8_episode_counts", f"WITH {EV}, m AS (SELECT {MANIFEST} FROM epi) SELECT *, round(failure_frames / CAST(nullif(success_frames, 0) AS DOUBLE), 6) AS ratio FROM m")
def _(spark, sf):
    return writers.manifest(episodes(frames(spark, sf)), "success", "length").withColumn("ratio", F.round("ratio", 6))


@query("a9_task_counters", f"WITH {EV} SELECT task, count(*) AS episodes, CAST(sum(length) AS BIGINT) AS frames, CAST(count_if(success) AS BIGINT) AS successes FROM epi GROUP BY task")
def _(spark, sf):
    return episodes(frames(spark, sf)).groupBy("task").agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("frames"), F.count_if("success").alias("successes"))


POINTS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _dist_sql(value: str, points: dict[str, float]) -> str:
    return f'count({value}) AS n, min({value}) AS "min", max({value}) AS "max", round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS std, ' + ", ".join(f"round(quantile_cont({value}, {p}), 6) AS {k}" for k, p in points.items())


def _dist(df, value, by, points):
    d = metrics.distribution(df, value, by, points)
    return d.select(*by, "n", "min", "max", *[r6(c, c) for c in ("mean", "std", *points)])


@query("a10_return_distribution", f"WITH {VAL} SELECT task, success, {_dist_sql('return_to_go', POINTS)} FROM val GROUP BY task, success")
def _(spark, sf):
    return _dist(_valued(spark, sf), "return_to_go", ["task", "success"], POINTS)


@query("a10_trajectory_means", f"WITH {VAL}, m AS (SELECT episode, avg(return_to_go) AS m FROM val GROUP BY episode) SELECT {_dist_sql('m', {'p05': .05, 'p50': .5, 'p95': .95})} FROM m".replace('min(m) AS "min", max(m) AS "max"', 'round(min(m), 6) AS "min", round(max(m), 6) AS "max"'))
def _(spark, sf):
    m = _valued(spark, sf).groupBy("episode").agg(F.avg("return_to_go").alias("m"))
    return _dist(m, "m", [], {"p05": 0.05, "p50": 0.5, "p95": 0.95}).withColumns({"min": F.round("min", 6), "max": F.round("max", 6)})


@query("a11_prediction_distribution", f"WITH {VAL}, v AS (SELECT round(coalesce(CASE WHEN step % 2 = 0 THEN return_to_go END, pred_value), 6) AS v FROM val) SELECT {_dist_sql('v', {'p01': .01, 'p05': .05, 'p50': .5, 'p95': .95, 'p99': .99})} FROM v")
def _(spark, sf):
    v = _valued(spark, sf).withColumn("value_t", F.when(F.col("step") % 2 == 0, F.col("return_to_go"))).select(r6(F.coalesce("value_t", "pred_value"), "v"))
    return _dist(v, "v", [], {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("a12_value_counts", f"WITH {EV}, c AS (SELECT nullif(CAST({INDEX} AS BIGINT), 8) AS v FROM ev) SELECT v AS subtask_index, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM c GROUP BY v ORDER BY n DESC, v LIMIT 15")
def _(spark, sf):
    v = frames(spark, sf).select(F.when(F.col("event_type") == "error", -1).otherwise(F.length("event_type")).cast("long").alias("subtask_index")).withColumn("subtask_index", F.nullif("subtask_index", F.lit(8).cast("long")))
    return metrics.value_counts(v, "subtask_index").select("subtask_index", "n", r6("share", "share")).orderBy(F.desc("n"), "subtask_index").limit(15)


@query("a13_bin_range", f"WITH {VAL} SELECT round(min(return_to_go) - 0.1 * (max(return_to_go) - min(return_to_go)), 6) AS low, round(max(return_to_go) + 0.1 * (max(return_to_go) - min(return_to_go)), 6) AS high FROM val")
def _(spark, sf):
    return metrics.value_range(_valued(spark, sf), "return_to_go", 0.1).select(r6("low", "low"), r6("high", "high"))


FIT = f"""WITH {EV}, d AS (SELECT event_type, greatest(0.0, least(1.0, value / 100.0)) AS p, greatest(0.0, least(1.0, (event_id % 100) / 90.0)) AS t FROM ev),
d2 AS (SELECT event_type, CAST(p AS DOUBLE) AS p, CAST(t AS DOUBLE) AS t FROM d),
k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY p) - 1 + (count(*) OVER (PARTITION BY event_type, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY event_type ORDER BY t) - 1 + (count(*) OVER (PARTITION BY event_type, t) - 1) / 2.0 AS rt FROM d2)
SELECT event_type, count(*) AS n, round(avg((p - t) * (p - t)), 6) AS mse, round(avg(abs(p - t)), 6) AS mae, round(corr(p, t), 6) AS pearson, round(corr(rp, rt), 6) AS spearman FROM k GROUP BY event_type"""


@query("a14_fit", FIT)
def _(spark, sf):
    ev = frames(spark, sf).withColumn("p", F.col("value") / 100.0).withColumn("t", (F.col("event_id") % 100) / 90.0)
    return metrics.fit(ev, "p", "t", ["event_type"]).select("event_type", "n", *[r6(c, c) for c in ("mse", "mae", "pearson", "spearman")])


EDGES = [-600.0, -400.0, -200.0, -100.0, -50.0, 0.0]
_case = " ".join(f"WHEN return_to_go >= {a} AND return_to_go < {b} THEN {i}" for i, (a, b) in enumerate(zip(EDGES[:-1], EDGES[1:], strict=True)))


@query("a15_bucketed_errors", f"WITH {VAL}, b AS (SELECT *, CAST(CASE WHEN return_to_go = 0.0 THEN 4 {_case} END AS BIGINT) AS bucket FROM val) SELECT bucket, count(*) AS n, round(avg((pred_value - return_to_go) * (pred_value - return_to_go)), 6) AS mse, round(avg(abs(pred_value - return_to_go)), 6) AS mae FROM b WHERE bucket IS NOT NULL GROUP BY bucket")
def _(spark, sf):
    return metrics.bucketed_errors(_valued(spark, sf), "pred_value", "return_to_go", EDGES).select("bucket", "n", r6("mse", "mse"), r6("mae", "mae"))


_ERR = "pred_value - return_to_go"


@query("a16_episode_errors", f"WITH {VAL} SELECT episode, count(*) AS n, round(avg(abs({_ERR})), 6) AS mae, round(sqrt(avg(({_ERR}) * ({_ERR}))), 6) AS rmse, round(max(abs({_ERR})), 6) AS max_abs_err, round(arg_min(pred_value, step), 6) AS first_pred, round(arg_max(pred_value, step), 6) AS last_pred, round(arg_min(return_to_go, step), 6) AS first_target, round(arg_max(return_to_go, step), 6) AS last_target, round(arg_min({_ERR}, step), 6) AS first_err, round(arg_max({_ERR}, step), 6) AS last_err, round(avg(pred_value), 6) AS mean_pred, round(avg(return_to_go), 6) AS mean_target FROM val GROUP BY episode")
def _(spark, sf):
    e = metrics.episode_errors(_valued(spark, sf), "episode", "step", "pred_value", "return_to_go")
    return e.select("episode", "n", *[r6(c, c) for c in e.columns if c not in ("episode", "n")])


@query("a17_macro_summary", f"WITH {VAL}, e AS (SELECT episode, any_value(success) AS success, avg(abs({_ERR})) AS mae, avg(pred_value) AS m FROM val GROUP BY episode) SELECT success, count(*) AS episodes, round(avg(mae), 6) AS mae, round(avg(m), 6) AS mean_pred FROM e GROUP BY success")
def _(spark, sf):
    e = _valued(spark, sf).groupBy("episode", "success").agg(F.avg(F.abs(F.col("pred_value") - F.col("return_to_go"))).alias("mae"), F.avg("pred_value").alias("m"))
    return e.groupBy("success").agg(F.count(F.lit(1)).alias("episodes"), r6(F.avg("mae"), "mae"), r6(F.avg("m"), "mean_pred"))


@query("a18_latency", "SELECT round(avg((l_extendedprice - l_quantity) * (l_extendedprice - l_quantity)), 2) AS mse, round(avg(abs(l_extendedprice - l_quantity)), 4) AS mae, round(avg(l_quantity), 6) AS latency, round(quantile_cont(l_quantity, 0.95), 6) AS p95 FROM lineitem")
def _(spark, sf):
    d = F.col("l_extendedprice") - F.col("l_quantity")
    return table(spark, sf, "lineitem").agg(F.round(F.avg(d * d), 2).alias("mse"), F.round(F.avg(F.abs(d)), 4).alias("mae"), r6(F.avg("l_quantity"), "latency"), r6(F.percentile("l_quantity", F.lit(0.95)), "p95"))


@query("a19_success_rate", f"WITH {EV} SELECT task, count(*) AS episodes, CAST(count_if(success) AS BIGINT) AS successes, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS rate FROM epi GROUP BY ROLLUP (task)")
def _(spark, sf):
    return metrics.success_table(episodes(frames(spark, sf)), "task", "success").withColumn("rate", F.round("rate", 6))


@query("a20_log_table", "WITH l AS (SELECT conv_id, arg_max(v, turn) FILTER (WHERE v <> '') AS v FROM (SELECT conv_id, turn, regexp_extract(text, '([0-9]+)', 1) AS v FROM conversations) GROUP BY conv_id) SELECT count(v) AS parsed, count(*) - count(v) AS missing, round(avg(CAST(v AS DOUBLE)), 4) AS mean_success FROM l")
def _(spark, sf):
    lines = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file"), "turn", "text")
    t = readers.last_matches(lines, "file", "turn", "text", r"([0-9]+)", r"env_name=(\w+)")
    return t.agg(F.count("value").alias("parsed"), (F.count(F.lit(1)) - F.count("value")).alias("missing"), F.round(F.avg("value"), 4).alias("mean_success"))


@query("a21_mean_of_means", f"WITH {EV}, m AS (SELECT event_type, episode, avg(value) AS m FROM ev GROUP BY 1, 2) SELECT event_type, round(avg(m), 6) AS value FROM m GROUP BY 1")
def _(spark, sf):
    return metrics.mean_of_means(frames(spark, sf), ["event_type"], ["episode"], "value").select("event_type", r6("value", "value"))


@query("a22_task_preview", f"WITH {EV}, d AS (SELECT task, episode, length, row_number() OVER (PARTITION BY task ORDER BY episode) AS r FROM epi) SELECT task, count(*) AS trajectories, string_agg(CAST(episode AS VARCHAR), ',' ORDER BY episode) FILTER (WHERE r <= 20) AS preview, max(length) - 1 AS max_step FROM d GROUP BY task")
def _(spark, sf):
    ids = F.slice(F.sort_array(F.collect_set("episode")), 1, 20)
    return episodes(frames(spark, sf)).groupBy("task").agg(F.count(F.lit(1)).alias("trajectories"), F.array_join(ids.cast("array<string>"), ",").alias("preview"), (F.max("length") - 1).alias("max_step"))


@query("a23_aggregation_by_name", f"WITH {EV} SELECT episode, 'max' AS how, round(max(value), 6) AS value FROM ev GROUP BY 1 UNION ALL SELECT episode, 'min', round(min(value), 6) FROM ev GROUP BY 1 UNION ALL SELECT episode, 'mean', round(avg(value), 6) FROM ev GROUP BY 1 UNION ALL SELECT episode, 'sum', round(sum(value), 6) FROM ev GROUP BY 1")
def _(spark, sf):
    ev, out = frames(spark, sf), None
    for how in ("max", "min", "mean", "sum"):
        part = metrics.aggregated(ev, ["episode"], "value", how).select("episode", F.lit(how).alias("how"), r6("value", "value"))
        out = part if out is None else out.union(part)
    return out


@query("a24_mixture_counts", f"WITH {EV} SELECT task AS tag, CAST(sum(length) AS BIGINT) AS transitions, count(DISTINCT episode) AS trajectories FROM epi GROUP BY 1")
def _(spark, sf):
    return episodes(frames(spark, sf)).groupBy(F.col("task").alias("tag")).agg(F.sum("length").alias("transitions"), F.count_distinct("episode").alias("trajectories"))


@query("a25_epoch_loss", f"WITH {EV} SELECT CAST(floor(event_id / 500) AS BIGINT) AS epoch, round(avg(value), 6) AS loss FROM ev GROUP BY 1")
def _(spark, sf):
    return frames(spark, sf).groupBy(F.floor(F.col("event_id") / 500).cast("long").alias("epoch")).agg(r6(F.avg("value"), "loss"))


@query("p24_linear_interpolation", f"WITH {EV}, f AS (SELECT episode, CAST(us AS DOUBLE) AS t, value AS v, lead(CAST(us AS DOUBLE)) OVER w AS t2, lead(value) OVER w AS v2 FROM ev WINDOW w AS (PARTITION BY episode ORDER BY us, event_id)) SELECT episode, (t + t2) / 2 AS t, round((v + v2) / 2, 6) AS v FROM f WHERE t2 > t")
def _(spark, sf):
    ev = frames(spark, sf).select("episode", F.col("us").cast("double").alias("t"), F.col("value").alias("v"))
    nxt = F.lead("t").over(Window.partitionBy("episode").orderBy("t"))
    probes = ev.withColumn("n", nxt).where("n > t").select("episode", ((F.col("t") + F.col("n")) / 2).alias("t"))
    return pose.linear(probes, ev, ["episode"], "t", "v").select("episode", "t", r6("v", "v"))


# sorts, unions, reshaping --------------------------------------------------------------------------------------------
@query("l1_sort", f"WITH {EV} SELECT episode, step, event_id FROM ev ORDER BY episode, step")
def _(spark, sf):
    return frames(spark, sf).select("episode", "step", "event_id").orderBy("episode", "step")


@query("l2_rank_logs", "WITH r AS (SELECT s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS success FROM supplier) SELECT name, success FROM r ORDER BY success DESC NULLS LAST, name")
def _(spark, sf):
    r = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("success"))
    return r.orderBy(F.desc_nulls_last("success"), "name")


@query("l3_stats_table", f"WITH {EV} SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM ev GROUP BY 1 ORDER BY mean DESC, event_type")
def _(spark, sf):
    return frames(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean")).orderBy(F.desc("mean"), "event_type")


KEY = "('0x' || substring(md5('{}|' || {}), 1, 15))::BIGINT"  # the order of sampling.order_key


@query("l5_split_sizes", "WITH n AS (SELECT count(*) AS n FROM events), c AS (SELECT n, CAST(floor(n * 0.8) AS BIGINT) AS a FROM n) SELECT 'train' AS split, a AS rows FROM c UNION ALL SELECT 'val', (n - a) // 2 FROM c UNION ALL SELECT 'test', n - a - (n - a) // 2 FROM c")
def _(spark, sf):
    return sampling.split(frames(spark, sf), ["episode", "step"], 7, 0.8).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("l5_split_rows", f"WITH {EV}, p AS (SELECT episode, step, row_number() OVER (ORDER BY {KEY.format(7, "episode || '|' || step")}, episode, step) - 1 AS p, count(*) OVER () AS n FROM ev) SELECT episode, step, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.8) + (n - floor(n * 0.8)) // 2 THEN 'val' ELSE 'test' END AS split FROM p")
def _(spark, sf):
    return sampling.split(frames(spark, sf), ["episode", "step"], 7, 0.8).select("episode", "step", "split")


@query("l4_shuffle_coverage", "SELECT count(*) AS rows, count(*) AS places, CAST(0 AS BIGINT) AS first_place, count(*) - 1 AS last_place FROM events")
def _(spark, sf):
    s = sampling.shuffled(frames(spark, sf), ["episode", "step"], 3)
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("place").alias("places"), F.min("place").cast("long").alias("first_place"), F.max("place").cast("long").alias("last_place"))


@query("l4_shuffled_rows", f"WITH {EV} SELECT episode, step, row_number() OVER (ORDER BY {KEY.format(3, "episode || '|' || step")}, episode, step) - 1 AS place FROM ev")
def _(spark, sf):
    return sampling.shuffled(frames(spark, sf), ["episode", "step"], 3).select("episode", "step", F.col("place").cast("long").alias("place"))


@query("l6_uniform_sample", f"WITH {EV} SELECT episode, length FROM epi ORDER BY {KEY.format(5, 'episode')}, episode LIMIT 50")
def _(spark, sf):
    return sampling.sample(episodes(frames(spark, sf)), ["episode"], 5, 50).select("episode", "length")


@query("l7_weighted_sample", f"SELECT s_suppkey FROM supplier ORDER BY -ln(({KEY.format(11, 's_suppkey')} % 1099511627776 + 1) / CAST(1099511627777 AS DOUBLE)) / greatest(abs(s_acctbal), 1e-8), s_suppkey LIMIT 30")
def _(spark, sf):
    return sampling.weighted_sample(table(spark, sf, "supplier"), ["s_suppkey"], F.abs("s_acctbal"), 11, 30).select("s_suppkey")


@query("l8_share_sample", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY {KEY.format(13, "conv_id || '|' || turn")}, conv_id, turn) AS r, count(*) OVER () AS n FROM conversations) WHERE r <= floor(n * 0.3)")
def _(spark, sf):
    return sampling.sample_share(table(spark, sf, "conversations"), ["conv_id", "turn"], 13, 0.3).select("conv_id", "turn")


MIX = f"WITH {EV}, d AS (SELECT task AS name, CAST(sum(length) AS DOUBLE) AS length, CASE WHEN task IN ('click', 'view') THEN 1.0 ELSE 0.5 END AS weight FROM epi GROUP BY task), w AS (SELECT *, greatest(weight * length, 1e-8) AS raw FROM d), s AS (SELECT name, weight, length, raw / sum(raw) OVER () AS share FROM w)"


def _mixture(spark, sf):
    d = episodes(frames(spark, sf)).groupBy(F.col("task").alias("name")).agg(F.sum("length").cast("double").alias("length"))
    return d.withColumn("weight", F.when(F.col("name").isin("click", "view"), 1.0).otherwise(0.5))


@query("l10_mixture_weights", f"{MIX} SELECT name, round(share, 6) AS share FROM s")
def _(spark, sf):
    return sampling.mixture_weights(_mixture(spark, sf)).select("name", r6("share", "share"))


@query("l10_epoch_length", f"{MIX} SELECT CAST(floor(max(length / share) + 1e-6) AS BIGINT) AS epoch_length FROM s WHERE weight = (SELECT CASE WHEN max(CASE WHEN weight = 1 THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE max(weight) END FROM d)")
def _(spark, sf):
    m = sampling.mixture_weights(_mixture(spark, sf))
    top = m.agg(F.when(F.max((F.col("weight") == 1).cast("int")) == 1, F.lit(1.0)).otherwise(F.max("weight")).alias("top"))
    return m.join(F.broadcast(top), F.col("weight") == F.col("top")).agg(F.floor(F.max(F.col("length") / F.col("share")) + 1e-6).cast("long").alias("epoch_length"))


@query("l11_even_frames", "WITH k AS (SELECT p_partkey, p_size AS n, CAST(greatest(4, least(8, round_even(p_size / 6.0, 0))) AS BIGINT) AS k FROM part), x AS (SELECT DISTINCT p_partkey, CAST(floor(i * (n - 1) / CAST(k - 1 AS DOUBLE)) AS BIGINT) AS frame FROM (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM k)) SELECT p_partkey, frame FROM x")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.explode(sampling.even_frames(F.col("p_size"), 4, 8, F.col("p_size"), 6.0)).alias("frame"))


@query("l14_latest_checkpoint", "SELECT max(CAST(regexp_extract(p, 'steps_(\\d+)', 1) AS BIGINT)) AS step FROM (SELECT 'ckpt/steps_' || o_orderkey || '.pt' AS p FROM orders)")
def _(spark, sf):
    from ..functions import text as tx

    p = table(spark, sf, "orders").select(F.concat(F.lit("ckpt/steps_"), F.col("o_orderkey").cast("string"), F.lit(".pt")).alias("p"))
    return p.agg(F.max(tx.step_number(F.col("p"))).alias("step"))


@query("u1_union", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("u2_last_write_wins", f"WITH {EV}, w AS (SELECT coalesce(nullif(event_type, 'view'), '__legacy_single_dataset__') AS dataset_key, step % 50 AS step, event_id, value, row_number() OVER (PARTITION BY coalesce(nullif(event_type, 'view'), '__legacy_single_dataset__'), step % 50 ORDER BY event_id DESC) AS r FROM ev) SELECT dataset_key, step, value FROM w WHERE r = 1")
def _(spark, sf):
    ev = frames(spark, sf).select(F.nullif("event_type", F.lit("view")).alias("dataset_key"), (F.col("step") % 50).alias("step"), "event_id", "value")
    return returns.last_write(ev, ["dataset_key", "step"], ["event_id"], {"dataset_key": "__legacy_single_dataset__"}).select("dataset_key", "step", "value")


@query("u3_first_wins", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def _(spark, sf):
    return returns.first_wins(table(spark, sf, "part"), ["p_brand", "p_type"], "p_partkey").select("p_brand", "p_type", "p_partkey")


@query("u4_key_sets", f"WITH {EV}, a AS (SELECT DISTINCT event_type AS k FROM ev WHERE step < 2), b AS (SELECT DISTINCT event_type AS k FROM ev WHERE event_id % 3 = 0) SELECT 'both' AS kind, k FROM a INTERSECT SELECT 'both', k FROM b UNION ALL SELECT 'either', k FROM (SELECT k FROM a UNION SELECT k FROM b)".replace("SELECT 'both' AS kind, k FROM a INTERSECT SELECT 'both', k FROM b", "SELECT 'both' AS kind, k FROM a WHERE k IN (SELECT k FROM b)"))
def _(spark, sf):
    ev = frames(spark, sf)
    sets = ev.agg(F.collect_set(F.when(F.col("step") < 2, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("b"))
    both = sets.select(F.lit("both").alias("kind"), F.explode(F.array_intersect("a", "b")).alias("k"))
    return both.union(sets.select(F.lit("either"), F.explode(F.array_union("a", "b"))))


@query("u7_zip_cycled", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders), n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS q FROM nation) SELECT p AS place, o_orderkey, n_name FROM o JOIN n ON q = p % (SELECT count(*) FROM nation)")
def _(spark, sf):
    z = sampling.zip_cycled(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "nation").select("n_nationkey", "n_name"), ["o_orderkey"], ["n_nationkey"])
    return z.select(F.col("place").cast("long").alias("place"), "o_orderkey", "n_name")


def _rekey_sql(keep: str, order: str) -> str:
    return f'{EV}, keep AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS new_episode FROM epi WHERE {keep}) SELECT new_episode AS episode, step, row_number() OVER (ORDER BY new_episode, step) - 1 AS "index" FROM ev JOIN keep USING (episode)'


def _rekeyed(ev, keep):
    out = writers.rekeyed(ev.select("episode", "step"), keep, "episode", ["episode"], "step")
    return out.select(F.col("episode").cast("long").alias("episode"), "step", F.col("index").cast("long").alias("index"))


@query("k1_rekeyed_episodes", f"WITH {_rekey_sql('true', 'episode')}")
def _(spark, sf):
    ev = frames(spark, sf)
    return _rekeyed(ev, episodes(ev))


@query("r1_split_by_task", f"WITH {EV} SELECT task, episode, row_number() OVER (PARTITION BY task ORDER BY episode) - 1 AS new_episode, CAST(sum(length) OVER (PARTITION BY task ORDER BY episode) - length AS BIGINT) AS first_index FROM epi")
def _(spark, sf):
    e = steps.start_index(episodes(frames(spark, sf)), "length", ["episode"], ["task"])
    w = Window.partitionBy("task").orderBy("episode")
    return e.select("task", "episode", (F.row_number().over(w) - 1).cast("long").alias("new_episode"), F.col("start").alias("first_index"))


@query("r2_split_by_success", f"WITH {_rekey_sql('success', 'episode')}")
def _(spark, sf):
    ev = frames(spark, sf)
    return _rekeyed(ev, episodes(ev).where("success"))


def _target(e, kind: str, ratio: float) -> float:
    return float(e.where(kind).agg(F.sum("length")).first()[0] or 0) * ratio


def _greedy_sql(kind: str, other: str, ratio: str) -> str:
    return f"WITH {EV}, t AS (SELECT {ratio} AS target FROM epi WHERE {other}), c AS (SELECT episode, length, sum(length) OVER (ORDER BY length, episode) AS cum FROM epi WHERE {kind}), pick AS (SELECT episode, length FROM c, t WHERE target > 0 AND (cum < target OR cum - length = 0 OR (cum - length < target AND abs(cum - length - target) >= abs(cum - target))))"


@query("r3_balance_failures", _greedy_sql("NOT success", "success", "coalesce(sum(length), 0)") + " SELECT episode, length, false AS success FROM pick UNION ALL SELECT episode, length, true FROM epi WHERE success")
def _(spark, sf):
    e = episodes(frames(spark, sf))
    fail = sampling.greedy(e.where("not success"), "length", ["length", "episode"], _target(e, "success", 1.0))
    return fail.union(e.where("success")).select("episode", "length", "success")


@query("r5_success_and_quarter", _greedy_sql("NOT success", "success", "round(coalesce(sum(length), 0) * 0.25)") + " SELECT episode, length, false AS success FROM pick UNION ALL SELECT episode, length, true FROM epi WHERE success")
def _(spark, sf):
    e = episodes(frames(spark, sf))
    fail = sampling.greedy(e.where("not success"), "length", ["length", "episode"], float(round(_target(e, "success", 0.25))))
    return fail.union(e.where("success")).select("episode", "length", "success")


def _cycled_sql(rows: str, target: str, seed: int) -> str:
    return f"""t AS (SELECT {target} AS target, (SELECT sum(length) FROM {rows}) AS total), y AS (SELECT episode, length, unnest(range(CAST(floor(target / total) AS BIGINT) + 1)) AS cycle, target FROM {rows}, t),
c AS (SELECT *, sum(length) OVER (ORDER BY cycle, {KEY.format(seed, "cycle || '|' || episode")}, episode ROWS UNBOUNDED PRECEDING) AS cum FROM y),
k AS (SELECT episode, length, cycle FROM c WHERE cum < target OR cum = length OR (cum - length < target AND abs(cum - length - target) >= abs(cum - target)))"""


@query("r4_cycled_success", f"WITH {EV}, ok AS (SELECT * FROM epi WHERE success), {_cycled_sql('ok', '(SELECT round(CAST(sum(length) AS DOUBLE) * 4) FROM epi WHERE NOT success)', 17)} SELECT episode, length, success, CAST(0 AS BIGINT) AS cycle FROM epi WHERE NOT success UNION ALL SELECT episode, length, true, cycle FROM k")
def _(spark, sf):
    """All failures, and successes over and over until they have four times the failures' frames."""
    e = episodes(frames(spark, sf))
    fail = e.where("not success")
    more = sampling.cycled(e.where("success"), ["episode"], "length", 17, float(round(_target(e, "not success", 4.0))))
    return fail.withColumn("cycle", F.lit(0).cast("long")).unionByName(more).select("episode", "length", "success", "cycle")


@query("w14_cycled_selection", f"WITH {EV}, {_cycled_sql('epi', '(SELECT CAST(sum(length) AS DOUBLE) * 2.5 FROM epi)', 19)} SELECT episode, length, cycle FROM k")
def _(spark, sf):
    e = episodes(frames(spark, sf))
    return sampling.cycled(e, ["episode"], "length", 19, _target(e, "true", 2.5)).select("episode", "length", "cycle")


@query("r6_rollouts", f"WITH {EV}, m AS (SELECT task, count(*) AS episodes, CAST(sum(length) AS BIGINT) AS frames FROM epi GROUP BY 1), s AS (SELECT task, count(value) AS n, sum(value) AS s, sum(value * value) AS ss, min(value) AS mn, max(value) AS mx FROM lab GROUP BY 1) SELECT task, episodes, frames, round(s / n, 6) AS mean, round(sqrt(greatest(0.0, ss / n - (s / n) * (s / n))), 6) AS std, mn AS q01, mx AS q99 FROM m JOIN s USING (task)")
def _(spark, sf):
    from ..operators import vectors as vec

    lab = labelled(spark, sf)
    counters = episodes(frames(spark, sf)).groupBy("task").agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("frames"))
    stats = vec.merge_partials(vec.partials(lab.withColumn("x", F.col("value")), ["task", "episode"]), ["task"])
    return counters.join(stats, "task").select("task", "episodes", "frames", r6("mean", "mean"), r6("std", "std"), "q01", "q99")


@query("k6_manifest", f"WITH {EV} SELECT task, {MANIFEST} FROM epi GROUP BY task")
def _(spark, sf):
    e = episodes(frames(spark, sf))
    ok = F.col("success")
    return e.groupBy("task").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum(ok.cast("long")).alias("success_episodes"), F.sum((~ok).cast("long")).alias("failure_episodes"),
        F.sum(F.when(ok, F.col("length")).otherwise(0)).alias("success_frames"), F.sum(F.when(~ok, F.col("length")).otherwise(0)).alias("failure_frames"),
    )


@query("k8_info", f"WITH {EV} SELECT count(*) AS total_episodes, CAST(sum(length) AS BIGINT) AS total_frames, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_chunks, '0:' || count(*) AS train FROM epi")
def _(spark, sf):
    return writers.info(episodes(frames(spark, sf)), "length", 10)


@query("flagship_task_returns", f"WITH {VAL} SELECT task, success, count(*) AS n, min(return_to_go) AS least, max(return_to_go) AS most, round(avg(return_to_go), 6) AS mean, round(quantile_cont(return_to_go, 0.5), 6) AS median FROM val GROUP BY task, success")
def flagship(spark, sf):
    """Returns to go by task and success: the whole way from events through steps, success, returns to quantiles."""
    df = returns.return_to_go(labelled(spark, sf), "episode", "success", PENALTY)
    d = metrics.distribution(df, "return_to_go", ["task", "success"], {"median": 0.5})
    return d.select("task", "success", "n", F.col("min").alias("least"), F.col("max").alias("most"), r6("mean", "mean"), r6("median", "median"))
