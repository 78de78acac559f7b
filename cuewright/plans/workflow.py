"""Task states, resets, and stored snapshots after a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots, workflow
from ..sources import adapters as A
from .registry import query

_LATEST = "+l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY id DESC) AS r FROM tasks) WHERE r = 1)"
_PHASES = """+s(o, type) AS (VALUES (0, 'extract'), (1, 'asr'), (2, 'parse'), (3, 'translate'), (4, 'tts'), (5, 'mix'), (6, 'burn')),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, type ORDER BY id DESC) AS r FROM tasks) WHERE r = 1),
leg AS (SELECT id FROM episodes WHERE status = 'succeeded' AND id NOT IN (SELECT episode_id FROM lt JOIN s USING (type))),
st AS (SELECT e.id AS episode_id, s.o AS ordinal, s.type, coalesce(lt.status, CASE WHEN leg.id IS NULL THEN 'pending' ELSE 'succeeded' END) AS status
  FROM episodes e CROSS JOIN s LEFT JOIN lt ON lt.episode_id = e.id AND lt.type = s.type LEFT JOIN leg ON leg.id = e.id)"""


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return A.tasks(spark, sf)


@query(_LATEST + " SELECT e.id, CASE l.status WHEN 'running' THEN 'running' WHEN 'pending' THEN 'review' WHEN 'failed' THEN 'failed' ELSE 'ready' END AS derived FROM episodes e LEFT JOIN l ON l.episode_id = e.id")
def stm_4_episode_status(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.episode_status(A.episodes(spark, sf), _tasks(spark, sf))


@query(_PHASES + " SELECT * FROM st")
def stm_5_steps(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.phases(A.episodes(spark, sf), _tasks(spark, sf))


@query(_PHASES + """ SELECT e.id AS episode_id, CASE WHEN leg.id IS NOT NULL OR s.status = 'succeeded' THEN 'passed' WHEN p.status = 'succeeded' THEN 'awaiting' ELSE 'pending' END AS source_review,
  CASE WHEN leg.id IS NOT NULL OR r.status = 'succeeded' THEN 'passed' WHEN t.status = 'succeeded' THEN 'awaiting' ELSE 'pending' END AS translation_review FROM episodes e LEFT JOIN leg ON leg.id = e.id
  LEFT JOIN lt s ON s.episode_id = e.id AND s.type = 'source_review' LEFT JOIN lt p ON p.episode_id = e.id AND p.type = 'parse' LEFT JOIN lt r ON r.episode_id = e.id AND r.type = 'translation_review' LEFT JOIN lt t ON t.episode_id = e.id AND t.type = 'translate'""")
def stm_6_gates(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.gate_status(A.episodes(spark, sf), _tasks(spark, sf))


@query(_PHASES + """ SELECT episode_id, CASE type WHEN 'extract' THEN 'extract' WHEN 'asr' THEN 'recognize' WHEN 'parse' THEN 'recognize' WHEN 'translate' THEN 'translate' WHEN 'burn' THEN 'compose' ELSE 'dub' END AS stage,
  CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status IN ('succeeded', 'skipped')) THEN 'succeeded' ELSE 'pending' END AS status FROM st GROUP BY ALL""")
def agg_15_stages(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.stage_status(workflow.phases(A.episodes(spark, sf), _tasks(spark, sf)))


_RESUME = _PHASES + """, act AS (SELECT * FROM s WHERE o BETWEEN {a} AND {b}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY id DESC) AS r FROM tasks) WHERE r = 1),
d AS (SELECT episode_id, arg_max(o, t.id) AS o, arg_max(t.type, t.id) AS type FROM tasks t JOIN act USING (type) WHERE status = 'succeeded' GROUP BY episode_id),
g AS (SELECT d.episode_id, gt.gate, lt.status FROM d JOIN (VALUES ('parse', 'source_review'), ('translate', 'translation_review')) gt(type, gate) USING (type) LEFT JOIN lt ON lt.episode_id = d.episode_id AND lt.type = gt.gate),
n AS (SELECT l.episode_id, l.type, l.status, CASE WHEN l.status IN ('pending', 'running') THEN 'wait' WHEN l.status = 'failed' AND l.type IN (SELECT type FROM act) THEN l.type
  WHEN g.gate IS NOT NULL AND g.status IS DISTINCT FROM 'succeeded' THEN g.gate WHEN d.o = {b} THEN 'done' WHEN d.o IS NOT NULL THEN (SELECT any_value(type) FROM act WHERE act.o = d.o + 1) ELSE (SELECT any_value(type) FROM act WHERE act.o = {a}) END AS leads_to, g.gate, g.status AS gs
  FROM l LEFT JOIN d USING (episode_id) LEFT JOIN g USING (episode_id))
SELECT episode_id, type, status, leads_to, leads_to NOT IN ('wait', 'done') AND NOT (leads_to IN ('source_review', 'translation_review') AND gate = leads_to AND coalesce(gs = 'pending', false)) IS TRUE AS creates FROM n"""


@query(_RESUME.format(a=0, b=6))
def stm_2_win_11_next_step(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.resume(_tasks(spark, sf))


@query(_RESUME.format(a=0, b=3))
def win_11_resume_to_translate(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.resume(_tasks(spark, sf), last="translate")


@query("""+s(o, type) AS (VALUES (0, 'extract'), (1, 'asr'), (2, 'parse'), (3, 'source_review'), (4, 'translate'), (5, 'translation_review'), (6, 'tts'), (7, 'mix'), (8, 'burn')),
b AS (SELECT episode_id FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY id DESC) AS r FROM tasks WHERE type = 'translate') WHERE r = 1 AND status = 'succeeded')
SELECT t.id, t.episode_id, t.type, t.status FROM tasks t JOIN s USING (type) WHERE t.episode_id NOT IN (SELECT episode_id FROM b) OR s.o < 4 UNION ALL SELECT NULL, episode_id, 'translate', 'pending' FROM b""")
def inc_7_reset(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.reset_to(_tasks(spark, sf), "translate")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'forced' WHEN event_id % 7 = 0 THEN 'not recorded' WHEN event_id % 5 = 0 THEN 'version changed' WHEN event_id % 3 = 0 THEN 'missing input' WHEN event_id % 2 = 0 THEN 'missing output' WHEN event_type <> 'view' THEN 'status' ELSE 'skip' END AS reason FROM events")
def inc_8_should_run(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    status = F.when(F.col("event_type") == "view", "succeeded").otherwise("failed")
    return A.table(spark, sf, "events").select("event_id", workflow.should_run(n % 11 == 0, n % 7 != 0, n % 5 != 0, n % 3 != 0, n % 2 != 0, status).alias("reason"))


@query("SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'worker lost' END AS error FROM tasks")
def stm_8_dml_10_orphans(spark: SparkSession, sf: str) -> DataFrame:
    lost = F.col("status") == "running"
    return _tasks(spark, sf).select("id", F.when(lost, "failed").otherwise(F.col("status")).alias("status"), F.when(lost, "worker lost").alias("error"))


@query("+k AS (SELECT * FROM tasks WHERE status <> 'pending'), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY id DESC) AS r FROM k) WHERE r = 1) SELECT e.id, CASE l.status WHEN 'running' THEN 'running' WHEN 'failed' THEN 'failed' ELSE 'ready' END AS derived FROM episodes e LEFT JOIN l ON l.episode_id = e.id")
def stm_9_cancel(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.episode_status(A.episodes(spark, sf), _tasks(spark, sf).where("status <> 'pending'"))


@query(_LATEST + """, g AS (SELECT episode_id, max(id) FILTER (status = 'pending') AS gate, arg_max(status, id) AS was FROM tasks WHERE type = 'source_review' GROUP BY ALL),
f AS (SELECT episode_id, gate, was FROM l LEFT JOIN g USING (episode_id) WHERE NOT (l.type <> 'source_review' AND l.status IN ('pending', 'running')))
SELECT t.id, t.episode_id, t.type, CASE WHEN t.id = f.gate THEN 'succeeded' ELSE t.status END AS status FROM tasks t LEFT JOIN f ON f.episode_id = t.episode_id
UNION ALL SELECT NULL, episode_id, 'source_review', 'succeeded' FROM f WHERE gate IS NULL AND was IS DISTINCT FROM 'succeeded'""")
def stm_7_pass_gate(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.pass_gate(_tasks(spark, sf), "source_review")


@query("SELECT id, type FROM tasks WHERE type IN ('parse', 'translate', 'tts')")
def stm_10_active_range(spark: SparkSession, sf: str) -> DataFrame:
    return _tasks(spark, sf).where(F.col("type").isin(*workflow.active_range("parse", "tts"))).select("id", "type")


@query("+g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g) SELECT user_id, max(ts) AS last_edit, count(*) AS n_edits FROM s GROUP BY user_id, burst")
def stm_11_debounce(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").select("user_id", "ts", "event_id")
    return e.groupBy("user_id", F.session_window("ts", "12 hours 1 microsecond")).agg(F.max("ts").alias("last_edit"), F.count(F.lit(1)).alias("n_edits")).drop("session_window")


_OLD = "o AS (SELECT id, name, user_id AS a, segment AS b FROM dramas WHERE id % 5 <> 0), n AS (SELECT id, 'new' AS name, CASE WHEN id % 2 = 0 THEN user_id + 1 END AS a, CASE WHEN id % 3 = 0 THEN '' ELSE 'B' END AS b FROM dramas WHERE id % 4 = 0)"


@query("+" + _OLD + " SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.a, o.a) AS a, CASE WHEN o.id IS NULL THEN n.b WHEN coalesce(n.b, '') <> '' THEN n.b ELSE o.b END AS b FROM o FULL JOIN n ON o.id = n.id")
def dml_1_to_7_upsert(spark: SparkSession, sf: str) -> DataFrame:
    d = A.dramas(spark, sf)
    old = d.where("id % 5 <> 0").selectExpr("id", "name", "user_id AS a", "segment AS b")
    new = d.where("id % 4 = 0").selectExpr("id", "'new' AS name", "CASE WHEN id % 2 = 0 THEN user_id + 1 END AS a", "CASE WHEN id % 3 = 0 THEN '' ELSE 'B' END AS b")
    return snapshots.upsert(old, new, ["id"], {"name": "new", "a": "fill", "b": "text"})


@query("+" + _OLD + " SELECT id, name FROM o UNION ALL SELECT id, name FROM n WHERE id NOT IN (SELECT id FROM o)")
def dml_4_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    d = A.dramas(spark, sf)
    old = d.where("id % 5 <> 0").select("id", "name")
    new = d.where("id % 4 = 0").select("id", F.lit("new").alias("name"))
    return old.unionByName(new.join(old.select("id"), "id", "left_anti"))


@query("SELECT id, CASE WHEN drama_id = 3 THEN 'replaced' ELSE name END AS name FROM roles WHERE drama_id <> 3 OR id % 40 = 3")
def dml_8_12_full_replace(spark: SparkSession, sf: str) -> DataFrame:
    r = A.roles(spark, sf)
    new = r.where("drama_id = 3 AND id % 40 = 3").select("id", "drama_id", F.lit("replaced").alias("name"))
    return r.select("id", "drama_id", "name").join(new.select("drama_id").distinct(), "drama_id", "left_anti").select("id", "name").unionByName(new.select("id", "name"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS t FROM events")
def dml_9_json_merge(spark: SparkSession, sf: str) -> DataFrame:
    old = F.from_json("props", "map<string,string>")
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(old), lambda e: e["key"] != "t"), F.array(F.struct(F.lit("t").alias("key"), F.col("event_type").alias("value")))))
    return A.table(spark, sf, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["t"].alias("t"))


@query("SELECT id FROM cues WHERE episode_id NOT IN (SELECT id FROM episodes WHERE status = 'succeeded')")
def dml_11_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = A.episodes(spark, sf).where("status = 'succeeded'").select(F.col("id").alias("episode_id"))
    return A.cues(spark, sf).join(gone, "episode_id", "left_anti").select("id")


@query("SELECT event_id, event_id % 6000 BETWEEN 300 AND 5000 AND event_id % 3 IN (1, 2) AS valid FROM events")
def val_1_rules(spark: SparkSession, sf: str) -> DataFrame:
    window, channels = F.col("event_id") % 6000, F.col("event_id") % 3
    return A.table(spark, sf, "events").select("event_id", (window.between(300, 5000) & channels.isin(1, 2)).alias("valid"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = l_linestatus OR l_returnflag = 'N' AS synced FROM lineitem")
def src_7_checksum_synced(spark: SparkSession, sf: str) -> DataFrame:
    same = F.col("l_returnflag").eqNullSafe(F.col("l_linestatus")) | (F.col("l_returnflag") == "N")
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", same.alias("synced"))
