"""Rules of the workflow and of roles over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rates, text
from ..operators import timeline, workflow
from ..sources import adapters as A
from .registry import query
from .timeline import CAP, GAP, _MERGE
from .workflow import _RESUME

_WITH = _RESUME.format(a=0, b=6).replace("SELECT episode_id, type, status, leads_to,", ", r AS (SELECT episode_id, leads_to,", 1) + ")"
_NEW = _WITH + """, x AS (SELECT e.id AS episode_id, e.status, coalesce(r.leads_to, 'extract') AS leads_to, coalesce(r.creates, true) AS creates FROM episodes e LEFT JOIN r ON r.episode_id = e.id)"""


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return A.tasks(spark, sf).select("id", "episode_id", "type", "status")


@query(_NEW + """ SELECT id, episode_id, type, status, NULL::BOOLEAN AS force FROM tasks UNION ALL SELECT NULL, episode_id, leads_to, 'pending', CASE WHEN leads_to NOT IN ('source_review', 'translation_review') THEN false END FROM x WHERE creates""")
def win_11_submitted_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.submit(A.episodes(spark, sf), _tasks(spark, sf))[0]


@query(_NEW + " SELECT episode_id AS id, CASE WHEN leads_to IN ('wait', 'done') THEN status WHEN leads_to IN ('source_review', 'translation_review') THEN 'review' ELSE 'running' END AS status FROM x")
def win_11_submitted_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.submit(A.episodes(spark, sf), _tasks(spark, sf))[1].select("id", "status")


@query("""+l AS (SELECT t.episode_id, arg_max(t.status, t.id) AS s FROM tasks t JOIN episodes e ON e.id = t.episode_id GROUP BY t.episode_id)
SELECT t.id, t.episode_id, t.type, t.status, NULL::BOOLEAN AS force FROM tasks t LEFT JOIN l USING (episode_id) WHERE NOT coalesce(l.s IN ('pending', 'running') AND t.status = 'pending', false) UNION ALL SELECT NULL, id, 'translate', 'pending', true FROM episodes""")
def win_11_forced_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.submit(A.episodes(spark, sf), _tasks(spark, sf), first="translate")[0]


@query("""+c AS (SELECT id, status, CASE id % 5 WHEN 0 THEN 'claim' WHEN 1 THEN 'complete' WHEN 2 THEN 'fail' WHEN 3 THEN 'pass' END AS a, id % 7 = 0 AND id % 5 = 0 AS again FROM tasks)
SELECT id, CASE WHEN a = 'claim' AND again AND status = 'pending' THEN 'failed' WHEN a = 'claim' AND again THEN 'failed' WHEN a = 'claim' AND status = 'pending' THEN 'running' WHEN a = 'complete' THEN 'succeeded' WHEN a = 'fail' THEN 'failed' WHEN a = 'pass' AND status = 'pending' THEN 'succeeded' ELSE status END AS status,
  CASE WHEN a = 'claim' AND status = 'pending' THEN 1 END::BIGINT AS claimed_at, CASE WHEN again THEN 2 WHEN a IN ('complete', 'fail') OR (a = 'pass' AND status = 'pending') THEN 1 END::BIGINT AS finished_at, CASE WHEN again THEN 'lost' WHEN a = 'fail' THEN 'no sound' END AS error FROM c""")
def dml_10_transitions(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None)
    t = _tasks(spark, sf).select("id", "status", none.cast("long").alias("claimed_at"), none.cast("long").alias("finished_at"), none.cast("string").alias("error"))
    change = F.expr("CASE id % 5 WHEN 0 THEN 'claim' WHEN 1 THEN 'complete' WHEN 2 THEN 'fail' WHEN 3 THEN 'pass' END")
    one = t.select("id", change.alias("change"), F.lit(1).cast("long").alias("at"), F.when(F.col("id") % 5 == 2, "no sound").alias("error")).where("change IS NOT NULL")
    two = t.where("id % 7 = 0 AND id % 5 = 0").select("id", F.lit("fail").alias("change"), F.lit(2).cast("long").alias("at"), F.lit("lost").alias("error"))
    return workflow.transition(t, one.unionByName(two))


@query(_MERGE + """, g AS (SELECT episode_id, head_id, list(id ORDER BY id) AS ids FROM fold GROUP BY ALL), e AS (SELECT episode_id, uid, list(id ORDER BY id) AS ids FROM (SELECT episode_id, id // 7 AS uid, id FROM cues) GROUP BY ALL),
m AS (SELECT g.episode_id, g.head_id, e.uid FROM g LEFT JOIN e ON g.episode_id = e.episode_id AND g.ids = e.ids), n AS (SELECT episode_id, max(id // 7) AS last FROM cues GROUP BY episode_id),
u AS (SELECT m.episode_id, m.head_id, coalesce(m.uid, n.last + row_number() OVER (PARTITION BY m.episode_id, m.uid IS NULL ORDER BY m.head_id)) AS uid FROM m JOIN n USING (episode_id))
SELECT u.episode_id, u.uid::BIGINT AS uid, f.id AS cue_id FROM u JOIN fold f ON f.episode_id = u.episode_id AND f.head_id = u.head_id""")
def jn_13_links(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf)
    links = c.select("episode_id", F.floor(F.col("id") / 7).alias("uid"), F.col("id").alias("cue_id"))
    members = timeline.merge_cues(c, GAP, CAP)
    snapshot = timeline.reconcile(members, c, A.utterances(spark, sf).select("episode_id", "uid", "source_hash"), links)
    return timeline.relinked(members, snapshot, links.groupBy("episode_id").agg(F.max("uid").alias("last")))[1]


@query("SELECT c.id, c.episode_id, e.number AS episode_number, c.start_ms, e.drama_id, c.role_id FROM cues c JOIN episodes e ON e.id = c.episode_id WHERE c.role_id IS NOT NULL")
def jn_5_role_cues(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.role_cues(A.cues(spark, sf), A.episodes(spark, sf)).select("id", "episode_id", "episode_number", "start_ms", "drama_id", "role_id")


@query("""SELECT drama_id, role_id, first(c.id ORDER BY abs(c.end_ms - c.start_ms - 5000000), c.episode_id, c.start_ms, c.id) AS id FROM cues c JOIN episodes e ON e.id = c.episode_id
WHERE c.kind = 'speech' AND c.role_id IS NOT NULL AND c.episode_id IN (SELECT episode_id FROM artifacts WHERE kind = 'asr_model') GROUP BY drama_id, role_id""")
def srt_6_samples_with_media(spark: SparkSession, sf: str) -> DataFrame:
    tracks = A.artifacts(spark, sf).where("kind = 'asr_model'")
    return timeline.best_samples(A.cues(spark, sf).where("kind = 'speech'"), A.episodes(spark, sf), tracks, 5_000_000)


@query("""SELECT id, text <> '' AND (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 3 OR regexp_matches(lower(text), 'ha|ah|oh|hey|bro|wow|yeah|ok')) AS fast FROM lines""")
def mth_9_fast_speech(spark: SparkSession, sf: str) -> DataFrame:
    return A.lines(spark, sf).select("id", rates.aggressive_allowed(F.col("text")).alias("fast"))


@query("""SELECT user_id, count(*) FILTER (status = 'succeeded' OR dubbed) AS done, count(*) FILTER (status NOT IN ('ready', 'succeeded')) AS in_progress, count(*) AS total
FROM (SELECT e.*, e.id IN (SELECT episode_id FROM artifacts WHERE kind = 'dubbed_video') AS dubbed FROM episodes e) e JOIN dramas d ON d.id = e.drama_id GROUP BY user_id""")
def agg_11_dashboard_with_dubbed(spark: SparkSession, sf: str) -> DataFrame:
    dubbed = A.artifacts(spark, sf).where("kind = 'dubbed_video'").select(F.col("episode_id").alias("_e")).distinct()
    e = A.episodes(spark, sf).join(A.dramas(spark, sf).select(F.col("id").alias("drama_id"), "user_id"), "drama_id").join(dubbed, F.col("id") == F.col("_e"), "left")
    s = F.col("status")
    return e.groupBy("user_id").agg(F.count_if((s == "succeeded") | F.col("_e").isNotNull()).alias("done"), F.count_if(~s.isin("ready", "succeeded")).alias("in_progress"), F.count(F.lit(1)).alias("total"))


@query("""SELECT id, 'To ' || name || ': {kind} of ' || coalesce(voice_type, '') || ' ({other}) as ' || CASE role_type WHEN 'lead' THEN 'first' WHEN 'extra' THEN 'last' ELSE 'some' END AS prompt FROM (SELECT id, name || ' {voice}' AS name, voice_type, role_type FROM roles)""")
def str_13_23_filled_template(spark: SparkSession, sf: str) -> DataFrame:
    r = A.roles(spark, sf)
    values = {"name": F.concat("name", F.lit(" {voice}")), "voice": F.col("voice_type"), "label": text.label(F.col("role_type"), {"lead": "first", "extra": "last"}, "some")}
    return r.select("id", text.filled(F.lit("To {name}: {kind} of {voice} ({other}) as {label}"), values).alias("prompt"))
