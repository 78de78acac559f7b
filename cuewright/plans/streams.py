"""Queries by Structured Streaming, run to the end of what is there; the same rules over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reactor
from ..sources import adapters as A
from ..sources.shared import shared_path
from ..streaming import feed
from ..streaming import reactor as streamed
from .registry import query


def _through(spark: SparkSession, rows: DataFrame, query_of, files: int = 3) -> DataFrame:
    """What ``query_of(stream)`` appends to a folder, from files of ``rows`` that come in their order."""
    came, out = shared_path(spark, "came"), shared_path(spark, "out")
    rows.repartitionByRange(files, "seq").write.parquet(came)
    stream = query_of(spark.readStream.schema(rows.schema).parquet(came))
    feed.run(stream, out, shared_path(spark, "progress"))
    return spark.read.schema(stream.schema).parquet(out)


#: Milliseconds: every state is kept.
ALWAYS = 1 << 50


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_seconds(F.col("seq") + 1))


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks as events: ended ones, running ones as an episode that runs, pending ones as one that was stopped."""
    kind = F.expr("CASE status WHEN 'succeeded' THEN 'task_succeeded' WHEN 'failed' THEN 'task_failed' ELSE 'status' END")
    type_ = F.expr("CASE status WHEN 'running' THEN 'running' WHEN 'pending' THEN 'ready' ELSE type END")
    return A.tasks(spark, sf).select("episode_id", F.col("id").alias("seq"), kind.alias("kind"), type_.alias("type"))


#: Status before an event: the last one set. A gate is passed from its success to its failure.
_REACT = """+act(o, type, nxt) AS (VALUES (0, 'extract', 'asr'), (1, 'asr', 'parse'), (2, 'parse', 'translate'), (3, 'translate', 'tts'), (4, 'tts', 'mix'), (5, 'mix', 'burn')),
gates(gate, phase) AS (VALUES ('source_review', 'parse'), ('translation_review', 'translate')),
e AS (SELECT t.id AS seq, t.episode_id, t.type, t.status, g.gate IS NOT NULL AS is_gate, coalesce(p.nxt, n.nxt) AS nxt, h.gate AS asks,
  last_value(CASE WHEN t.type = 'source_review' AND t.status IN ('succeeded', 'failed') THEN t.status END IGNORE NULLS) OVER w AS g1, last_value(CASE WHEN t.type = 'translation_review' AND t.status IN ('succeeded', 'failed') THEN t.status END IGNORE NULLS) OVER w AS g2
  FROM tasks t LEFT JOIN gates g ON g.gate = t.type LEFT JOIN act n ON n.type = t.type LEFT JOIN act p ON p.type = g.phase LEFT JOIN gates h ON h.phase = t.type WINDOW w AS (PARTITION BY t.episode_id ORDER BY t.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE WHEN status = 'running' THEN 'set' WHEN status = 'pending' THEN 'set' WHEN status = 'failed' THEN 'failed' WHEN nxt IS NULL THEN 'done' WHEN is_gate THEN 'pass' WHEN asks IS NOT NULL AND ((asks = 'source_review' AND g1 = 'succeeded') OR (asks = 'translation_review' AND g2 = 'succeeded')) IS NOT TRUE THEN 'ask' ELSE 'next' END AS c FROM e),
s AS (SELECT *, last_value(CASE c WHEN 'set' THEN CASE status WHEN 'running' THEN 'running' ELSE 'ready' END WHEN 'failed' THEN 'failed' WHEN 'done' THEN 'succeeded' WHEN 'pass' THEN 'running' WHEN 'ask' THEN 'review' END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM k),
x AS (SELECT *, coalesce(was IN ('running', 'review'), true) AS open FROM s),
a AS (SELECT episode_id, seq, unnest(CASE c WHEN 'failed' THEN [{'action': 'status', 'value': 'failed'}, {'action': 'emit', 'value': 'pipeline_failed'}] WHEN 'done' THEN [{'action': 'status', 'value': 'succeeded'}, {'action': 'emit', 'value': 'pipeline_done'}]
  WHEN 'ask' THEN [{'action': 'create', 'value': asks}, {'action': 'status', 'value': 'review'}, {'action': 'emit', 'value': 'gate_awaiting'}] WHEN 'next' THEN CASE WHEN open THEN [{'action': 'create', 'value': nxt}] ELSE [] END
  WHEN 'pass' THEN CASE WHEN open THEN [{'action': 'create', 'value': nxt}, {'action': 'status', 'value': 'running'}] ELSE [{'action': 'status', 'value': 'running'}] END ELSE [] END) AS s FROM x)
SELECT episode_id, seq, s.action AS action, s.value AS value, CASE WHEN s.action = 'create' AND s.value NOT IN ('source_review', 'translation_review') THEN false END AS force FROM a"""


@query(_REACT)
def stm_2_reactions(spark: SparkSession, sf: str) -> DataFrame:
    return reactor.reactions(_ends(spark, sf)).drop("step")


@query(_REACT)
def stm_2_reactor_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _through(spark, _timed(_ends(spark, sf)), lambda s: streamed.react(s, keep=ALWAYS)).drop("step")


def _watched(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks as they change; every 13th is followed by its episode's status."""
    t = A.tasks(spark, sf)
    rows = t.select("episode_id", (F.col("id") * 2).alias("seq"), F.col("id").alias("task_id"), "type", "status", F.when(F.col("status") == "failed", F.concat(F.lit("lost "), F.col("id").cast("string"))).alias("error"))
    none = F.lit(None)
    status = F.expr("CASE id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'ready' END")
    return rows.unionByName(t.where("id % 13 = 0").select("episode_id", (F.col("id") * 2 + 1).alias("seq"), none.cast("long").alias("task_id"), none.cast("string").alias("type"), status.alias("status"), none.cast("string").alias("error")))


_TOLD = """+w AS (SELECT episode_id, id, CASE id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'ready' END AS s FROM tasks WHERE id % 13 = 0),
f AS (SELECT episode_id, min(id) AS e FROM w WHERE s <> 'running' GROUP BY episode_id)
SELECT t.episode_id, id * 2 AS seq, type || '_' || status AS event, type, id AS task_id, NULL AS error FROM tasks t LEFT JOIN f USING (episode_id) WHERE status <> 'pending' AND (e IS NULL OR id <= e)
UNION ALL SELECT f.episode_id, e * 2 + 1, CASE s WHEN 'ready' THEN 'pipeline_stopped' ELSE 'pipeline_' || s END, NULL, NULL, CASE WHEN s = 'failed' THEN CASE WHEN t.status = 'failed' THEN 'lost ' || t.id ELSE 'Pipeline failed (unknown error)' END END FROM f JOIN w ON w.episode_id = f.episode_id AND w.id = e JOIN tasks t ON t.id = e"""


@query(_TOLD)
def stm_3_feed(spark: SparkSession, sf: str) -> DataFrame:
    return reactor.told(_watched(spark, sf)).drop("step")


@query(_TOLD)
def stm_3_feed_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _through(spark, _timed(_watched(spark, sf)), lambda s: streamed.watch(s, keep=ALWAYS)).drop("step")


@query("""+g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS brk, event_id FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id AS episode_id, max(ts) AS last_edit, count(*) AS n_edits FROM s GROUP BY user_id, burst HAVING max(ts) + INTERVAL 12 HOUR + INTERVAL 1 MICROSECOND <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def stm_11_settled_stream(spark: SparkSession, sf: str) -> DataFrame:
    edits = A.table(spark, sf, "events").select(F.col("user_id").alias("episode_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    settled = _through(spark, edits, lambda s: feed.settled(s, "12 hours 1 microsecond", "1 hour"))
    return settled.select("episode_id", F.col("last_edit").cast("timestamp_ntz").alias("last_edit"), "n_edits")
