"""The driver's tables as domain views, and the same views as SQL for the oracles.

dramas are customers, episodes orders, cues
and tasks are events, lines are conversation turns on a time axis of 60 ms a character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Steps of the workflow in order, gates between phases; fixed values.
STEPS = ("extract", "asr", "parse", "source_review", "translate", "translation_review", "tts", "mix", "burn")
GATES = ("source_review", "translation_review")
#: Phases in order, and the gate after some; fixed values.
PHASES = ("extract", "asr", "parse", "translate", "tts", "mix", "burn")
GATE_AFTER = {"parse": "source_review", "translate": "translation_review"}
STATUSES = ("succeeded", "failed", "running", "pending")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dramas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS user_id", "c_mktsegment AS segment")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'P' THEN 'running' ELSE 'succeeded' END")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("drama_id"), number.alias("number"), status.alias("status"), F.col("o_orderdate").cast("date").alias("updated_at"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "user_id AS episode_id",
        f"{start} AS start_ms",
        f"{start} + floor(value * 60000) AS end_ms",
        "event_type AS speaker",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 END AS role_id",
        "CASE WHEN event_id % 2 = 0 THEN 'neutral' ELSE 'happy' END AS emotion",
        "CASE WHEN event_type = 'error' THEN 'sing' ELSE 'speech' END AS kind",
        "props AS text",
        "CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(event_type, ' ', event_id) END AS text_en",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(F.coalesce("text", F.lit(""))).cast("long") * 60
    w = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("episode_id"), F.col("turn").alias("ordinal"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), (end - size).alias("start_ms"), end.alias("end_ms"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, by: F.get(F.array(*(F.lit(n) for n in names)), F.pmod(by, F.lit(len(names))).cast("int"))
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), F.col("user_id").alias("episode_id"), pick(STEPS, e).alias("type"), pick(STATUSES, e).alias("status"), F.col("props").alias("context"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey % 20 AS drama_id", "p_name AS name", "CASE p_partkey % 5 WHEN 0 THEN 'lead' WHEN 1 THEN 'supporting' WHEN 2 THEN 'extra' WHEN 3 THEN 'narrator' ELSE 'other' END AS role_type", "CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS voice_type")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS episode_id", "CASE l_returnflag WHEN 'A' THEN 'asr_model' WHEN 'N' THEN 'dubbed_video' ELSE 'subtitle' END AS kind", "l_linenumber AS version")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored utterances: one for each pair of neighbouring cue ids of an episode, with hashes that hold for some."""
    from ..functions.hashes import source_hash, voice_hash

    c = cues(spark, sf_dir)
    g = c.withColumn("uid", F.floor(F.col("id") / 7)).groupBy("episode_id", "uid").agg(F.sort_array(F.collect_list(F.struct("start_ms", "id", "text", "end_ms", "emotion", "text_en"))).alias("c"), F.min("role_id").alias("role_id"), F.min("kind").alias("kind"))
    en = F.array_join(F.filter(F.transform("c", lambda x: F.trim(x["text_en"])), lambda t: t != ""), " ")
    g = g.withColumn("text_en", en).withColumn("emotion", F.col("c")[0]["emotion"]).withColumn("current", source_hash("c"))
    odd = F.col("uid") % 3
    return g.withColumn("source_hash", F.when(odd == 0, F.col("current")).when(odd == 1, F.lit("old"))).withColumn("voice_hash", F.when(F.col("uid") % 2 == 0, voice_hash("text_en", "role_id", "emotion")).otherwise(F.lit("")))


#: The views above in SQL.
VIEWS = """
dramas AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS user_id, c_mktsegment AS segment FROM customer),
episodes AS (SELECT o_orderkey AS id, o_custkey AS drama_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS number,
  CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status, o_orderdate::DATE AS updated_at FROM orders),
cues AS (SELECT event_id AS id, user_id AS episode_id, (epoch_us(ts) // 1000) AS start_ms, (epoch_us(ts) // 1000) + floor(value * 60000)::BIGINT AS end_ms, event_type AS speaker,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 END AS role_id, CASE WHEN event_id % 2 = 0 THEN 'neutral' ELSE 'happy' END AS emotion,
  CASE WHEN event_type = 'error' THEN 'sing' ELSE 'speech' END AS kind, props AS text, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || ' ' || event_id END AS text_en FROM events),
lines AS (SELECT conv_id * 1000 + turn AS id, conv_id AS episode_id, turn AS ordinal, role AS speaker, coalesce(text, '') AS text, (e - n)::BIGINT AS start_ms, e::BIGINT AS end_ms
  FROM (SELECT *, length(coalesce(text, '')) * 60 AS n, sum(length(coalesce(text, '')) * 60) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations)),
tasks AS (SELECT event_id AS id, user_id AS episode_id, ['extract', 'asr', 'parse', 'source_review', 'translate', 'translation_review', 'tts', 'mix', 'burn'][event_id % 9 + 1] AS type,
  ['succeeded', 'failed', 'running', 'pending'][event_id % 4 + 1] AS status, props AS context FROM events),
roles AS (SELECT p_partkey AS id, p_partkey % 20 AS drama_id, p_name AS name, CASE p_partkey % 5 WHEN 0 THEN 'lead' WHEN 1 THEN 'supporting' WHEN 2 THEN 'extra' WHEN 3 THEN 'narrator' ELSE 'other' END AS role_type,
  CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS voice_type FROM part),
artifacts AS (SELECT l_orderkey AS episode_id, CASE l_returnflag WHEN 'A' THEN 'asr_model' WHEN 'N' THEN 'dubbed_video' ELSE 'subtitle' END AS kind, l_linenumber AS version FROM lineitem),
ug AS (SELECT episode_id, id // 7 AS uid, min(role_id) AS role_id, min(kind) AS kind, string_agg(nullif(trim(text_en), ''), ' ' ORDER BY start_ms, id) AS en, first(emotion ORDER BY start_ms, id) AS emotion,
  substr(sha256(string_agg(text || '|' || start_ms || '|' || end_ms || '|' || emotion, '|' ORDER BY start_ms, id)), 1, 16) AS current FROM cues GROUP BY ALL),
utterances AS (SELECT episode_id, uid, role_id, kind, emotion, coalesce(en, '') AS text_en, current, CASE uid % 3 WHEN 0 THEN current WHEN 1 THEN 'old' END AS source_hash,
  CASE WHEN uid % 2 = 0 THEN substr(sha256(coalesce(en, '') || '|' || coalesce(role_id::VARCHAR, '_default') || '|' || emotion), 1, 16) ELSE '' END AS voice_hash FROM ug)
"""
