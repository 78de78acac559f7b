"""Reading, appending and consuming: sources, sinks and the task stream end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import snapshots, workflow
from ..sources import adapters as A
from ..sources import formats
from ..sources.shared import shared_path
from ..streaming import feed
from .registry import query


@query("SELECT id, start_ms, speaker, text FROM cues WHERE episode_id = 42")
def src_1_scan_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return A.cues(spark, sf).where("episode_id = 42").select("id", "start_ms", "speaker", "text")


@query(r"""+s AS (SELECT *, regexp_replace(regexp_replace(replace(text, chr(12288), ' '), '^\s+|\s+$', '', 'g'), ' +', ' ', 'g') AS t, len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '\S'))) AS n FROM lines)
  SELECT episode_id, CASE WHEN ordinal % 3 = 0 THEN 0 ELSE start_ms END AS start_ms, end_ms, t AS text, speaker, n::BIGINT AS n_words, n > 0 AS of_speaker FROM s WHERE t <> ''""")
def src_3_recognized_strict(spark: SparkSession, sf: str) -> DataFrame:
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"), F.col("start_ms").alias("start_time")))
    start = F.when(F.col("ordinal") % 3 != 0, F.col("start_ms"))
    u = F.struct(start.alias("start_time"), F.col("end_ms").alias("end_time"), "text", F.create_map(F.lit("speaker"), "speaker").alias("additions"), words.alias("words"))
    raw = A.lines(spark, sf).groupBy("episode_id").agg(F.to_json(F.struct(F.struct(F.collect_list(u).alias("utterances")).alias("result"))).alias("raw"))
    of_speaker = F.exists("words", lambda w: w["speaker"] == F.col("speaker"))
    return formats.recognized_strict(raw).select("episode_id", "start_ms", "end_ms", "text", "speaker", F.size("words").cast("long").alias("n_words"), of_speaker.alias("of_speaker"))


@query("""SELECT p_brand || p_partkey AS voice_type, CASE WHEN p_partkey % 3 = 0 THEN p_brand || p_partkey ELSE p_name END AS name, p_type AS gender, '' AS age, [p_type] AS categories,
  CASE WHEN p_size > 20 THEN 'happy' ELSE '' END AS emotions, 'en' AS languages FROM part WHERE p_partkey % 4 <> 0""")
def src_5_voices(spark: SparkSession, sf: str) -> DataFrame:
    one = F.struct(
        F.when(F.col("p_partkey") % 4 != 0, F.concat("p_brand", F.col("p_partkey").cast("string"))).alias("VoiceType"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("Name"),
        F.col("p_type").alias("Gender"),
        F.array("p_type").alias("Categories"),
        F.array(F.struct(F.when(F.col("p_size") > 20, "happy").otherwise("").alias("Value"))).alias("Emotions"),
        F.array(F.struct(F.lit("en").alias("Language"))).alias("Languages"),
    )
    v = formats.voices(A.table(spark, sf, "part").select(F.to_json(F.array(one)).alias("raw")))
    values = lambda c, field: F.array_join(F.transform(c, lambda x: x[field]), ",").alias(c)
    return v.select("voice_type", "name", "gender", "age", "categories", values("emotions", "value"), values("languages", "lang"))


@query("SELECT id, episode_id, text FROM cues")
def snk_1_append(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = A.cues(spark, sf).select("id", "episode_id", "text"), shared_path(spark, "cues")
    for part in (0, 1):
        snapshots.append(rows.where(F.col("id") % 2 == part), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT id, type, 'running' AS status FROM tasks WHERE status = 'pending'")
def stm_1_consume(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.tasks(spark, sf).select("id", "type", "status")
    came, out = shared_path(spark, "tasks"), shared_path(spark, "claimed")
    rows.repartition(3).write.parquet(came)

    def claim(batch: DataFrame, number: int) -> None:
        # a folder for each batch: one that runs again after a failure replaces its own rows
        batch.where("status = 'pending'").withColumn("status", F.lit("running")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    feed.consume(feed.task_stream(spark, came, "id long, type string, status string"), claim, shared_path(spark, "progress"))
    return spark.read.schema("id long, type string, status string, batch int").parquet(out).drop("batch")


@query("SELECT l_orderkey, l_linenumber, l_quantity > 10 AND l_linestatus <> 'F' AS reuse FROM lineitem")
def inc_12_reuse(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("l_quantity") > 10, F.col("l_quantity"))
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", workflow.reusable(size, F.col("l_linestatus") == "F").alias("reuse"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS at FROM events")
def tim_4_iso(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").select("event_id", text.iso_utc(F.col("ts")).alias("at"))


@query("""+l AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS k, l_partkey % 3000 AS a, l_partkey % 3000 + l_suppkey % 500 AS b, (l_quantity * 100)::BIGINT AS size FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, size, CASE k WHEN 0 THEN a WHEN 1 THEN greatest(0, size - a) WHEN 2 THEN a END AS s, CASE k WHEN 0 THEN b WHEN 3 THEN NULL ELSE size - 1 END AS e FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN s <= e AND s < size THEN s END AS first_byte, CASE WHEN s <= e AND s < size THEN least(e, size - 1) END AS last_byte FROM r""")
def mth_17_byte_range(spark: SparkSession, sf: str) -> DataFrame:
    a, k = F.col("l_partkey") % 3000, F.col("l_linenumber") % 4
    first, end = a.cast("string"), (a + F.col("l_suppkey") % 500).cast("string")
    header = F.when(k == 0, F.concat(F.lit("bytes="), first, F.lit("-"), end, F.lit(", 0-1"))).when(k == 1, F.concat(F.lit("bytes=-"), first)).when(k == 2, F.concat(F.lit("bytes="), first, F.lit("-"))).otherwise("items=0-1")
    r = parse.byte_range(header, (F.col("l_quantity") * 100).cast("long"))
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", F.col("r.start").alias("first_byte"), F.col("r.end").alias("last_byte"))
