"""Media files: names, kinds, checksums and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..sources import adapters as A
from ..sources import formats
from .registry import query

_PATH = "CASE id % 4 WHEN 1 THEN '/raw/' || id || '.mov' WHEN 2 THEN '/raw/dub/' || id || '.mp4' WHEN 3 THEN '/raw/output/' || number || '.mp4' ELSE CASE WHEN id % 8 = 0 THEN '' END END"


@query("SELECT e.id, CASE WHEN e.id % 4 = 1 THEN '/raw/' || e.id || '.mov' ELSE d.name || '/' || e.number || '.mp4' END AS video_file FROM episodes e JOIN dramas d ON d.id = e.drama_id")
def prj_2_original_videos(spark: SparkSession, sf: str) -> DataFrame:
    e = A.episodes(spark, sf).join(A.dramas(spark, sf).select(F.col("id").alias("drama_id"), "name"), "drama_id")
    return e.withColumn("path", F.expr(_PATH)).select("id", files.video_file(F.col("path"), F.col("name"), F.col("number")).alias("video_file"))


@query("SELECT id, CASE WHEN id % 4 < 2 THEN number END AS n FROM episodes")
def str_19_numbers_of_names(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.expr("CASE id % 4 WHEN 0 THEN lpad(number, 4, '0') WHEN 1 THEN concat('第00', number, '集') WHEN 2 THEN concat('x', number) ELSE concat('第', number) END")
    return A.episodes(spark, sf).select("id", files.episode_number(stem).alias("n"))


@query("""SELECT id, unnest(CASE WHEN id % 4 = 0 THEN list_transform(generate_series(number, number + 3), lambda n: n::VARCHAR) WHEN id % 4 = 1 THEN CASE WHEN number = 0 THEN ['0'] ELSE []::VARCHAR[] END
  WHEN id % 4 = 2 THEN [number::VARCHAR] ELSE ['ep-' || number] END) AS episode FROM episodes""")
def str_20_episodes_of_arguments(spark: SparkSession, sf: str) -> DataFrame:
    span = F.expr("CASE id % 4 WHEN 0 THEN concat(number, '-', number + 3) WHEN 1 THEN concat(number, '-0') WHEN 2 THEN string(number) ELSE concat('ep-', number) END")
    return A.episodes(spark, sf).select("id", F.explode(files.episodes_of(span)).alias("episode"))


@query("SELECT id, ['json', 'bin', 'wav', 'bin', 'dir', 'mp3'][id % 6 + 1] AS kind FROM episodes")
def str_25_kinds_of_files(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr("concat(drama_id, '/', CASE id % 6 WHEN 0 THEN 'a.b.JSON' WHEN 1 THEN '.srt' WHEN 2 THEN 'x.Wav' WHEN 3 THEN 'v.mp4/raw' WHEN 4 THEN 'tts/' ELSE 'a.mp3' END)")
    return A.episodes(spark, sf).select("id", files.file_kind(path).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'download' WHEN doc_id % 3 = 0 OR (doc_id % 5 = 0 AND text IS NOT NULL) OR text IS NULL THEN 'upload' ELSE 'skip' END AS action FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 3 = 0)")
def src_7_sync_actions(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents")
    sent = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    local = d.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    remote = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2(sent, 256).alias("sha"))
    return formats.sync_actions(local, remote, "doc_id")


@query("""SELECT episode_id, id AS utt_id, end_ms - start_ms AS budget_ms, CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN id % 4 = 0 THEN 'a "quoted"' || chr(10) || 'line' END AS error, 1 + (id % 3) / 4.0::DOUBLE AS rate,
  count(*) OVER w AS total_segments, count(*) FILTER (id % 4 <> 0) OVER w AS success_count, count(*) FILTER (id % 4 = 0) OVER w AS failed_count, max(end_ms) OVER w AS audio_duration_ms, 'tts/' || episode_id AS segments_dir FROM cues WINDOW w AS (PARTITION BY episode_id)""")
def snk_4_reports(spark: SparkSession, sf: str) -> DataFrame:
    n, failed = F.col("end_ms") - F.col("start_ms"), F.col("id") % 4 == 0
    segments = A.cues(spark, sf).select(
        "episode_id", F.col("id").alias("utt_id"), n.alias("budget_ms"), n.alias("raw_ms"), n.alias("trimmed_ms"), n.alias("final_ms"), (1 + F.col("id") % 3 / 4.0).alias("rate"),
        F.when(failed, "failed").otherwise("success").alias("status"), F.concat("id", F.lit(".wav")).alias("output_path"), F.when(failed, 'a "quoted"\nline').alias("error"),
        F.col("end_ms").alias("audio_duration_ms"), F.concat(F.lit("tts/"), "episode_id").alias("segments_dir"),
    )
    rows = formats.report_rows(formats.report_json(segments))
    return rows.drop("raw_ms", "trimmed_ms", "final_ms", "output_path")
