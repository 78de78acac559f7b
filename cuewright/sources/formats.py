"""Nested JSON of speech recognition, configuration lookups and subtitle files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, strip, timecode

_WORD = "struct<start_time:long,end_time:long,text:string,additions:map<string,string>>"
RECOGNITION = f"struct<result:struct<utterances:array<struct<start_time:long,end_time:long,text:string,additions:map<string,string>,words:array<{_WORD}>>>>>"
VOICES = (
    "array<struct<VoiceType:string,Name:string,Gender:string,Age:string,Description:string,Avatar:string,TrialURL:string,ResourceID:string,Categories:array<string>,"
    "Emotions:array<struct<Value:string,Label:string,Icon:string>>,Languages:array<struct<Language:string,Text:string,Flag:string>>>>"
)


def recognized(raw: DataFrame, json_col: str = "raw", key: str = "episode_id") -> DataFrame:
    """A row for each utterance: key, start_ms, end_ms, text (blank ones too), speaker ("0" if unknown), emotion and gender (null if unknown)."""
    u = raw.select(key, F.explode(F.from_json(json_col, RECOGNITION)["result"]["utterances"]).alias("u"))
    return u.select(key, F.col("u.start_time").alias("start_ms"), F.col("u.end_time").alias("end_ms"), F.col("u.text").alias("text"), F.coalesce(F.col("u.additions")["speaker"], F.lit("0")).alias("speaker"), F.col("u.additions")["emotion"].alias("emotion"), F.col("u.additions")["gender"].alias("gender"))


def recognized_strict(raw: DataFrame, json_col: str = "raw", key: str = "episode_id") -> DataFrame:
    """As ``recognized``, texts normalized and blank ones dropped, with words, emotion and gender.

    A start that is missing is 0, an end the start, a word's speaker that of its utterance."""
    u = raw.select(key, F.explode(F.from_json(json_col, RECOGNITION)["result"]["utterances"]).alias("u")).withColumn("text", normalize(F.coalesce("u.text", F.lit(""))))
    speaker = F.coalesce(F.col("u.additions")["speaker"], F.lit("0"))
    start = lambda x: F.coalesce(x["start_time"], F.lit(0).cast("long"))
    end = lambda x: F.coalesce(x["end_time"], start(x))
    word = lambda w: F.struct(start(w).alias("start_ms"), end(w).alias("end_ms"), strip(F.coalesce(w["text"], F.lit(""))).alias("text"), F.coalesce(w["additions"]["speaker"], speaker).alias("speaker"))
    words = F.filter(F.transform(F.coalesce("u.words", F.array().cast(f"array<{_WORD}>")), word), lambda w: w["text"] != "")
    return u.where("text <> ''").select(key, start(F.col("u")).alias("start_ms"), end(F.col("u")).alias("end_ms"), "text", speaker.alias("speaker"), F.col("u.additions")["emotion"].alias("emotion"), F.col("u.additions")["gender"].alias("gender"), words.alias("words"))


def voices(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Catalogue rows that have a voice type; emotions without a value are dropped. A name that is
    missing is the voice type, other texts are empty and lists have no elements."""
    v = raw.select(F.explode(F.from_json(json_col, VOICES)).alias("v")).where("coalesce(v.VoiceType, '') <> ''")
    told = lambda x, name: F.coalesce(x[name], F.lit(""))
    listed = lambda c, item: F.coalesce(F.transform(c, item), F.array())
    emotions = listed(F.filter("v.Emotions", lambda e: told(e, "Value") != ""), lambda e: F.struct(e["Value"].alias("value"), told(e, "Label").alias("label"), told(e, "Icon").alias("icon")))
    languages = listed("v.Languages", lambda x: F.struct(told(x, "Language").alias("lang"), told(x, "Text").alias("text"), told(x, "Flag").alias("flag")))
    texts = {"gender": "Gender", "age": "Age", "description": "Description", "avatar": "Avatar", "trial_url": "TrialURL", "resource_id": "ResourceID"}
    return v.select(
        F.col("v.VoiceType").alias("voice_type"),
        F.coalesce("v.Name", "v.VoiceType").alias("name"),
        *(told(F.col("v"), name).alias(c) for c, name in texts.items()),
        F.coalesce("v.Categories", F.array().cast("array<string>")).alias("categories"),
        emotions.alias("emotions"),
        languages.alias("languages"),
    )


def resolve_alias(name: Column, lookup: dict[str, list[str]]) -> Column:
    """The key whose name or aliases hold ``name``; null where none does."""
    out = F.lit(None).cast("string")
    for key, aliases in reversed(lookup.items()):
        out = F.when(name.isin(key, *aliases), key).otherwise(out)
    return out


def emotions(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """position, key, name, languages, aliases and disabled of a configuration, a JSON list in one text
    (as ``spark.read.text`` with ``wholetext`` gives it)."""
    kind = "array<struct<key:string,name:string,lang:array<string>,alias:array<string>,disabled:boolean>>"
    e = raw.select(F.posexplode(F.from_json(json_col, kind)).alias("position", "e"))
    none = F.array().cast("array<string>")
    return e.select("position", "e.key", "e.name", F.coalesce("e.lang", none).alias("languages"), F.coalesce("e.alias", none).alias("aliases"), F.coalesce("e.disabled", F.lit(False)).alias("disabled"))


def resolve_emotions(df: DataFrame, config: DataFrame, col: str) -> DataFrame:
    """``df`` with the key whose aliases hold the column in its place, of several the last; what is no alias stays."""
    alias = config.select(F.explode("aliases").alias("_alias"), "position", "key").groupBy("_alias").agg(F.max_by("key", "position").alias("_key"))
    return df.join(alias, F.col(col) == F.col("_alias"), "left").withColumn(col, F.coalesce("_key", col)).drop("_alias", "_key")


def emotions_with_language(df: DataFrame, config: DataFrame, col: str, language: str, name: str = "supported") -> DataFrame:
    """``df`` with whether the emotion of a column is configured for a language; one that isn't configured isn't."""
    known = config.groupBy(F.col("key").alias("_key")).agg(F.max_by("languages", "position").alias("_languages"))
    return df.join(known, F.col(col) == F.col("_key"), "left").withColumn(name, F.coalesce(F.array_contains("_languages", language), F.lit(False))).drop("_key", "_languages")


def srt_blocks(cues: DataFrame, text: str, key: str = "episode_id") -> DataFrame:
    """key and srt: numbered blocks by start, without blank texts; sung ones between notes."""
    t = F.col(text)
    shown = F.when(F.col("kind") == "sing", F.concat(F.lit("♪"), t, F.lit("♪"))).otherwise(t)
    rows = cues.where(strip(t) != "").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_ms", "id", "end_ms", shown.alias("t")))).alias("c"))
    block = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), timecode(c["start_ms"]), F.lit(" --> "), timecode(c["end_ms"]), F.lit("\n"), c["t"], F.lit("\n"))
    return rows.select(key, F.array_join(F.transform("c", block), "\n").alias("srt"))


def write_srt(cues: DataFrame, text: str, path: str, key: str = "episode_id") -> None:
    """A folder of subtitles for each episode."""
    srt_blocks(cues, text, key).select(key, F.col("srt").alias("value")).write.partitionBy(key).text(path)


#: A segment of a report on synthesis, and the report.
SEGMENT = "utt_id: long, budget_ms: long, raw_ms: long, trimmed_ms: long, final_ms: long, rate: double, status: string, output_path: string, error: string"
REPORT = f"struct<audio_duration_ms: long, segments_dir: string, total_segments: long, success_count: long, failed_count: long, segments: array<struct<{SEGMENT}>>>"


def report_json(segments: DataFrame, key: str = "episode_id") -> DataFrame:
    """key and json, a report of each key's segments by utt_id; ``segments`` has the fields of SEGMENT,
    audio_duration_ms and segments_dir (of the key). An error that is null is written as null."""
    fields = [f.split(":")[0] for f in SEGMENT.split(", ")]
    g = segments.groupBy(key).agg(
        F.max("audio_duration_ms").alias("audio_duration_ms"),
        F.max("segments_dir").alias("segments_dir"),
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if(~F.col("status").eqNullSafe("failed")).alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.sort_array(F.collect_list(F.struct(*fields))).alias("segments"),
    )
    return g.select(key, F.to_json(F.struct(*(c for c in g.columns if c != key)), {"ignoreNullFields": "false"}).alias("json"))


def report_rows(reports: DataFrame, json_col: str = "json", key: str = "episode_id") -> DataFrame:
    """A row for each segment of reports as ``report_json`` writes them, with its report's other fields;
    text that is no report gives none."""
    r = reports.select(key, F.from_json(json_col, REPORT).alias("r"))
    return r.select(key, *(f"r.{c}" for c in ("audio_duration_ms", "segments_dir", "total_segments", "success_count", "failed_count")), F.explode("r.segments").alias("s")).select("*", "s.*").drop("s")


def sync_actions(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """key and action for every key of two tables (key, sha): ``skip`` where checksums agree, ``download`` where there is
    no local file, else ``upload``. A checksum that is null or empty agrees with none. Keys are unique in each table."""
    l, r = local.select(F.col(key), F.col("sha").alias("_local"), F.lit(True).alias("_here")), remote.select(F.col(key), F.col("sha").alias("_remote"))  # noqa: E741
    synced = (F.col("_local") != "") & (F.col("_local") == F.col("_remote"))
    return l.join(r, key, "full").select(key, F.when(F.col("_here").isNull(), "download").when(synced, "skip").otherwise("upload").alias("action"))
