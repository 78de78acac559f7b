"""Role lists, deletions, request rules, paths, JSON updates and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes, parse, rates, requests, text
from ..operators import glossary, snapshots, timeline, workflow
from ..sources import adapters as A
from ..sources import formats
from .registry import query


@query("""+st AS (SELECT id, drama_id, CASE WHEN id BETWEEN 20 AND 39 THEN '默认' ELSE name || id END AS name, voice_type, role_type FROM roles),
li AS (SELECT drama_id, id AS position, id, name || '!' AS name, 'V1' AS voice_type, 'lead' AS role_type FROM st WHERE drama_id NOT IN (5, 6) AND id % 7 < 2
  UNION ALL SELECT drama_id, id, NULL, name, 'V2', 'extra' FROM st WHERE drama_id NOT IN (5, 6) AND id % 7 = 3
  UNION ALL SELECT drama_id, id, 0, 'new', 'V' || id, 'extra' FROM st WHERE drama_id NOT IN (5, 6) AND id BETWEEN 40 AND 79),
i AS (SELECT drama_id, id, arg_max(name, position) AS n, arg_max(voice_type, position) AS v, arg_max(role_type, position) AS r FROM li WHERE id > 0 GROUP BY ALL),
k AS (SELECT st.id, st.drama_id, coalesce(i.n, st.name) AS name, coalesce(i.v, st.voice_type) AS voice_type, coalesce(i.r, st.role_type) AS role_type, i.id IS NOT NULL AS seen FROM st LEFT JOIN i ON i.drama_id = st.drama_id AND i.id = st.id),
m AS (SELECT drama_id, name, arg_max(voice_type, position) AS v, arg_max(role_type, position) AS r FROM li WHERE coalesce(id, 0) <= 0 GROUP BY ALL),
b AS (SELECT k.id, coalesce(k.drama_id, m.drama_id) AS drama_id, coalesce(m.name, k.name) AS name, coalesce(m.v, k.voice_type) AS voice_type, coalesce(m.r, k.role_type) AS role_type, coalesce(k.seen, false) OR m.name IS NOT NULL AS seen
  FROM k FULL JOIN m ON m.drama_id = k.drama_id AND m.name = k.name)
SELECT id, drama_id, name, voice_type, role_type FROM b WHERE drama_id = 6 OR seen OR name = '默认' OR EXISTS (SELECT 1 FROM cues c JOIN episodes e ON e.id = c.episode_id WHERE e.drama_id = b.drama_id AND c.role_id = b.id)""")
def dml_5_jn_8_set_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Every drama but one gets a list, one of them an empty one."""
    name = F.when(F.col("id").between(20, 39), snapshots.DEFAULT_ROLE).otherwise(F.concat("name", F.col("id").cast("string")))
    stored = A.roles(spark, sf).select("id", "drama_id", name.alias("name"), "voice_type", "role_type")
    some = stored.where("drama_id NOT IN (5, 6)")
    by_id = some.where("id % 7 < 2").selectExpr("drama_id", "id AS position", "id", "concat(name, '!') AS name", "'V1' AS voice_type", "'lead' AS role_type")
    by_name = some.where("id % 7 = 3").selectExpr("drama_id", "id AS position", "CAST(NULL AS bigint) AS id", "name", "'V2' AS voice_type", "'extra' AS role_type")
    added = some.where("id BETWEEN 40 AND 79").selectExpr("drama_id", "id AS position", "0L AS id", "'new' AS name", "concat('V', id) AS voice_type", "'extra' AS role_type")
    e = A.episodes(spark, sf).select(F.col("id").alias("episode_id"), "drama_id")
    used = A.cues(spark, sf).select("episode_id", "role_id").join(e, "episode_id").select("drama_id", "role_id")
    return snapshots.set_roles(stored, by_id.unionByName(by_name).unionByName(added), stored.where("drama_id <> 6").select("drama_id"), used)


@query("""+x AS (SELECT id, episode_id, id // 7 AS uid FROM cues), k AS (SELECT * FROM x WHERE NOT (id % 5 = 0 AND episode_id IN (SELECT id FROM episodes WHERE status = 'succeeded')))
SELECT 'cue' AS kind, id AS a, episode_id AS b FROM k UNION ALL SELECT 'link', id, uid FROM k WHERE uid % 4 <> 0 UNION ALL SELECT 'utterance', uid, episode_id FROM (SELECT DISTINCT uid, episode_id FROM x WHERE uid % 4 <> 0)""")
def dml_11_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """Some cues go with their links, then some utterances with theirs."""
    c = A.cues(spark, sf).select("id", "episode_id")
    links = c.select("episode_id", F.floor(F.col("id") / 7).alias("uid"), F.col("id").alias("cue_id"))
    utterances = links.select("episode_id", "uid").distinct()
    done = A.episodes(spark, sf).where("status = 'succeeded'").select(F.col("id").alias("episode_id"))
    c, links = snapshots.delete_cues(c, links, c.where("id % 5 = 0").join(done, "episode_id", "left_semi"))
    utterances, links = snapshots.delete_utterances(utterances, links, utterances.where("uid % 4 = 0"), ("episode_id", "uid"))
    rows = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    return rows(c, "cue", "id", "episode_id").unionByName(rows(links, "link", "cue_id", "uid")).unionByName(rows(utterances, "utterance", "uid", "episode_id"))


@query("""+r AS (SELECT event_id, event_id % 2 = 0 AS vad, CASE WHEN event_id % 3 <> 0 THEN event_id % 6000 END AS w, CASE WHEN event_id % 5 < 2 THEN 'm' END AS ssd, event_id % 7 < 3 AS sp, event_id % 4 = 1 AS split, event_id % 3 AS ch,
  CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'en' ELSE 'zh-CN' END AS lang FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN vad AND w IS NULL THEN 'segments by voice need a window' END, CASE WHEN vad AND w NOT BETWEEN 300 AND 5000 THEN 'the window isn''t within 300 and 5000' END, CASE WHEN NOT vad AND w IS NOT NULL THEN 'a window needs segments by voice' END,
  CASE WHEN ssd IS NOT NULL AND NOT sp THEN 'a speaker model needs speakers' END, CASE WHEN split AND ch <> 2 THEN 'split channels need two' END, CASE WHEN ssd IS NOT NULL AND sp AND lang = 'en' THEN 'a speaker model is for Chinese' END], lambda x: x IS NOT NULL), '; ') AS faults FROM r""")
def val_1_request_faults(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    language = F.when(n % 11 == 1, "").when(n % 11 == 2, "en").when(n % 11 != 0, "zh-CN")
    faults = requests.request_faults(n % 2 == 0, F.when(n % 3 != 0, n % 6000), F.when(n % 5 < 2, "m"), n % 7 < 3, n % 4 == 1, n % 3, language)
    return A.table(spark, sf, "events").select("event_id", F.array_join(faults, "; ").alias("faults"))


@query("""+m(key, path) AS (VALUES ('extract.audio', '#.wav'), ('extract.vocals', '#-vocals.wav'), ('extract.accompaniment', '#-accompaniment.wav'), ('asr.doubao', 'asr-doubao.json'), ('subs.zh_srt', 'output/#-zh.srt'), ('subs.en_srt', 'output/#-en.srt'),
  ('tts.segments_dir', 'tts/segments'), ('mix.audio', '#-mix.wav'), ('burn.video', 'output/#-dubbed.mp4'), ('asr.other', 'asr/other'), ('note', 'misc/note'), ('a.b.c', 'a/b.c')),
k AS (SELECT id, lpad(number::VARCHAR, 3, '0') AS stem, drama_id, ['extract.audio', 'extract.vocals', 'extract.accompaniment', 'asr.doubao', 'subs.zh_srt', 'subs.en_srt', 'tts.segments_dir', 'mix.audio', 'burn.video', 'asr.other', 'note', 'a.b.c'][id % 12 + 1] AS key FROM episodes)
SELECT id, '/w/' || drama_id || '/' || stem || '/' || replace(path, '#', stem) AS path FROM k JOIN m USING (key)""")
def str_24_artifact_paths(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.array(*(F.lit(k) for k in (*requests.ARTIFACTS, "asr.other", "note", "a.b.c")))
    key = F.get(keys, (F.col("id") % 12).cast("int"))
    return A.episodes(spark, sf).select("id", requests.artifact_path(key, F.format_string("/w/%d/%03d", "drama_id", "number")).alias("path"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k":{"was":[' || json_extract_string(props, '$.k') || ',null]},"t":"' || event_type || '"}' ELSE '{"k":' || json_extract_string(props, '$.k') || ',"t":"' || event_type || '"}' END AS context FROM events""")
def dml_9_json_update(spark: SparkSession, sf: str) -> DataFrame:
    nested = F.concat(F.lit('{"t": "'), "event_type", F.lit('", "k": {"was": ['), F.from_json("props", "k long")["k"].cast("string"), F.lit(", null]}}"))
    flat = F.concat(F.lit('{"t": "'), "event_type", F.lit('"}'))
    new = F.when(F.col("event_id") % 2 == 0, nested).otherwise(flat)
    return A.table(spark, sf, "events").select("event_id", parse.json_update(F.col("props"), new).alias("context"))


@query("""+r AS (SELECT id, length(text) + 1 AS n FROM lines), s AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'skipped' WHEN n <= id % 200 THEN 'ok' WHEN n // 2 <= id % 200 THEN 'compressed' ELSE 'truncated' END AS status FROM r)
SELECT count(*) AS total, sum(id % 200)::BIGINT AS total_extend_ms, sum(id % 3)::BIGINT AS total_retries, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'compressed') AS compressed, count(*) FILTER (status = 'truncated') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM s""")
def agg_16_translation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    x = A.lines(spark, sf).select("id", F.repeat(F.lit("x"), F.length("text") + 1).alias("text"))
    f = rates.length_fit(F.col("text"), F.expr("left(text, length(text) div 2)"), (F.col("id") % 200).cast("int"))
    status = F.when(F.col("id") % 11 == 0, "skipped").otherwise(f["status"])
    return timeline.translation_metrics(x.select(status.alias("status"), (F.col("id") % 200).alias("extend_ms"), (F.col("id") % 3).alias("retries")))


@query("""+a AS (SELECT id, CASE WHEN id % 13 <> 0 THEN (1722000000000 - start_ms) // 60000 END AS m FROM cues)
SELECT id, CASE WHEN m IS NULL THEN '--' WHEN m < 1 THEN '刚刚' WHEN m < 60 THEN m || '分钟前' WHEN m < 1440 THEN m // 60 || '小时前' WHEN m < 43200 THEN m // 1440 || '天前' ELSE m // 43200 || '个月前' END AS ago FROM a""")
def tim_3_time_ago(spark: SparkSession, sf: str) -> DataFrame:
    then = F.when(F.col("id") % 13 != 0, F.col("start_ms"))
    return A.cues(spark, sf).select("id", text.ago(then, F.lit(1_722_000_000_000)).alias("ago"))


@query("""+r AS (SELECT *, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS s FROM tasks), l AS (SELECT episode_id, arg_max(s, id) AS s FROM r GROUP BY episode_id HAVING bool_or(status = 'running'))
SELECT 'task' AS kind, id, s AS status, CASE WHEN status = 'running' THEN 'worker lost' END AS error FROM r UNION ALL
SELECT 'episode', e.id, CASE WHEN l.s IS NULL THEN status WHEN l.s = 'pending' THEN 'review' WHEN l.s = 'failed' THEN 'failed' ELSE 'ready' END, NULL FROM episodes e LEFT JOIN l ON l.episode_id = e.id""")
def stm_8_reset_orphans(spark: SparkSession, sf: str) -> DataFrame:
    e, t = workflow.reset_orphans(A.episodes(spark, sf), A.tasks(spark, sf), "worker lost")
    kept = t.select(F.lit("task").alias("kind"), "id", "status", "error")
    return kept.unionByName(e.select(F.lit("episode").alias("kind"), "id", "status", F.lit(None).cast("string").alias("error")))


_GLOSSARY = "+g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 400 END AS drama_id, p_type AS type, p_name AS src, p_brand AS target FROM part) SELECT g.id, drama_id, d.name AS drama_name, type, src, target FROM g LEFT JOIN dramas d ON d.id = g.drama_id"


def _glossary(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 400 END AS drama_id", "p_type AS type", "p_name AS src", "p_brand AS target")


@query(_GLOSSARY)
def jn_7_listing(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.listing(_glossary(spark, sf), A.dramas(spark, sf))


@query(_GLOSSARY + " WHERE drama_id = 7")
def jn_7_listing_of_drama(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.listing(_glossary(spark, sf), A.dramas(spark, sf), drama_id=7)


@query(_GLOSSARY + " WHERE d.user_id = 3")
def jn_7_listing_of_user(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.listing(_glossary(spark, sf), A.dramas(spark, sf), user_id=3)


@query("""+c(key, en) AS (VALUES ('calm', true), ('angry', false), ('glad', true)), k AS (SELECT id, CASE speaker WHEN 'click' THEN 'calm' WHEN 'view' THEN 'glad' WHEN 'error' THEN 'angry' ELSE speaker END AS emotion FROM cues)
SELECT id, emotion, coalesce(en, false) AS in_english FROM k LEFT JOIN c ON c.key = k.emotion""")
def src_4_emotions(spark: SparkSession, sf: str) -> DataFrame:
    """An alias of two keys is the last one's; a speaker that is no alias stays and has no languages."""
    text = '[{"key": "calm", "name": "Calm", "lang": ["zh", "en"], "alias": ["click", "view"]}, {"key": "angry", "name": "Angry", "lang": ["zh"], "alias": ["error"], "disabled": true}, {"key": "glad", "lang": ["en"], "alias": ["view"]}]'
    config = formats.emotions(spark.createDataFrame([(text,)], "value string"))
    c = formats.resolve_emotions(A.cues(spark, sf).select("id", F.col("speaker").alias("emotion")), config, "emotion")
    return formats.emotions_with_language(c, config, "emotion", "en", "in_english")


@query("""+k AS (SELECT id, trim(regexp_replace(text_en, '[ \t\n]+', ' ', 'g')) AS t, coalesce(role_id::VARCHAR, '') AS v, CASE WHEN id % 2 = 0 THEN '温柔' ELSE 'general' END AS style FROM cues)
SELECT id, substr(sha256('e1|v1|' || t || '|' || v || '|{"pitch": ' || id % 3 || ', "rate": 1.1, "style": "' || CASE WHEN id % 2 = 0 THEN '\\u6e29\\u67d4' ELSE 'general' END || '"}|en'), 1, 16) AS with_prosody, substr(sha256('e2|v1|' || t || '|' || v), 1, 16) AS with_reference,
  sha256('{"channels": 1, "engine": "e3", "engine_ver": "v1", "format": "wav", "lang": "en-US", "prosody": {"pitch": ' || id % 3 || ', "rate": 1.0, "role": "", "style": "' || style || '", "volume": ""}, "sample_rate": 24000, "text": "' || t || '", "voice": "' || v || '"}') AS of_payload FROM k""")
def inc_10_synthesis_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of an engine with prosody, of one with a reference voice, and of one that hashes its whole request."""
    spoken = F.concat(F.lit(" \t"), F.regexp_replace("text_en", " ", " \n "), F.lit("\n"))
    voice, style, pitch = F.coalesce(F.col("role_id").cast("string"), F.lit("")), F.when(F.col("id") % 2 == 0, "温柔"), F.col("id") % 3
    prosody = F.to_json(F.struct(F.coalesce(style, F.lit("general")).alias("style"), F.lit(1.1).alias("rate"), pitch.alias("pitch")))
    return A.cues(spark, sf).withColumn("prosody", prosody).select(
        "id",
        hashes.synthesis_key("e1", "v1", spoken, voice, F.col("prosody"), F.lit("en")).alias("with_prosody"),
        hashes.synthesis_key("e2", "v1", spoken, voice).alias("with_reference"),
        hashes.payload_key("e3", "v1", spoken, voice, {"style": style, "pitch": pitch}, F.lit("en-US"), "wav", 24_000, 1).alias("of_payload"),
    )
