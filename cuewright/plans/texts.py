"""Text, time code and parsing rules, and glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import glossary
from ..sources import adapters as A
from ..sources import formats
from .registry import query


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents")


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(12288), ' '), '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g'), ' +', ' ', 'g') AS normal, trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS collapsed FROM documents".replace("\\x0b", "\x0b"))
def str_1_2_spaces(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.normalize(F.col("text")).alias("normal"), text.collapse_space(F.col("text")).alias("collapsed"))


@query(r"+s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[，。,.、；：;:]+$', '') AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, '\S') THEN t END AS t FROM s")
def str_3_trailing_marks(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.strip_trailing_marks(F.col("text")).alias("t"))


@query(r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace('<sep>' || speaker || '<sep>x <<NAME_1:x>>' || text_en || ' <SLANG:y> ok', '<sep>', ' ', 'g'), '<<NAME_\d+(:[^>]*)?>>|<SLANG:[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t FROM cues")
def str_4_clean_output(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("<sep>"), "speaker", F.lit("<sep>x <<NAME_1:x>>"), "text_en", F.lit(" <SLANG:y> ok"))
    return A.cues(spark, sf).select("id", text.clean_output(raw).alias("t"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))::BIGINT AS alnum, length(regexp_replace(text, '[^一-鿿]', '', 'g'))::BIGINT AS han, regexp_full_match(text, '[\s\p{P}\p{S}]*') AS only_marks, regexp_replace(text, '[一-鿿]', '', 'g') AS without_han FROM documents")
def str_5_6_7_12_classes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", text.count_class(t, "A-Za-z0-9").alias("alnum"), text.count_class(t, "一-鿿").alias("han"), text.only_marks(t).alias("only_marks"), F.regexp_replace(t, "[一-鿿]", "").alias("without_han"))


@query("SELECT episode_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY ordinal) AS t FROM lines GROUP BY episode_id")
def str_13_23_prompt_and_labels(spark: SparkSession, sf: str) -> DataFrame:
    g = A.lines(spark, sf).groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "speaker", "text"))).alias("c"))
    label = lambda c: F.replace(F.replace(F.lit("$who: $what"), F.lit("$who"), c["speaker"]), F.lit("$what"), c["text"])
    return g.select("episode_id", F.array_join(F.transform("c", label), "\n").alias("t"))


@query("SELECT event_id, props AS o, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def str_14_jsn_1_2_json(spark: SparkSession, sf: str) -> DataFrame:
    o = text.json_object(F.concat(F.lit("so: "), "props", F.lit(" end")))
    return A.table(spark, sf, "events").select("event_id", o.alias("o"), F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT id, CASE WHEN name = '' THEN 'keep' WHEN regexp_matches(name, '^(Mr\\.|Ms\\.) ') THEN 'honorific+surname' WHEN contains(name, ' ') THEN 'pinyin' ELSE 'given-name' END AS style FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'Mr. ' || name WHEN 1 THEN name ELSE replace(name, ' ', '') END AS name FROM roles)")
def str_15_name_style(spark: SparkSession, sf: str) -> DataFrame:
    n = F.expr("CASE id % 3 WHEN 0 THEN concat('Mr. ', name) WHEN 1 THEN name ELSE replace(name, ' ', '') END")
    return A.roles(spark, sf).select("id", text.name_style(n).alias("style"))


_G = "+g(src, target, indicators) AS (VALUES ('the', 'DET', NULL), ('tion', 'SUF', NULL), ('ing', 'GER', ['password', 'token']))"
_TERMS = [("the", "DET", None), ("tion", "SUF", None), ("ing", "GER", ["password", "token"])]


@query(_G + " SELECT doc_id, string_agg(DISTINCT src || ':' || target, ',' ORDER BY src || ':' || target) AS hits FROM documents JOIN g ON contains(text, src) AND (indicators IS NULL OR len(list_filter(indicators, lambda w: contains(text, w))) > 0) GROUP BY doc_id")
def jn_11_str_16_glossary_hits(spark: SparkSession, sf: str) -> DataFrame:
    g = spark.createDataFrame(_TERMS, "src string, target string, indicators array<string>")
    return glossary.term_hits(_docs(spark, sf), g, "text", "doc_id")


@query(_G + " SELECT doc_id, src FROM documents JOIN g ON contains(text, src) AND (indicators IS NULL OR len(list_filter(indicators, lambda w: contains(text, w))) > 0) AND NOT contains(lower(text), lower(target))")
def str_17_violations(spark: SparkSession, sf: str) -> DataFrame:
    g = spark.createDataFrame(_TERMS, "src string, target string, indicators array<string>")
    return glossary.violations(_docs(spark, sf), g, "text", "text", "doc_id")


@query("SELECT s.episode_id, s.id AS sentence_id, min(g.id) AS segment_id FROM lines s JOIN lines g USING (episode_id) WHERE g.text = s.text OR contains(g.text, s.text) OR contains(s.text, g.text) GROUP BY ALL")
def jn_15_fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    x = A.lines(spark, sf)
    s = x.select("episode_id", F.col("id").alias("sentence_id"), F.col("text").alias("sentence"))
    return glossary.fuzzy_match(s, x.select("episode_id", F.col("id").alias("segment_id"), F.col("text").alias("segment")), "episode_id")


@query("SELECT doc_id, regexp_matches(text, '(?i)password|token|secret') AS hit FROM documents")
def str_18_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.col("text").rlike("(?i)password|token|secret").alias("hit"))


@query("SELECT id, CASE id % 3 WHEN 0 THEN id WHEN 1 THEN id END AS n FROM dramas")
def str_19_episode_number(spark: SparkSession, sf: str) -> DataFrame:
    name = F.expr("CASE id % 3 WHEN 0 THEN concat('000', id) WHEN 1 THEN concat('第0', id, '集') ELSE concat('x', id) END")
    n = F.coalesce(F.nullif(F.regexp_extract(name, r"^0*(\d{1,18})$", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"^第0*(\d{1,18})集$", 1), F.lit("")))
    return A.dramas(spark, sf).select("id", n.cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, unnest(generate_series(l_linenumber, l_linenumber + 2))::INT AS n FROM lineitem")
def str_20_range(spark: SparkSession, sf: str) -> DataFrame:
    span = F.concat_ws("-", "l_linenumber", F.col("l_linenumber") + 2)
    a, b = (F.regexp_extract(span, r"^(\d+)-(\d+)$", k).cast("int") for k in (1, 2))
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.sequence(a, b)).alias("n"))


@query("+n AS (SELECT *, lead(text) OVER (PARTITION BY episode_id ORDER BY ordinal) AS nx FROM lines) SELECT id, text || CASE WHEN text = '' OR regexp_matches(text, '[，。！？、；：,.!?;:]$') THEN '' ELSE '，' END || nx AS t FROM n WHERE nx IS NOT NULL")
def str_22_merge_texts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    nx = F.lead("text").over(Window.partitionBy("episode_id").orderBy("ordinal"))
    return A.lines(spark, sf).select("id", text.merge_texts(F.col("text"), nx).alias("t")).where("t is not null")


@query("SELECT id, drama_id || '/' || lpad(number::VARCHAR, 3, '0') || '/asr.json' AS path, CASE WHEN number % 2 = 0 THEN 'video' ELSE 'subtitle' END AS kind FROM episodes")
def str_24_25_paths(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for x in ("mp4", "video", "srt", "subtitle", "wav", "audio", "json", "data")))
    file = F.when(F.col("number") % 2 == 0, F.lit("a.b.mp4")).otherwise(F.lit("c.srt"))
    return A.episodes(spark, sf).select("id", F.format_string("%d/%03d/asr.json", "drama_id", "number").alias("path"), kinds[F.substring_index(file, ".", -1)].alias("kind"))


@query("SELECT id, coalesce(nullif(text_en, ''), nullif(speaker, ''), text) AS t FROM cues")
def str_28_text_key(spark: SparkSession, sf: str) -> DataFrame:
    return A.cues(spark, sf).select("id", F.coalesce(F.nullif("text_en", F.lit("")), F.nullif("speaker", F.lit("")), "text").alias("t"))


_HMS = "format('{:02d}:{:02d}:{:02d},{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)"


@query(f"+m AS (SELECT id, start_ms % 86400000 AS ms FROM cues) SELECT id, {_HMS} AS exact, {_HMS.replace('ms ', 'lg ')} AS legacy, format('{{:02d}}:{{:02d}}.{{:03d}}', ms // 60000, ms // 1000 % 60, ms % 1000) AS short FROM (SELECT *, floor((ms / 1000.0::DOUBLE) * 1000)::BIGINT AS lg FROM m)")
def tim_1_2_timecodes(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.col("start_ms") % 86_400_000
    return A.cues(spark, sf).select("id", text.timecode(ms).alias("exact"), text.timecode(ms, legacy=True).alias("legacy"), text.short_timecode(ms).alias("short"))


@query("+a AS (SELECT id, (1722000000000 - start_ms) // 60000 AS m FROM cues) SELECT id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN m // 60 || 'h' WHEN m < 43200 THEN m // 1440 || 'd' ELSE 'long ago' END AS ago FROM a")
def tim_3_ago(spark: SparkSession, sf: str) -> DataFrame:
    m = F.floor((F.lit(1_722_000_000_000) - F.col("start_ms")) / 60_000)
    part = lambda by, unit: F.concat(F.floor(m / by).cast("string"), F.lit(unit))
    return A.cues(spark, sf).select("id", F.when(m < 1, "now").when(m < 60, part(1, "m")).when(m < 1440, part(60, "h")).when(m < 43_200, part(1440, "d")).otherwise("long ago").alias("ago"))


@query(f"+c AS (SELECT episode_id, id, start_ms % 86400000 AS start_ms, end_ms % 86400000 AS end_ms, text_en, kind FROM cues WHERE trim(text_en) <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, id) AS r FROM c) SELECT episode_id, string_agg(r || chr(10) || {_HMS.replace('ms ', 'start_ms ')} || ' --> ' || {_HMS.replace('ms ', 'end_ms ')} || chr(10) || CASE WHEN kind = 'sing' THEN '♪' || text_en || '♪' ELSE text_en END || chr(10), chr(10) ORDER BY r) AS srt FROM n GROUP BY episode_id")
def snk_2_3_srt(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf).withColumns({x: F.col(x) % 86_400_000 for x in ("start_ms", "end_ms")})
    return formats.srt_blocks(c, "text_en")


@query(f"+c AS (SELECT episode_id, id, start_ms % 86400000 AS start_ms, end_ms % 86400000 AS end_ms, text, kind FROM cues WHERE trim(text) <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, id) AS r FROM c) SELECT episode_id, string_agg(r || chr(10) || {_HMS.replace('ms ', 'start_ms ')} || ' --> ' || {_HMS.replace('ms ', 'end_ms ')} || chr(10) || CASE WHEN kind = 'sing' THEN '♪' || text || '♪' ELSE text END || chr(10), chr(10) ORDER BY r) AS srt FROM n GROUP BY episode_id")
def snk_3_source_srt(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf).withColumns({x: F.col(x) % 86_400_000 for x in ("start_ms", "end_ms")})
    return formats.srt_blocks(c, "text")


@query("+s AS (SELECT episode_id, id, text, start_ms, end_ms, speaker FROM lines) SELECT episode_id, start_ms, end_ms, text, speaker, CASE WHEN id % 2 = 0 THEN 'happy' END AS emotion, CASE WHEN id % 3 = 0 THEN 'female' END AS gender FROM s")
def src_2_recognized(spark: SparkSession, sf: str) -> DataFrame:
    u = F.struct(F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"), "text", F.create_map(F.lit("speaker"), "speaker", F.lit("emotion"), F.expr("CASE WHEN id % 2 = 0 THEN 'happy' END"), F.lit("gender"), F.expr("CASE WHEN id % 3 = 0 THEN 'female' END")).alias("additions"))
    raw = A.lines(spark, sf).groupBy("episode_id").agg(F.to_json(F.struct(F.struct(F.collect_list(u).alias("utterances")).alias("result"))).alias("raw"))
    return formats.recognized(raw)


@query("SELECT id, CASE WHEN speaker IN ('click', 'view') THEN 'calm' WHEN speaker IN ('error') THEN 'angry' END AS emotion FROM cues")
def src_4_alias(spark: SparkSession, sf: str) -> DataFrame:
    return A.cues(spark, sf).select("id", formats.resolve_alias(F.col("speaker"), {"calm": ["click", "view"], "angry": ["error"]}).alias("emotion"))


@query("SELECT episode_id, string_agg(c.id || '=' || coalesce(role_id::VARCHAR, '') || ':' || coalesce(r.voice_type, ''), ',' ORDER BY c.id) AS idx FROM cues c LEFT JOIN roles r ON r.id = c.role_id WHERE speaker IS DISTINCT FROM 'error' GROUP BY episode_id")
def snk_5_index(spark: SparkSession, sf: str) -> DataFrame:
    """id=role:voice of each cue that isn't an error; without a role, or with one that has no voice, that part is empty."""
    r = A.roles(spark, sf).select(F.col("id").alias("role_id"), "voice_type")
    c = A.cues(spark, sf).where("NOT speaker <=> 'error'").select("episode_id", "id", "role_id").join(r, "role_id", "left")
    g = c.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce(F.col("role_id").cast("string"), F.lit("")).alias("role"), F.coalesce("voice_type", F.lit("")).alias("voice")))).alias("m"))
    return g.select("episode_id", F.array_join(F.transform("m", lambda x: F.concat(x["id"], F.lit("="), x["role"], F.lit(":"), x["voice"])), ",").alias("idx"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN [props, event_type || chr(10) || 'second', ''] WHEN 1 THEN [event_type, props, ''] ELSE [event_type, 'b', props] END AS parts FROM events")
def str_8_9_10_numbered(spark: SparkSession, sf: str) -> DataFrame:
    over_lines = F.concat(F.lit("[1] old\n[2] "), "event_type", F.lit("\nsecond\n[9] x\n[1] "), "props")
    in_line = F.concat(F.lit(" [1] "), "event_type", F.lit(" [2]  "), "props")
    unnumbered = F.concat(F.lit("1. "), "event_type", F.lit("\n\n2: b\n"), "props", F.lit("\nmore"))
    k = F.col("event_id") % 3
    raw = F.when(k == 0, over_lines).when(k == 1, in_line).otherwise(unnumbered)
    return A.table(spark, sf, "events").select("event_id", parse.numbered_output(raw, 3).alias("parts"))


_MARKS = "[，。！？、；：,.!?;:]"


@query(rf"""+w AS (SELECT id, text, floor(length(text) * ((id % 11) / 10.0::DOUBLE) + 0.5)::INT AS w FROM lines), m AS (SELECT id, text, w, unnest(generate_series(1, length(text)))::INT - 1 AS i FROM w),
b AS (SELECT id, arg_min(i, CASE WHEN i >= w THEN (i - w) * 2 ELSE (w - 1 - i) * 2 + 1 END) AS i FROM m WHERE regexp_matches(substr(text, i + 1, 1), '{_MARKS}') GROUP BY id)
SELECT w.id, CASE WHEN b.i IS NOT NULL THEN [substr(text, 1, b.i), substr(text, b.i + 2)] ELSE [substr(text, 1, greatest(1, w)), substr(text, greatest(1, w) + 1)] END AS parts FROM w LEFT JOIN b USING (id)""")
def str_21_split(spark: SparkSession, sf: str) -> DataFrame:
    return A.lines(spark, sf).select("id", parse.split_at_ratio(F.col("text"), F.col("id") % 11 / F.lit(10.0)).alias("parts"))


@query("+r AS (SELECT l_orderkey, l_linenumber, l_quantity / 10.0::DOUBLE AS r FROM lineitem), n AS (SELECT *, CASE WHEN r <= 2 THEN 0 WHEN r <= 4 THEN 1 ELSE 2 END AS up, CASE WHEN r >= 0.5 THEN 0 WHEN r >= 0.25 THEN 1 WHEN r >= 0.125 THEN 2 ELSE 3 END AS down FROM r) SELECT l_orderkey, l_linenumber, [2.0::DOUBLE for x in range(up)] || [0.5::DOUBLE for x in range(down)] || [r / pow(2, up) * pow(2, down)] AS chain FROM n")
def mth_11_atempo(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", parse.atempo(F.col("l_quantity") / 10).alias("chain"))


@query(r"""+t AS (SELECT id, speaker, ltrim(text, E' \t\n\v\f\r') AS said FROM lines)
SELECT id, CASE WHEN said = '' THEN ['old', '', '<<<0>>>'] ELSE [trim(speaker), '', regexp_replace(string_split(said, chr(10))[1], '\s+$', '')] END AS parts FROM t""")
def str_9_tagged(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("<<<0>>>\nold\n<<<2>>>\n"), "text", F.lit("\n<<<0>>>\n"), "speaker")
    return A.lines(spark, sf).select("id", parse.tagged_output(raw, 3).alias("parts"))


@query("+l AS (SELECT id, list_filter(list_transform(string_split('1. ' || speaker || chr(10) || '2. ' || text, chr(10)), lambda x: trim(regexp_replace(x, '^[0-9. ]+', ''), ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM lines) SELECT id, [coalesce(l[1], ''), coalesce(l[2], ''), coalesce(l[3], '')] AS parts FROM l")
def str_10_simple(spark: SparkSession, sf: str) -> DataFrame:
    return A.lines(spark, sf).select("id", parse.simple_output(F.concat(F.lit("1. "), "speaker", F.lit("\n2. "), "text"), 3).alias("parts"))


@query("SELECT id, 'Li Ming met Wang Fang. ' || text AS t FROM lines")
def str_11_restored(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("Li Ming"), F.lit("Wang Fang"))
    raw = F.concat(F.lit("<<NAME_0:x>> met wang'fang. "), "text")
    return A.lines(spark, sf).select("id", parse.restore_and_repair_names(raw, names).alias("t"))


@query("SELECT id, trim(regexp_replace(regexp_replace('Li Ming met Wang Fang ' || text, '[\u4e00-\u9fff]+', '', 'g'), '\\s+', ' ', 'g')) AS t FROM lines")
def str_11_finished(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("Li Ming"), F.lit("Wang Fang"))
    raw = F.concat(F.lit("<<NAME_0:x>> met wang'fang<sep><<NAME_7>><SLANG:y>你好 "), "text")
    return A.lines(spark, sf).select("id", parse.finished_translation(raw, names).alias("t"))


@query("""SELECT episode_id, '{"context_type":"dialog_ctx","context_data":[{"text":"episode ' || episode_id || '"},{"text":"常见词汇：' || string_agg(DISTINCT speaker, '、' ORDER BY speaker) || '"}]}' AS context FROM lines GROUP BY episode_id""")
def jsn_4_context(spark: SparkSession, sf: str) -> DataFrame:
    g = A.lines(spark, sf).groupBy("episode_id").agg(F.array_sort(F.collect_set("speaker")).alias("words"))
    return g.select("episode_id", parse.corpus_context(F.concat(F.lit("episode "), "episode_id"), F.col("words")).alias("context"))
