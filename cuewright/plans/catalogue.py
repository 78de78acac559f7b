"""Listings of dramas and episodes: scans, filters, joins, aggregates, sorts, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import catalogue
from ..sources import adapters as A
from .registry import query

_STATUS = "CASE WHEN started = 0 THEN 'not_started' WHEN succeeded = n THEN 'completed' WHEN succeeded < n THEN 'running' END"
_AGG = """+a AS (SELECT d.id, d.name, d.user_id, count(e.id) AS n, max(e.updated_at) AS updated_at, count(*) FILTER (e.status = 'succeeded') AS succeeded,
  count(*) FILTER (e.status <> 'ready') AS started FROM dramas d LEFT JOIN episodes e ON e.drama_id = d.id GROUP BY ALL)"""


def drama_totals(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.drama_totals(A.dramas(spark, sf), A.episodes(spark, sf))


@query(_AGG + "SELECT * FROM a")
def agg_1_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return drama_totals(spark, sf)


@query("""+e AS (SELECT *, CASE WHEN id % 3 > 0 THEN updated_at END AS at FROM episodes), d AS (SELECT *, DATE '1996-01-01' + (id % 900)::INT AS at FROM dramas)
SELECT d.id, d.name, count(e.id) AS n, max(coalesce(e.at, d.at)) AS updated_at, count(*) FILTER (e.status = 'succeeded') AS succeeded, count(*) FILTER (e.status <> 'ready') AS started FROM d LEFT JOIN e ON e.drama_id = d.id GROUP BY d.id, d.name""")
def agg_1_catalogue_with_own_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dramas have no dates in the tables, so that they are made from ids; every third episode has none."""
    d = A.dramas(spark, sf).withColumn("updated_at", F.expr("date_add(DATE'1996-01-01', CAST(id % 900 AS INT))"))
    e = A.episodes(spark, sf).withColumn("updated_at", F.expr("CASE WHEN id % 3 > 0 THEN updated_at END"))
    return catalogue.drama_totals(d, e, ("id", "name"))


@query(_AGG + f"SELECT id, {_STATUS} AS status FROM a")
def agg_2_status_classes(spark: SparkSession, sf: str) -> DataFrame:
    return drama_totals(spark, sf).select("id", F.expr(_STATUS).alias("status"))


@query(_AGG + "SELECT count(*) AS total FROM a WHERE started > 0 AND succeeded < n")
def agg_3_total_before_paging(spark: SparkSession, sf: str) -> DataFrame:
    return drama_totals(spark, sf).where("started > 0 AND succeeded < n").agg(F.count(F.lit(1)).alias("total"))


@query("SELECT drama_id, count(*) AS total_episodes, coalesce(max(number), 0) + 1 AS next_number FROM episodes GROUP BY drama_id")
def agg_4_5_counts_and_next_number(spark: SparkSession, sf: str) -> DataFrame:
    return A.episodes(spark, sf).groupBy("drama_id").agg(F.count(F.lit(1)).alias("total_episodes"), (F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next_number"))


@query("SELECT episode_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM artifacts GROUP BY episode_id")
def agg_7_kinds_by_episode(spark: SparkSession, sf: str) -> DataFrame:
    return A.artifacts(spark, sf).groupBy("episode_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query("SELECT e.id, bool_or(coalesce(a.kind = 'asr_model', false)) AS has_asr_model, bool_or(coalesce(a.kind = 'dubbed_video', false)) AS dubbed_video, bool_or(coalesce(a.kind = 'subtitle', false)) AS subtitle_file FROM episodes e LEFT JOIN artifacts a ON a.episode_id = e.id GROUP BY e.id")
def prj_3_artifact_flags(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"has_asr_model": "asr_model", "dubbed_video": "dubbed_video", "subtitle_file": "subtitle"}
    a = A.artifacts(spark, sf).groupBy("episode_id").agg(*(F.bool_or(F.col("kind") == k).alias(n) for n, k in kinds.items()))
    return A.episodes(spark, sf).select("id").join(a, F.col("id") == F.col("episode_id"), "left").select("id", *(F.coalesce(n, F.lit(False)).alias(n) for n in kinds))


@query("SELECT user_id, count(*) FILTER (status = 'succeeded') AS done, count(*) FILTER (status NOT IN ('ready', 'succeeded')) AS in_progress, count(*) FILTER (status = 'running') AS running FROM episodes e JOIN dramas d ON d.id = e.drama_id GROUP BY user_id")
def agg_11_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("status")
    e = A.episodes(spark, sf).join(A.dramas(spark, sf).select(F.col("id").alias("drama_id"), "user_id"), "drama_id")
    return e.groupBy("user_id").agg(F.count_if(s == "succeeded").alias("done"), F.count_if(~s.isin("ready", "succeeded")).alias("in_progress"), F.count_if(s == "running").alias("running"))


@query("SELECT drama_id, string_agg(number || ':' || status, ',' ORDER BY number) AS episodes FROM episodes GROUP BY drama_id")
def agg_12_episodes_by_drama(spark: SparkSession, sf: str) -> DataFrame:
    g = A.episodes(spark, sf).groupBy("drama_id").agg(F.sort_array(F.collect_list(F.struct("number", "status"))).alias("e"))
    return g.select("drama_id", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["number"], x["status"])), ",").alias("episodes"))


@query("SELECT drama_id, count(*) FILTER (voice_type IS NULL) AS missing, coalesce(string_agg(DISTINCT CASE WHEN voice_type IS NULL THEN name END, ','  ORDER BY CASE WHEN voice_type IS NULL THEN name END), '') AS names FROM roles GROUP BY drama_id")
def agg_14_missing_voices(spark: SparkSession, sf: str) -> DataFrame:
    none = F.col("voice_type").isNull()
    return A.roles(spark, sf).groupBy("drama_id").agg(F.count_if(none).alias("missing"), F.array_join(F.sort_array(F.collect_set(F.when(none, F.col("name")))), ",").alias("names"))


@query("SELECT voice_type AS category, min(id) AS first_seen, row_number() OVER (ORDER BY min(id)) - 1 AS ordinal FROM roles WHERE voice_type IS NOT NULL GROUP BY voice_type")
def agg_18_categories_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    c = A.roles(spark, sf).where("voice_type is not null").groupBy(F.col("voice_type").alias("category")).agg(F.min("id").alias("first_seen"))
    return c.withColumn("ordinal", (F.row_number().over(Window.orderBy("first_seen")) - 1).cast("long"))  # few rows, one a category


@query("SELECT id, name FROM dramas WHERE user_id = 7 AND name LIKE '%0_1%'")
def flt_1_2_optional_and_substring(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.listing(A.dramas(spark, sf), owner=7, search="0_1").select("id", "name")



@query("SELECT id, type FROM tasks WHERE type IN ('tts', 'mix') AND status = 'pending'")
def flt_3_in_list(spark: SparkSession, sf: str) -> DataFrame:
    return A.tasks(spark, sf).where(F.col("type").isin("tts", "mix") & (F.col("status") == "pending")).select("id", "type")


@query("SELECT id, EXISTS (SELECT 1 FROM tasks t WHERE t.episode_id = e.id AND t.status = 'running') AS busy FROM episodes e")
def flt_4_existence(spark: SparkSession, sf: str) -> DataFrame:
    busy = A.tasks(spark, sf).where("status = 'running'").select(F.col("episode_id").alias("_e")).distinct()
    return A.episodes(spark, sf).select("id").join(busy, F.col("id") == F.col("_e"), "left").select("id", F.col("_e").isNotNull().alias("busy"))


@query("SELECT id FROM cues WHERE kind = 'speech' AND end_ms - start_ms BETWEEN 2000 AND 8000000 AND length(text) >= 4")
def flt_5_sample_quality(spark: SparkSession, sf: str) -> DataFrame:
    return A.cues(spark, sf).where("kind = 'speech' AND end_ms - start_ms BETWEEN 2000 AND 8000000 AND length(text) >= 4").select("id")


@query("SELECT format('utt_{:08x}', id) AS utt_id, end_ms - start_ms AS budget_ms, nullif(emotion, 'neutral') AS emotion, 1.3::DOUBLE AS max_rate, 0 AS allow_extend_ms FROM cues WHERE kind <> 'sing' AND trim(text_en) <> '' AND end_ms > start_ms")
def flt_6_manifest(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf).where("kind <> 'sing' AND end_ms > start_ms").where(strip(F.col("text_en")) != "")
    return c.select(F.format_string("utt_%08x", "id").alias("utt_id"), (F.col("end_ms") - F.col("start_ms")).alias("budget_ms"), F.nullif("emotion", F.lit("neutral")).alias("emotion"), F.lit(1.3).alias("max_rate"), F.lit(0).alias("allow_extend_ms"))


@query("SELECT id FROM roles WHERE role_type = 'lead' AND list_contains(string_split(name, ' '), 'ring')")
def flt_7_category_member(spark: SparkSession, sf: str) -> DataFrame:
    return A.roles(spark, sf).where((F.col("role_type") == "lead") & F.array_contains(F.split("name", " "), "ring")).select("id")


@query("SELECT id FROM roles WHERE contains(lower(name), 'WIDG'.lower()) OR starts_with(regexp_replace(name, '([a-z])[a-z]* *', '\\1', 'g'), 'bb')")
def flt_8_role_search(spark: SparkSession, sf: str) -> DataFrame:
    initials = F.regexp_replace("name", "([a-z])[a-z]* *", "$1")
    return A.roles(spark, sf).where(F.lower("name").contains("WIDG".lower()) | initials.startswith("bb")).select("id")


@query("SELECT id FROM dramas WHERE name GLOB 'Customer#*7' OR name GLOB '*00?'")
def flt_9_glob_list(spark: SparkSession, sf: str) -> DataFrame:
    return A.dramas(spark, sf).where(catalogue.allowed(F.col("name"), ["Customer#*7", "*00?"])).select("id")



@query("SELECT e.id FROM episodes e JOIN dramas d ON d.id = e.drama_id WHERE d.user_id = 3")
def flt_10_ownership(spark: SparkSession, sf: str) -> DataFrame:
    mine = A.dramas(spark, sf).where("user_id = 3").select(F.col("id").alias("drama_id"))
    return A.episodes(spark, sf).join(mine, "drama_id", "left_semi").select("id")


@query("+p AS (SELECT episode_id, min(start_ms) + 3000000 AS t FROM cues GROUP BY episode_id) SELECT p.episode_id, arg_min(c.id, c.start_ms) AS cue_id FROM p JOIN cues c ON c.episode_id = p.episode_id AND c.start_ms <= t AND t < c.end_ms GROUP BY p.episode_id")
def flt_11_cue_at_time(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf)
    points = c.groupBy("episode_id").agg((F.min("start_ms") + 3_000_000).alias("t"))
    return c.join(points, "episode_id").where("start_ms <= t AND t < end_ms").groupBy("episode_id").agg(F.min_by("id", "start_ms").alias("cue_id"))


@query("SELECT id, CASE WHEN name <> '' AND NOT contains(name, '/dub/') AND NOT contains(name, '5') THEN name ELSE user_id || '/' || id || '.mp4' END AS video_file FROM dramas")
def prj_2_video_file(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    return A.dramas(spark, sf).select("id", F.when((n != "") & ~n.contains("/dub/") & ~n.contains("5"), n).otherwise(F.format_string("%d/%d.mp4", "user_id", "id")).alias("video_file"))


@query("SELECT e.id, e.number, d.name, d.user_id FROM episodes e JOIN dramas d ON d.id = e.drama_id")
def jn_1_episode_drama(spark: SparkSession, sf: str) -> DataFrame:
    d = A.dramas(spark, sf).select(F.col("id").alias("drama_id"), "name", "user_id")
    return A.episodes(spark, sf).join(d, "drama_id").select("id", "number", "name", "user_id")


@query("SELECT t.id, t.type, e.number FROM tasks t JOIN episodes e ON e.id = t.episode_id")
def jn_2_task_events(spark: SparkSession, sf: str) -> DataFrame:
    e = A.episodes(spark, sf).select(F.col("id").alias("episode_id"), "number")
    return A.tasks(spark, sf).join(e, "episode_id").select("id", "type", "number")


@query("SELECT u.uid, u.episode_id, c.id, c.start_ms, e.status FROM utterances u JOIN cues c ON c.episode_id = u.episode_id AND c.id // 7 = u.uid JOIN episodes e ON e.id = c.episode_id")
def jn_3_4_5_cues_of_utterances(spark: SparkSession, sf: str) -> DataFrame:
    u = A.utterances(spark, sf).select("uid", "episode_id")
    c = A.cues(spark, sf).select("episode_id", "id", "start_ms", F.floor(F.col("id") / 7).alias("uid"))
    e = A.episodes(spark, sf).select(F.col("id").alias("episode_id"), "status")
    return u.join(c, ["episode_id", "uid"]).join(e, "episode_id").select("uid", "episode_id", "id", "start_ms", "status")


@query("SELECT d.id, count(e.id) AS n, max(e.number) AS last FROM dramas d LEFT JOIN episodes e ON e.drama_id = d.id GROUP BY d.id")
def jn_6_left_outer(spark: SparkSession, sf: str) -> DataFrame:
    e = A.episodes(spark, sf).groupBy("drama_id").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("last"))
    return A.dramas(spark, sf).join(e, F.col("id") == F.col("drama_id"), "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "last")


@query("+g(id, drama_id, src) AS (VALUES (1, 1, 'a'), (2, 999999999, 'b'), (3, NULL, 'c')) SELECT g.id, g.src, d.name FROM g LEFT JOIN dramas d ON d.id = g.drama_id")
def jn_7_glossary_dramas(spark: SparkSession, sf: str) -> DataFrame:
    g = spark.createDataFrame([(1, 1, "a"), (2, 999999999, "b"), (3, None, "c")], "id int, drama_id long, src string")
    d = A.dramas(spark, sf).select(F.col("id").alias("drama_id"), "name")
    return g.join(d, "drama_id", "left").select("id", "src", "name")


@query("SELECT id FROM roles WHERE role_type = 'lead' OR id IN (SELECT role_id FROM cues WHERE role_id IS NOT NULL)")
def jn_8_prune_unused(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.snapshots import prune

    r = A.roles(spark, sf)
    return prune(r, r.where("role_type = 'lead'").select("id"), "id", A.cues(spark, sf), "role_id").select("id")


@query("SELECT id FROM cues WHERE episode_id IN (SELECT id FROM episodes WHERE status = 'ready')")
def jn_9_semi(spark: SparkSession, sf: str) -> DataFrame:
    ready = A.episodes(spark, sf).where("status = 'ready'").select(F.col("id").alias("episode_id"))
    return A.cues(spark, sf).join(ready, "episode_id", "left_semi").select("id")


@query("SELECT DISTINCT e.id FROM episodes e JOIN cues c ON c.episode_id = e.id JOIN dramas d ON d.id = e.drama_id WHERE d.user_id < 12")
def jn_10_agg_6_distinct_episodes(spark: SparkSession, sf: str) -> DataFrame:
    mine = A.dramas(spark, sf).where("user_id < 12").select(F.col("id").alias("drama_id"))
    return A.episodes(spark, sf).join(A.cues(spark, sf).select(F.col("episode_id").alias("id")), "id", "left_semi").join(mine, "drama_id", "left_semi").select("id")


@query("SELECT c.id, coalesce(r.name, c.role_id::VARCHAR, '-') AS voice FROM cues c LEFT JOIN roles r ON r.id = c.role_id")
def jn_12_lookup_with_default(spark: SparkSession, sf: str) -> DataFrame:
    r = A.roles(spark, sf).select(F.col("id").alias("role_id"), "name")
    return A.cues(spark, sf).join(r, "role_id", "left").select("id", F.coalesce("name", F.col("role_id").cast("string"), F.lit("-")).alias("voice"))


@query("+s AS (SELECT episode_id, coalesce(role_id, 2) AS role_id, role_id IS NULL AS bare FROM cues WHERE kind = 'speech') SELECT s.episode_id, coalesce(string_agg(DISTINCT CASE WHEN r.voice_type IS NULL THEN r.name END, ',' ORDER BY CASE WHEN r.voice_type IS NULL THEN r.name END), '') AS missing, count(*) FILTER (bare) AS unassigned FROM s JOIN roles r ON r.id = s.role_id GROUP BY s.episode_id")
def jn_12b_preflight(spark: SparkSession, sf: str) -> DataFrame:
    s = A.cues(spark, sf).where("kind = 'speech'").select("episode_id", F.coalesce("role_id", F.lit(2)).alias("role_id"), F.col("role_id").isNull().alias("bare"))
    r = A.roles(spark, sf).select(F.col("id").alias("role_id"), "name", "voice_type")
    missing = F.when(F.col("voice_type").isNull(), F.col("name"))
    return s.join(r, "role_id").groupBy("episode_id").agg(F.array_join(F.sort_array(F.collect_set(missing)), ",").alias("missing"), F.count_if("bare").alias("unassigned"))


@query("+o AS (SELECT name, user_id, id, row_number() OVER (ORDER BY name DESC, id) AS r FROM dramas) SELECT name, user_id, id FROM o WHERE r BETWEEN 21 AND 40")
def srt_1_2_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.page(A.dramas(spark, sf).select("name", "user_id", "id"), {"name": F.desc("name"), "id": F.desc("id")}, "name", "id", 2, 0)



@query("SELECT type, min(id) AS id FROM tasks WHERE status = 'pending' GROUP BY type")
def srt_3_claim_first(spark: SparkSession, sf: str) -> DataFrame:
    return A.tasks(spark, sf).where("status = 'pending'").groupBy("type").agg(F.min("id").alias("id"))


@query("SELECT id, status, updated_at FROM episodes ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'review' THEN 1 WHEN 'failed' THEN 2 WHEN 'succeeded' THEN 3 ELSE 4 END, updated_at DESC, id LIMIT 3")
def srt_4_most_urgent(spark: SparkSession, sf: str) -> DataFrame:
    urgent = F.expr("CASE status WHEN 'running' THEN 0 WHEN 'review' THEN 1 WHEN 'failed' THEN 2 WHEN 'succeeded' THEN 3 ELSE 4 END")
    return A.episodes(spark, sf).orderBy(urgent, F.desc("updated_at"), "id").limit(3).select("id", "status", "updated_at")


@query("SELECT drama_id, string_agg(name, '|' ORDER BY CASE role_type WHEN 'lead' THEN 0 WHEN 'supporting' THEN 1 WHEN 'extra' THEN 2 WHEN 'narrator' THEN 3 ELSE 4 END, name, id) AS names FROM roles GROUP BY drama_id")
def srt_5_roles_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    prio = F.expr("CASE role_type WHEN 'lead' THEN 0 WHEN 'supporting' THEN 1 WHEN 'extra' THEN 2 WHEN 'narrator' THEN 3 ELSE 4 END")
    g = A.roles(spark, sf).groupBy("drama_id").agg(F.sort_array(F.collect_list(F.struct(prio.alias("p"), F.collate("name", "zh").alias("name"), "id"))).alias("r"))
    return g.select("drama_id", F.array_join(F.transform("r", lambda x: F.collate(x["name"], "UTF8_BINARY")), "|").alias("names"))


@query("SELECT role_id, arg_min(id, abs(end_ms - start_ms - 5000000) * 1000000 + id) AS id FROM cues WHERE kind = 'speech' AND role_id IS NOT NULL GROUP BY role_id")
def srt_6_best_sample(spark: SparkSession, sf: str) -> DataFrame:
    off = F.abs(F.col("end_ms") - F.col("start_ms") - 5_000_000)
    return A.cues(spark, sf).where("kind = 'speech' AND role_id IS NOT NULL").groupBy("role_id").agg(F.min_by("id", F.struct(off, "id")).alias("id"))


@query("SELECT id, coalesce(try_cast(regexp_extract(context, '(\\d+)', 1) AS BIGINT), 0) AS n, row_number() OVER (PARTITION BY episode_id ORDER BY coalesce(try_cast(regexp_extract(context, '(\\d+)', 1) AS BIGINT), 0) DESC, id DESC) AS place FROM tasks")
def srt_7_8_numeric_and_newest(spark: SparkSession, sf: str) -> DataFrame:
    n = F.coalesce(F.expr("try_cast(regexp_extract(context, '([0-9]+)', 1) AS BIGINT)"), F.lit(0))
    t = A.tasks(spark, sf).withColumn("n", n)
    return t.select("id", "n", F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("n"), F.desc("id"))).cast("long").alias("place"))


@query("SELECT doc_id, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || '...' ELSE text END AS text FROM documents")
def srt_9_cut(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return A.table(spark, sf, "documents").select("doc_id", F.when(F.length(t) > 5000, F.concat(F.substring(t, 1, 5000), F.lit("..."))).otherwise(t).alias("text"))


@query("SELECT id FROM cues WHERE id % 3 <> 0 EXCEPT SELECT id FROM cues WHERE id % 5 = 1")
def set_1_deletions(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf).select("id")
    return c.where("id % 3 <> 0").join(c.where("id % 5 = 1"), "id", "left_anti")


@query("SELECT DISTINCT w FROM (SELECT unnest(string_split(name, ' ')) AS w FROM roles) WHERE w NOT IN ('ring', 'bolt')")
def set_3_missing_names(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("ring",), ("bolt",)], "w string")
    return A.roles(spark, sf).select(F.explode(F.split("name", " ")).alias("w")).distinct().join(F.broadcast(known), "w", "left_anti")


@query("SELECT DISTINCT id, status FROM tasks WHERE status <> 'pending'")
def set_4_stm_3_changes(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.feed import changes

    return changes(A.tasks(spark, sf)).select("id", "status")


@query("SELECT c.id, CASE WHEN c.id = t.id OR (c.speaker = t.speaker AND c.speaker <> '' AND c.role_id IS NULL) THEN 9 ELSE c.role_id END AS role_id FROM cues c JOIN (SELECT episode_id, arg_min(id, id) AS id, arg_min(speaker, id) AS speaker FROM cues GROUP BY episode_id) t USING (episode_id)")
def set_5_batch_role(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf).select("episode_id", "id", "speaker", "role_id")
    t = c.groupBy("episode_id").agg(F.min("id").alias("first"), F.min_by("speaker", "id").alias("by"))
    hit = (F.col("id") == F.col("first")) | ((F.col("speaker") == F.col("by")) & (F.col("speaker") != "") & F.col("role_id").isNull())
    return c.join(t, "episode_id").select("id", F.when(hit, F.lit(9).cast("long")).otherwise(F.col("role_id")).alias("role_id"))
