"""Cues in time: merging, extending, fitting, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashes, rates
from ..functions.text import strip
from ..operators import snapshots, timeline
from ..sources import adapters as A
from .registry import query

#: The events are minutes apart, so the limits are in hours here.
GAP, CAP = 48 * 3_600_000, 9 * 3_600_000 * 24

_MERGE = f"""+o AS (SELECT *, lag(role_id) OVER w AS pr, lag(speaker) OVER w AS ps, lag(emotion) OVER w AS pe, lag(end_ms) OVER w AS pend, row_number() OVER w AS rn FROM cues WINDOW w AS (PARTITION BY episode_id ORDER BY start_ms, id)),
j AS (SELECT *, coalesce(((role_id IS NOT NULL AND pr IS NOT NULL AND role_id = pr) OR (role_id IS NULL AND pr IS NULL AND speaker = ps)) AND emotion = pe AND start_ms - pend <= {GAP}, false) AS joins FROM o),
fold AS (SELECT episode_id, rn, id, id AS head_id, start_ms AS first FROM j WHERE rn = 1
  UNION ALL SELECT j.episode_id, j.rn, j.id, CASE WHEN j.joins AND j.end_ms - f.first <= {CAP} THEN f.head_id ELSE j.id END, CASE WHEN j.joins AND j.end_ms - f.first <= {CAP} THEN f.first ELSE j.start_ms END
  FROM fold f JOIN j ON j.episode_id = f.episode_id AND j.rn = f.rn + 1)"""




def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.merge_cues(A.cues(spark, sf), GAP, CAP)


@query(_MERGE + " SELECT episode_id, head_id, id FROM fold")
def win_3_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


@query(_MERGE + """ SELECT f.episode_id, f.head_id, count(*) AS n_cues, string_agg(c.text, '' ORDER BY c.start_ms, c.id) AS text, coalesce(string_agg(nullif(trim(c.text_en), ''), ' ' ORDER BY c.start_ms, c.id), '') AS text_en,
  min(c.start_ms) AS start_ms, arg_max(c.end_ms, c.start_ms) AS end_ms FROM fold f JOIN cues c USING (id) GROUP BY f.episode_id, f.head_id""")
def agg_8_9_utterance_spans(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.utterance_spans(_merged(spark, sf), A.cues(spark, sf))


@query(_MERGE + """, g AS (SELECT episode_id, head_id, list(id ORDER BY id) AS ids FROM fold GROUP BY ALL), e AS (SELECT episode_id, uid, list(id ORDER BY id) AS ids FROM (SELECT episode_id, id // 7 AS uid, id FROM cues) GROUP BY ALL)
  SELECT g.head_id, e.uid, CASE WHEN e.uid IS NULL THEN 'insert' WHEN g.head_id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM g FULL JOIN e ON g.episode_id = e.episode_id AND g.ids = e.ids""")
def jn_13_set_2_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array_sort(F.collect_list("id")).alias("ids")
    new = _merged(spark, sf).groupBy("episode_id", "head_id").agg(ids)
    old = A.cues(spark, sf).groupBy("episode_id", F.floor(F.col("id") / 7).alias("uid")).agg(ids)
    action = F.when(F.col("uid").isNull(), "insert").when(F.col("head_id").isNull(), "delete").otherwise("keep")
    return new.join(old, ["episode_id", "ids"], "full_outer").select("head_id", "uid", action.alias("action"))


@query(_MERGE + """, g AS (SELECT f.episode_id, f.head_id, list(c.id ORDER BY c.id) AS ids, string_agg(c.text, '' ORDER BY c.start_ms, c.id) AS text, first(c.speaker ORDER BY c.start_ms, c.id) AS speaker, first(c.role_id ORDER BY c.start_ms, c.id) AS role_id,
  first(c.emotion ORDER BY c.start_ms, c.id) AS emotion, first(c.kind ORDER BY c.start_ms, c.id) AS kind, substr(sha256(string_agg(c.text || '|' || c.start_ms || '|' || c.end_ms || '|' || c.emotion, '|' ORDER BY c.start_ms, c.id)), 1, 16) AS now FROM fold f JOIN cues c USING (id) GROUP BY f.episode_id, f.head_id),
e AS (SELECT episode_id, uid, list(id ORDER BY id) AS ids FROM (SELECT episode_id, id // 7 AS uid, id FROM cues) GROUP BY ALL)
SELECT g.episode_id, g.head_id, u.uid, g.text, g.speaker, g.role_id, g.emotion, g.kind, CASE WHEN u.source_hash = g.now THEN u.source_hash END AS source_hash, u.text_en, u.voice_hash
FROM g LEFT JOIN e ON g.episode_id = e.episode_id AND g.ids = e.ids LEFT JOIN utterances u ON u.episode_id = e.episode_id AND u.uid = e.uid""")
def jn_13_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    links = A.cues(spark, sf).select("episode_id", F.floor(F.col("id") / 7).alias("uid"), F.col("id").alias("cue_id"))
    stored = A.utterances(spark, sf).select("episode_id", "uid", "source_hash", "text_en", "voice_hash")
    return timeline.reconcile(_merged(spark, sf), A.cues(spark, sf), stored, links)


@query("SELECT episode_id, id, type, status FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, type ORDER BY id DESC) AS r FROM tasks) WHERE r = 1")
def win_1_2_latest(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.workflow import latest

    return latest(A.tasks(spark, sf).select("episode_id", "type", "id", "status"), "episode_id", "type")


@query("""SELECT id, CASE WHEN nx IS NULL THEN wanted ELSE greatest(end_ms, least(wanted, nx - 200)) END AS new_end FROM
  (SELECT id, end_ms, greatest(end_ms, start_ms + 1200, end_ms + 200) AS wanted, lead(start_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, id) AS nx FROM lines)""")
def win_5_end_extension(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.extend_ends(A.lines(spark, sf)).select("id", "new_end")


@query("""+g AS (SELECT id, end_ms, end_ms - start_ms AS budget, lead(start_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, id) - end_ms AS gap FROM cues),
b AS (SELECT *, CASE WHEN gap > 0 THEN greatest(0, gap - 60) WHEN 1722000000000 - end_ms > 0 THEN 1722000000000 - end_ms ELSE 500 END AS base FROM g)
SELECT id, gap, CASE WHEN budget < 900 THEN greatest(base, least(900 - budget, 800)) ELSE base END AS allow_extend FROM b""")
def win_6_allow_extend(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.extension_allowance(A.cues(spark, sf), F.lit(1_722_000_000_000)).select("id", "gap", "allow_extend")


@query("""SELECT id, least(greatest(id % 400, 0), greatest(0, least(200, coalesce(lead(start_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, id) - end_ms - 60, 200)))) AS extend FROM cues""")
def win_7_extension(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.needed_extension(A.cues(spark, sf), F.col("id") % 400).select("id", "extend")


@query("+f AS (SELECT episode_id, role_id, min(start_ms * 100000 + id % 100000) AS o, max(start_ms * 100000 + id % 100000) AS l FROM cues GROUP BY ALL) SELECT episode_id, role_id, row_number() OVER (PARTITION BY episode_id ORDER BY o) AS place, row_number() OVER (PARTITION BY episode_id ORDER BY l DESC) AS recent, (row_number() OVER (PARTITION BY episode_id ORDER BY o) - 1) % 12 AS colour FROM f")
def win_8_9_appearance(spark: SparkSession, sf: str) -> DataFrame:
    o = F.struct("start_ms", "id")
    f = A.cues(spark, sf).groupBy("episode_id", "role_id").agg(F.min(o).alias("o"), F.max(o).alias("l"))
    at = lambda c: F.row_number().over(Window.partitionBy("episode_id").orderBy(c)).cast("long")
    return f.select("episode_id", "role_id", at(F.col("o")).alias("place"), at(F.desc("l")).alias("recent"), ((at(F.col("o")) - 1) % 12).alias("colour"))


@query("+m AS (SELECT episode_id, speaker, max(id) AS id FROM cues GROUP BY ALL) SELECT episode_id, speaker, id FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY id DESC) AS r FROM m) WHERE r <= 5")
def win_10_most_recent(spark: SparkSession, sf: str) -> DataFrame:
    m = A.cues(spark, sf).groupBy("episode_id", "speaker").agg(F.max("id").alias("id"))
    return m.withColumn("r", F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("id")))).where("r <= 5").drop("r")


@query("+n AS (SELECT id, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, id) AS r FROM cues WHERE text_en <> '') SELECT c.id, (n.r - 1) // 50 AS batch, coalesce(CASE WHEN n.id IS NOT NULL THEN upper(c.text_en) END, '') AS result FROM cues c LEFT JOIN n USING (id)")
def win_14_batches(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("episode_id").orderBy("start_ms", "id")
    filled = F.sum((F.col("text_en") != "").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    on = F.col("text_en") != ""
    return A.cues(spark, sf).withColumn("n", filled).select("id", F.when(on, F.floor((F.col("n") - 1) / 50)).alias("batch"), F.when(on, F.upper("text_en")).otherwise(F.lit("")).alias("result"))


_MARKED = "CASE WHEN {s} = c.speaker AND {e} <> 'neutral' AND {e} <> '' THEN {e} END"
_FILLED = f"coalesce(c.e, {_MARKED.format(s='p.speaker', e='p.e1')}, {_MARKED.format(s='c.s1', e='c.n1')}, {_MARKED.format(s='p.s2', e='p.e2')}, {_MARKED.format(s='c.s2', e='c.n2')}, 'neutral')"


@query(f"""+c AS (SELECT episode_id, id, speaker, e, row_number() OVER w AS r, lead(speaker, 1) OVER w AS s1, lead(e, 1) OVER w AS n1, lead(speaker, 2) OVER w AS s2, lead(e, 2) OVER w AS n2
  FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN emotion END AS e FROM cues) WINDOW w AS (PARTITION BY episode_id ORDER BY start_ms, id)),
p AS (SELECT episode_id, 0::BIGINT AS r, NULL::BIGINT AS id, NULL::VARCHAR AS speaker, NULL::VARCHAR AS e1, NULL::VARCHAR AS s2, NULL::VARCHAR AS e2 FROM c WHERE r = 1
  UNION ALL SELECT c.episode_id, c.r, c.id, c.speaker, {_FILLED}, p.speaker, p.e1 FROM p JOIN c ON c.episode_id = p.episode_id AND c.r = p.r + 1)
SELECT episode_id, id, e1 AS filled FROM p WHERE r > 0""")
def win_4_emotion_fill(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf).withColumn("emotion", F.when(F.col("id") % 3 != 0, F.col("emotion")))
    return timeline.fill_emotions(c)


@query("SELECT episode_id, uid, current FROM utterances")
def inc_1_source_hash(spark: SparkSession, sf: str) -> DataFrame:
    return A.utterances(spark, sf).select("episode_id", "uid", "current")


@query("SELECT id, substr(sha256(text_en || '|' || coalesce(role_id::VARCHAR, '_default') || '|' || emotion), 1, 16) AS h FROM cues")
def inc_2_voice_hash(spark: SparkSession, sf: str) -> DataFrame:
    return A.cues(spark, sf).select("id", hashes.voice_hash("text_en", "role_id", "emotion").alias("h"))


@query("+b AS (SELECT episode_id, id // 7 AS uid, bool_or(trim(text_en) = '') AS blank FROM cues GROUP BY ALL) SELECT u.episode_id, u.uid FROM utterances u JOIN b USING (episode_id, uid) WHERE coalesce(source_hash, '') = '' OR source_hash <> current OR blank")
def inc_3_dirty_translate(spark: SparkSession, sf: str) -> DataFrame:
    b = A.cues(spark, sf).groupBy("episode_id", F.floor(F.col("id") / 7).alias("uid")).agg(F.bool_or(strip(F.col("text_en")) == "").alias("blank"))
    h = F.coalesce("source_hash", F.lit(""))
    return A.utterances(spark, sf).join(b, ["episode_id", "uid"]).where((h == "") | (h != F.col("current")) | F.col("blank")).select("episode_id", "uid")


@query("SELECT episode_id, uid FROM utterances WHERE kind <> 'sing' AND text_en <> '' AND voice_hash IS DISTINCT FROM substr(sha256(text_en || '|' || coalesce(role_id::VARCHAR, '_default') || '|' || emotion), 1, 16)")
def inc_4_dirty_voice(spark: SparkSession, sf: str) -> DataFrame:
    now = hashes.voice_hash("text_en", "role_id", "emotion")
    return A.utterances(spark, sf).where((F.col("kind") != "sing") & (F.col("text_en") != "") & ~F.col("voice_hash").eqNullSafe(now)).select("episode_id", "uid")


@query("SELECT episode_id, uid, upper(text_en) AS text_en, CASE WHEN upper(text_en) <> text_en THEN '' ELSE voice_hash END AS voice_hash FROM utterances")
def inc_5_cache_sync(spark: SparkSession, sf: str) -> DataFrame:
    new = F.upper("text_en")
    return A.utterances(spark, sf).select("episode_id", "uid", new.alias("text_en"), F.when(new != F.col("text_en"), F.lit("")).otherwise(F.col("voice_hash")).alias("voice_hash"))


_DIFF = """+o AS (SELECT id, episode_id, text, start_ms, end_ms, emotion, kind, role_id, text_en FROM cues WHERE id % 10 <> 3),
n AS (SELECT id, episode_id, text, CASE WHEN id % 20 = 6 THEN 'sad' ELSE emotion END AS emotion, CASE WHEN id % 20 = 7 THEN 'sing' ELSE kind END AS kind, CASE WHEN id % 10 = 1 THEN start_ms + 5 ELSE start_ms END AS start_ms, end_ms, CASE WHEN id % 10 IN (1, 2) THEN 77 ELSE role_id END AS role_id, CASE WHEN id % 10 = 5 THEN 'new' ELSE text_en END AS text_en FROM cues WHERE id % 10 <> 4),
k AS (SELECT coalesce(o.id, n.id) AS id, coalesce(o.episode_id, n.episode_id) AS episode_id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN o.text <> n.text OR o.start_ms <> n.start_ms OR o.end_ms <> n.end_ms OR o.emotion <> n.emotion OR o.kind <> n.kind THEN 'source' WHEN o.role_id IS DISTINCT FROM n.role_id THEN 'role' WHEN o.text_en <> n.text_en THEN 'target' ELSE 'none' END AS change FROM o FULL JOIN n ON o.id = n.id)"""


@query(_DIFF + " SELECT id, change, CASE WHEN change IN ('insert', 'delete', 'source') THEN 'source_review' WHEN change = 'role' THEN 'tts' WHEN change = 'target' THEN 'translation_review' END AS restart FROM k")
def inc_6_jn_14_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).select("id", "change", "restart")


@query(_DIFF + " SELECT episode_id, CASE WHEN bool_or(change IN ('insert', 'delete', 'source')) THEN 'source_review' WHEN bool_or(change = 'role') THEN 'tts' WHEN bool_or(change = 'target') THEN 'translation_review' END AS restart FROM k GROUP BY episode_id")
def inc_6_episode_restart(spark: SparkSession, sf: str) -> DataFrame:
    episodes = A.cues(spark, sf).select("id", "episode_id")
    return snapshots.restarts(_diff(spark, sf).join(episodes, "id"), "episode_id")


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    """A stored snapshot of cues and an edited one, compared."""
    c = A.cues(spark, sf).select("id", "text", "start_ms", "end_ms", "emotion", "kind", "role_id", "text_en")
    m = F.col("id") % 10
    new = c.where("id % 10 <> 4").withColumns({"start_ms": F.when(m == 1, F.col("start_ms") + 5).otherwise(F.col("start_ms")), "role_id": F.when(m.isin(1, 2), F.lit(77).cast("long")).otherwise(F.col("role_id")), "text_en": F.when(m == 5, F.lit("new")).otherwise(F.col("text_en")), "emotion": F.when(F.col("id") % 20 == 6, F.lit("sad")).otherwise(F.col("emotion")), "kind": F.when(F.col("id") % 20 == 7, F.lit("sing")).otherwise(F.col("kind"))})
    return snapshots.classify(c.where("id % 10 <> 3"), new, "id", ["text", "start_ms", "end_ms", "emotion", "kind"], "role_id", "text_en")


@query("SELECT id, substr(sha256('e1|v2|' || trim(regexp_replace(text_en, ' +', ' ', 'g')) || '|' || coalesce(role_id::VARCHAR, '') || '|en'), 1, 16) AS synthesis, substr(sha256(coalesce(role_id::VARCHAR, '') || '|' || trim(text_en) || '|' || emotion), 1, 16) AS preview FROM cues")
def inc_10_11_cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import normalize

    key = hashes.short_hash(F.lit("e1"), F.lit("v2"), normalize(F.col("text_en")), "role_id", F.lit("en"))
    return A.cues(spark, sf).select("id", key.alias("synthesis"), hashes.short_hash("role_id", strip(F.col("text_en")), "emotion").alias("preview"))


_W = "(end_ms - start_ms)"


@query(f"+r AS (SELECT id, text, CASE WHEN {_W} > 0 THEN length(text) / ({_W} / 1000.0::DOUBLE) ELSE 0 END AS rate, {_W} AS w FROM lines) SELECT id, round(rate, 6) AS rate, CASE WHEN rate >= 5.5 THEN 1.0 WHEN rate >= 4 THEN 1.15 ELSE 1.2 END::DOUBLE AS k, round(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) * 1000.0::DOUBLE / 14, 6) AS spoken, CASE WHEN w > 0 THEN greatest(1, floor(w / 1000.0::DOUBLE * 14))::BIGINT ELSE 0 END AS max_chars FROM r")
def mth_1_to_5_rates(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("end_ms") - F.col("start_ms")
    rate = rates.speech_rate(F.length("text"), w)
    return A.lines(spark, sf).select("id", F.round(rate, 6).alias("rate"), rates.budget_factor(rate).cast("double").alias("k"), F.round(rates.spoken_ms(F.col("text")), 6).alias("spoken"), rates.max_chars(w).alias("max_chars"))


_FIT = """+p AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_quantity * 100)::BIGINT AS trimmed, (l_partkey % 4000) + 100 AS budget, l_suppkey % 3 * 200 AS ext FROM lineitem),
f AS (SELECT *, CASE WHEN trimmed <= budget THEN 'success' WHEN trimmed <= 1.3::DOUBLE * budget THEN 'rate_adjusted' WHEN ext > 0 AND trimmed <= budget + ext THEN 'extended' WHEN ext > 0 AND trimmed <= 1.3::DOUBLE * (budget + ext) THEN 'extended+' ELSE 'failed' END AS s FROM p),
x AS (SELECT id, rtrim(s, '+') AS status, CASE s WHEN 'success' THEN 1 WHEN 'rate_adjusted' THEN trimmed / budget WHEN 'extended' THEN 1 WHEN 'extended+' THEN trimmed / (budget + ext) ELSE trimmed / greatest(budget, 1) END::DOUBLE AS rate,
  CASE WHEN s IN ('success', 'rate_adjusted') THEN budget WHEN s = 'failed' THEN trimmed ELSE budget + ext END AS final_ms FROM f)"""


def _fitted(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 100).cast("long").alias("trimmed"), (F.col("l_partkey") % 4000 + 100).alias("budget"), (F.col("l_suppkey") % 3 * 200).alias("ext"))
    return p.select("id", rates.fit(F.col("trimmed"), F.col("budget"), F.col("ext")).alias("f")).select("id", "f.*")


@query(_FIT + " SELECT id, status, round(rate, 6) AS rate, final_ms FROM x")
def mth_8_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf).withColumn("rate", F.round("rate", 6))


@query(_FIT + " SELECT count(*) AS total, count(*) FILTER (status <> 'failed') AS success, count(*) FILTER (status = 'failed') AS failed, bool_and(status <> 'failed') AS all_succeeded, count(*) FILTER (status = 'extended') AS extended FROM x")
def agg_10_16_report(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("status") == "failed"
    return _fitted(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("failed"), F.bool_and(~bad).alias("all_succeeded"), F.count_if(F.col("status") == "extended").alias("extended"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity <= w THEN 'padding' WHEN l_quantity <= l_suppkey % 40 THEN 'overflow_allowed' WHEN q >= 0.8 THEN 'safe' WHEN q >= 0.625 THEN 'moderate' WHEN q >= 0.5 AND l_tax > 0.04 THEN 'aggressive' ELSE 'hard_cut' END AS tier FROM (SELECT *, l_partkey % 50 + 1 AS w, (l_partkey % 50 + 1) / l_quantity::DOUBLE AS q FROM lineitem)""")
def mth_9_tiers(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), rates.alignment_tier(F.col("l_quantity"), F.col("l_partkey") % 50 + 1, F.col("l_tax") > 0.04, F.lit(100), F.col("l_suppkey") % 40 + 100).alias("tier"))


@query("SELECT id, start_ms, greatest(0, start_ms - 100) AS pad_start, least(1722000000000, end_ms + 100) AS pad_end, abs(end_ms - start_ms - 600000) > 50 AS mismatch FROM cues WHERE kind = 'sing'")
def mth_13_14_16_sing_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf).where("kind = 'sing'")
    return c.select("id", "start_ms", F.greatest(F.lit(0), F.col("start_ms") - 100).alias("pad_start"), F.least(F.lit(1_722_000_000_000), F.col("end_ms") + 100).alias("pad_end"), (F.abs(F.col("end_ms") - F.col("start_ms") - 600_000) > 50).alias("mismatch"))


@query("SELECT id, round(n / greatest(p, 1), 6) AS drift FROM (SELECT id, (end_ms - start_ms)::DOUBLE AS n, (id % 90 + 10) * 10000 AS p FROM cues) WHERE n / greatest(p, 1) > 1.1")
def mth_12_drift(spark: SparkSession, sf: str) -> DataFrame:
    drift = (F.col("end_ms") - F.col("start_ms")).cast("double") / ((F.col("id") % 90 + 10) * 10_000)
    return A.cues(spark, sf).select("id", F.round(drift, 6).alias("drift"), drift.alias("_d")).where("_d > 1.1").drop("_d")
