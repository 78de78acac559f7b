"""Folds and text walks within a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, parse, rates, segments
from ..operators import glossary, intervals, snapshots, stored
from ..sources import adapters as A
from ..sources.shared import shared_path
from .registry import query


def _each(df: DataFrame, of: str) -> DataFrame:
    """The structs of an array that costs much. A plain explode lets Spark ask first, by a filter further below,
    whether there are any, which runs the function twice."""
    return df.select("id", F.explode_outer(of).alias("s")).where("s IS NOT NULL").select("id", "s.*")


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""+c AS (SELECT id, start_ms AS s, end_ms AS e, {_TRIM.format("text")} AS whole FROM lines WHERE {_TRIM.format("text")} <> '' AND end_ms > start_ms),
w AS (SELECT *, string_split(regexp_replace(whole, '\s+', ' ', 'g'), ' ') AS words FROM c WHERE e - s >= 1500),
n AS (SELECT *, greatest(8, least(12, floor(len(words) / greatest(1.0::DOUBLE, (e - s) / 2000.0::DOUBLE))))::BIGINT AS per FROM w),
p AS (SELECT id, s, e, whole, CASE WHEN regexp_matches(whole, '[,.?!—;:]')
  THEN list_filter(list_transform(regexp_extract_all(whole, '[^,.?!—;:]*[,.?!—;:]|[^,.?!—;:]+'), lambda x: {_TRIM.format("x")}), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}_]'))
  ELSE list_transform(range((len(words) - 1) // per + 1), lambda i: array_to_string(words[i * per + 1:i * per + per], ' ')) END AS parts FROM n),
q AS (SELECT id, s, e, CASE WHEN len(parts) > 0 THEN parts ELSE [whole] END AS parts FROM p),
k AS (SELECT *, list_transform(parts, lambda x: len(string_split(regexp_replace(x, '\s+', ' ', 'g'), ' ')) / 2.5::DOUBLE * 1000) AS weights FROM q),
t AS (SELECT *, (e - s) / list_reduce(list_prepend(0.0::DOUBLE, weights), lambda a, b: a + b) AS ms FROM k),
ax AS (SELECT id, 0::BIGINT AS i, s AS a, s AS b FROM t UNION ALL
  SELECT id, i + 1, b, CASE WHEN i + 1 = len(parts) THEN e ELSE least(e, floor(b + weights[i + 1] * ms)::BIGINT) END FROM ax JOIN t USING (id) WHERE i < len(parts)),
h AS (SELECT id, i, a, b, parts[i] AS text, count(*) FILTER (i = 1 OR b - a >= 500) OVER (PARTITION BY id ORDER BY i) AS g FROM ax JOIN t USING (id) WHERE i > 0),
f AS (SELECT *, max(g) OVER (PARTITION BY id) AS n_groups, max(b) FILTER (g = 1) OVER (PARTITION BY id) - min(a) OVER (PARTITION BY id) AS first_ms FROM h)
SELECT id, min(a) AS start_ms, max(b) AS end_ms, string_agg(text, ' ' ORDER BY i) AS text FROM f GROUP BY id, CASE WHEN g = 1 AND n_groups > 1 AND first_ms < 500 THEN 2 ELSE g END
UNION ALL SELECT id, s, e, whole FROM c WHERE e - s < 1500""")
def win_12_13_mth_15_resegment(spark: SparkSession, sf: str) -> DataFrame:
    x = A.lines(spark, sf)
    return _each(x.select("id", segments.resegment(F.col("text"), F.col("start_ms"), F.col("end_ms")).alias("s")), "s")


_SPOKEN = r"""+s AS (SELECT id, i, substr(text, i, 1) AS c, coalesce(sum((substr(text, i, 1) IN ('。', '！', '？', '!', '?'))::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM (SELECT id, text, unnest(generate_series(1, length(text))) AS i FROM lines)),
x AS (SELECT *, NOT regexp_matches(c, '[，。！？、；："''（）…—\s,.!?-]') AS said FROM s)"""


@query(_SPOKEN + r""", g AS (SELECT id, k, min(i) FILTER (said) AS a, max(i) FILTER (said) AS b, regexp_replace(string_agg(c, '' ORDER BY i), '^\s+|\s+$', '', 'g') AS text FROM x GROUP BY id, k HAVING count(*) FILTER (said) > 0)
SELECT id, floor((a - 1) * 0.06::DOUBLE * 1000)::BIGINT AS start_ms, floor(b * 0.06::DOUBLE * 1000)::BIGINT AS end_ms, text FROM g""")
def win_15_align(spark: SparkSession, sf: str) -> DataFrame:
    x = A.lines(spark, sf)
    chars = F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("text"), (i * 0.06).alias("start"), ((i + 1) * 0.06).alias("end")))
    aligned = x.select("id", segments.align_sentences(segments.sentences(F.col("text")), chars).alias("aligned"))
    return _each(aligned, "aligned")


@query(_SPOKEN + r""", n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS j FROM x WHERE said), t AS (SELECT id, k, regexp_replace(string_agg(c, '' ORDER BY i), '^\s+|\s+$', '', 'g') AS text FROM x GROUP BY id, k)
SELECT id, t.text, round(avg(unicode(substr(l.text, j::INT, 1)) / 128.0::DOUBLE), 6) AS score FROM n JOIN t USING (id, k) JOIN lines l USING (id) GROUP BY id, k, t.text""")
def agg_17_str_26_arr_1_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of characters are made from a text's first ones: its sentences have fewer characters that are spoken."""
    x = A.lines(spark, sf).select("id", segments.sentences(F.col("text")).alias("t"), F.transform(F.split("text", ""), lambda c: F.ascii(c) / 128.0).alias("s"))
    scored = x.select("id", F.explode(segments.sentence_scores(F.col("t"), F.col("s"))).alias("s"))
    return scored.select("id", "s.text", F.round("s.score", 6).alias("score"))


@query("+u AS (SELECT id, episode_id, unnest(list_distinct(regexp_extract_all(text, 'thea|the|ing'))) AS name FROM lines) SELECT name, count(*) AS n, count(DISTINCT episode_id) AS n_groups, count(DISTINCT id) AS n_texts FROM u GROUP BY name")
def str_11_27_agg_13_names(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("the"), F.lit("thea"), F.lit("ing"))
    x = A.lines(spark, sf).withColumn("g", parse.guard_names("text", names))
    return glossary.name_report(x.select("id", "episode_id", F.col("g.names").alias("names")), "names")


@query("SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS h FROM events")
def inc_9_canonical_hash(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit('{ "z": null, "a": [], "k": '), F.from_json("props", "k long")["k"].cast("string"), F.lit(', "b": {"c": {}} }'))
    return A.table(spark, sf, "events").select("event_id", parse.canonical_hash(padded).alias("h"))


@query("SELECT id, CASE WHEN length(text) <= id % 200 THEN 'ok' WHEN length(text) // 2 <= id % 200 THEN 'compressed' ELSE 'truncated' END AS status, CASE WHEN length(text) <= id % 200 THEN length(text) WHEN length(text) // 2 <= id % 200 THEN length(text) // 2 ELSE id % 200 END AS n FROM (SELECT id, repeat('x', length(text) + 1) AS text FROM lines)")
def mth_7_length_fit(spark: SparkSession, sf: str) -> DataFrame:
    x = A.lines(spark, sf).select("id", F.repeat(F.lit("x"), F.length("text") + 1).alias("text"))
    short = F.expr("left(text, length(text) div 2)")
    f = x.select("id", rates.length_fit(F.col("text"), short, (F.col("id") % 200).cast("int")).alias("f"))
    return f.select("id", "f.status", F.length("f.text").cast("long").alias("n"))


@query("SELECT id, end_ms - start_ms < 800 AS loose FROM lines")
def mth_6_loose(spark: SparkSession, sf: str) -> DataFrame:
    return A.lines(spark, sf).select("id", rates.loose_allowed(F.col("end_ms") - F.col("start_ms"), F.col("text")).alias("loose"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 1.0 ELSE least(greatest(round_even(l_quantity / (l_partkey % 5 * 16), 1), 0.7), 1.3) END AS speed FROM lineitem")
def mth_10_speed(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rates.speed(F.col("l_quantity"), F.col("l_partkey") % 5 * 16).alias("speed"))


@query("SELECT id, speaker || '!' AS speaker, kind FROM cues")
def prj_1_4_writable(spark: SparkSession, sf: str) -> DataFrame:
    changes = {"speaker": F.concat("speaker", F.lit("!")), "kind": F.lit("no"), "unknown": F.lit(1)}
    return snapshots.update_fields(A.cues(spark, sf), changes, ("speaker", "unknown")).select("id", "speaker", "kind")


@query("SELECT id, '{\"speaker\":\"' || speaker || '\"' || CASE WHEN role_id IS NULL THEN '' ELSE ',\"role_id\":' || role_id END || '}' AS json FROM cues")
def jsn_3_4_snk_4_json(spark: SparkSession, sf: str) -> DataFrame:
    return A.cues(spark, sf).select("id", F.to_json(F.struct("speaker", "role_id")).alias("json"))


#: Lines of Chinese characters from the roles' names, a call before and one after a separator.
_HAN = ("abcdefghijklmnopqrstuvwxyz", "平安王老哥姐平小红老明哥师李老平姐安哥红王老明姐小哥")


@query("""+t AS (SELECT id, translate(name, 'abcdefghijklmnopqrstuvwxyz', '{1}') || ' <sep> ' || translate(reverse(name), 'abcdefghijklmnopqrstuvwxyz', '{1}') || '，老平' AS text FROM roles),
p AS (SELECT id, text, unnest(string_split(text, ' <sep> ')) AS part FROM t),
w AS (SELECT id, text, part, 4 AS n, unnest(regexp_extract_all(part, '[\u4e00-\u9fff]{{4}}')) AS word, unnest(range(len(regexp_extract_all(part, '[\u4e00-\u9fff]{{4}}')))) AS k FROM p
  UNION ALL SELECT id, text, part, 3, unnest(regexp_extract_all(part, '[\u4e00-\u9fff]{{3}}')), unnest(range(len(regexp_extract_all(part, '[\u4e00-\u9fff]{{3}}')))) FROM p),
c AS (SELECT id, text, word[:n - 1] AS name, k = 0 AND starts_with(part, word) AS first FROM w WHERE word[-1:] IN ('哥', '姐', '老')),
s AS (SELECT id, name, CASE WHEN name[-1:] IN ('哥', '姐', '老') THEN 60 ELSE 0 END + CASE WHEN first THEN 40 ELSE 0 END + CASE WHEN len(string_split(text, name)) > 2 THEN 40 ELSE 0 END + 10 AS score FROM c WHERE NOT contains(name, '老师') OR len(name) > 2)
SELECT t.id, coalesce(string_agg(DISTINCT name, ',' ORDER BY encode(name)), '') AS names FROM t LEFT JOIN s ON s.id = t.id AND score >= 100 GROUP BY t.id""".format(*_HAN))
def str_27_scored_names(spark: SparkSession, sf: str) -> DataFrame:
    han = lambda c: F.translate(c, *_HAN)
    lines = A.roles(spark, sf).select("id", F.concat(han(F.col("name")), F.lit(names.SEPARATOR), han(F.reverse("name")), F.lit("，老平")).alias("text"))
    dealt = lines.repartition("id")  # a few megabytes of names would be a task or two
    return dealt.select("id", F.array_join(F.array_sort(names.guard(F.col("text"))["names"]), ",").alias("names"))


@query("""+b AS (SELECT episode_id, min(start_ms) AS a, max(end_ms) AS z FROM cues GROUP BY episode_id), p AS (SELECT episode_id, a + k * ((z - a) // 200) AS t FROM b, (SELECT unnest(range(200)) AS k)),
m AS (SELECT p.episode_id, p.t, first(c.id ORDER BY c.start_ms, c.id) AS cue_id FROM (SELECT DISTINCT * FROM p) p JOIN cues c ON c.episode_id = p.episode_id AND c.start_ms <= p.t AND p.t < c.end_ms GROUP BY ALL)
SELECT episode_id, count(*) AS n_points, count(DISTINCT cue_id) AS n_cues, sum(cue_id)::BIGINT AS ids FROM m GROUP BY episode_id""")
def flt_11_cues_at_points(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cues(spark, sf)
    points = c.groupBy("episode_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("z"))
    points = points.select("episode_id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k"), "a", "z").selectExpr("episode_id", "a + k * ((z - a) div 200) AS t")
    return intervals.covering(points, c).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("cue_id").alias("n_cues"), F.sum("cue_id").alias("ids"))


@query("""+n AS (SELECT id, episode_id, start_ms + 5 AS start_ms FROM cues WHERE id % 2 = 0 AND episode_id % 3 = 0), u AS (SELECT DISTINCT episode_id, id // 7 AS uid FROM cues)
SELECT 'cue' AS kind, episode_id, id, start_ms FROM (SELECT id, episode_id, start_ms FROM cues WHERE episode_id % 3 <> 0 UNION ALL FROM n SELECT id, episode_id, start_ms) UNION ALL SELECT 'utterance', episode_id, uid, NULL FROM u WHERE episode_id % 3 <> 0""")
def dml_12_reparse(spark: SparkSession, sf: str) -> DataFrame:
    c, u = A.cues(spark, sf).select("id", "episode_id", "start_ms"), A.utterances(spark, sf).select("episode_id", "uid")
    cues_at, utterances_at = shared_path(spark, "stored-cues"), shared_path(spark, "stored-utterances")
    stored.store(c, cues_at, "episode_id")
    stored.store(u, utterances_at, "episode_id")
    again = c.where("episode_id % 3 = 0").select("episode_id")
    parsed = c.where("id % 2 = 0").withColumn("start_ms", F.col("start_ms") + 5)
    stored.reparse(cues_at, utterances_at, u.schema, parsed, again)
    cues = stored.stored(spark, cues_at, c.schema).select(F.lit("cue").alias("kind"), "episode_id", "id", "start_ms")
    return cues.unionByName(stored.stored(spark, utterances_at, u.schema).select(F.lit("utterance").alias("kind"), "episode_id", F.col("uid").alias("id"), F.lit(None).cast("long").alias("start_ms")))
