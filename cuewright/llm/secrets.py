r"""Secret scans with corpus-wide ownership, in DataFrame operations only.

Base kinds (leftmost, non-overlapping within a kind, whole match as the span, code
points, end exclusive): ``assign`` (a key word, ``:`` or ``=``, a value of 6 or more
characters), ``access`` (AKIA and 16 or more of A-Z0-9), ``hex`` (24 or more of 0-9a-f).
The method adds ``bare``: runs of 20 or more of ``[A-Za-z0-9+/_-]`` with a digit, a small
and a capital letter, that overlap no base span and that the corpus shows to be owned.

1. One pass over whole texts gives the lengths of matches and of what lies between them, and
   the hash of each candidate's value; it is written, one narrow row for each document.
2. Matches become rows of their own: a running sum gives their places, running extremes the
   bare ones that overlap a base one. So a text's work is linear in its length and spans.
3. Candidate hashes are made distinct by owner and repository (map-side), counted by
   owner and then in all, so that a value that a third of the corpus holds is summed from
   partial counts. A value with EXAMPLE_OWNERS or more distinct owners is a widely copied
   example; any other is live-looking.
4. Examples join back by hash to candidates (``join_hot``), and spans by row key to documents.

In ``documents`` the source is the owner and the document is the repository.

Nulls and ties: a null text is empty; a null owner is one owner of its own; repeated rows
are one repository and each comes out; an empty table gives an empty result. Extra columns
are kept by ``redact`` and not read by the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns_of, join_hot, read_documents, row_key, saved, unused

EXAMPLE_OWNERS = 3
#: Characters of the parts that a text is cut into while it is masked.
PART = 4096


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run of a class holds 24 characters, or 16 after AKIA, where the whole run does.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BARE = "[A-Za-z0-9+/_-]{20,}"
#: Kinds in order, with the pattern and the group of the value.
KINDS = (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("bare", BARE, 0))
BASE = 3

_SPANS = "array<struct<start:long,kind:int,end:long,hash:long>>"


def _good(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.length(value) >= 6
    if kind == BASE:
        return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return F.lit(True)


def _matched(df: DataFrame, kind: int) -> DataFrame:
    """Adds _matches<kind>: of each match the gap before it, its size, and its value's hash (null where it isn't good)."""
    _, pattern, group = KINDS[kind]
    gaps, found, values = (f"_{x}{kind}" for x in ("gaps", "found", "values"))
    has = F.col("_text").rlike(pattern)
    df = df.withColumn(found, F.when(has, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split("_text", pattern)))
    df = df.withColumn(values, F.when(F.size(found) > 0, F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))) if group else F.col(found))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), F.col(found).alias("m"), F.col(values).alias("v")).cast("array<struct<g:string,m:string,v:string>>")
    told = F.transform(zipped, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), F.when(_good(kind, x["v"]), F.xxhash64(x["v"])).alias("hash")))
    return df.withColumn(f"_matches{kind}", told).drop(*{gaps, found, values})


def candidates(df: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """For each row: row_key and ``keep``; and for each base or bare span of each row key:
    row_key, owner, repository, start, kind, end, hash. Both written."""
    rows = df.select(
        row_key(repository_col, owner_col, text_col).alias("row_key"),
        *(F.col(c) for c in keep),
        F.col(owner_col).cast("string").alias("_owner"),
        F.col(repository_col).cast("string").alias("_repository"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    rows = reduce(_matched, range(len(KINDS)), rows)
    matches = [F.col(f"_matches{k}") for k in range(len(KINDS))]
    rows = saved(rows.select("row_key", *keep, "_owner", "_repository", *matches), "matches")

    held = rows.where(reduce(Column.__or__, (F.size(m) > 0 for m in matches))).select("row_key", "_owner", "_repository", *matches).dropDuplicates(["row_key"])
    tag = lambda k: lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["hash"].alias("hash"))
    tagged = [F.transform(m, tag(k)) for k, m in enumerate(matches)]
    each = held.select("row_key", "_owner", "_repository", F.explode(F.concat(*(F.coalesce(t, F.array()) for t in tagged))).alias("m")).select("row_key", "_owner", "_repository", "m.*")
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(Window.partitionBy("row_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("hash is not null")
    base = F.col("kind") < BASE
    upward, downward = Window.partitionBy("row_key").orderBy("start", "kind"), Window.partitionBy("row_key").orderBy(F.desc("start"), F.desc("kind"))
    spans = spans.withColumn("_before", F.max(F.when(base, F.col("end"))).over(upward.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.withColumn("_after", F.min(F.when(base, F.col("start"))).over(downward.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    overlaps = (F.coalesce("_before", F.lit(-1)) > F.col("start")) | (F.coalesce("_after", F.col("end")) < F.col("end"))
    spans = spans.where(base | ~overlaps).select("row_key", "_owner", "_repository", "start", "kind", "end", "hash")
    return rows.select("row_key", *keep), saved(spans, "spans")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners and live of every candidate value."""
    by_owner = spans.select("hash", "_owner", "_repository").distinct().groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")).withColumn("live", F.col("n_owners") < EXAMPLE_OWNERS)


def _judged(spans: DataFrame) -> DataFrame:
    """Spans with live: false where corpus-wide ownership makes the value an example."""
    examples = saved(ownership(spans).where(~F.col("live")).select(F.col("hash").alias("_value"), F.lit(False).alias("live")), "examples")
    return join_hot(spans, examples, {"hash": "_value"}, ["row_key", "start"], 24).withColumn("live", F.coalesce("live", F.lit(True)))


def scan(df: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of ``df``: row_key, ``keep``, base (spans), spans (base ones and owned
    bare ones, by start and kind), n_live and n_examples (of the candidates)."""
    rows, spans = candidates(df, text_col, owner_col, repository_col, keep)
    span = F.struct("start", "kind", "end", "hash")
    base = F.col("kind") < BASE
    told = _judged(spans).groupBy(F.col("row_key").alias("_key")).agg(
        F.sort_array(F.collect_list(F.when(base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(base | F.col("live"), span))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_examples"),
    )
    told = saved(told, "told")
    rows = join_hot(rows, told, {"row_key": "_key"}, ["row_key"], 128 + 48 * F.size("spans") + 48 * F.size("base"))
    none, empty = F.lit(0).cast("long"), F.array().cast(_SPANS)
    return rows.select("row_key", *keep, F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"), F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_examples", none).alias("n_examples"))


def redact(df: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its texts (overlapping ones as one) replaced by ``mask``.

    Texts without a span, null ones included, stay as they are."""
    key, gaps, parts = unused(df, "_key"), unused(df, "_gaps"), unused(df, "_parts")
    spans = _judged(candidates(df, text_col, owner_col, repository_col, ())[1]).where((F.col("kind") < BASE) | F.col("live"))
    order = Window.partitionBy("row_key").orderBy("start", "kind")
    spans = spans.withColumn("_to", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # what stands before each span that begins beyond all before it, and what stands after the last
    gap = F.when(F.coalesce("_to", F.lit(0)) <= F.col("start"), F.struct(F.coalesce("_to", F.lit(0)).alias("from"), F.col("start").alias("to")))
    marks = spans.groupBy(F.col("row_key").alias(key)).agg(F.sort_array(F.collect_list(gap)).alias(gaps), F.max("end").alias("_last"))
    rest = F.array(F.struct(F.col("_last").alias("from"), F.lit(1 << 40).alias("to")))
    marks = saved(marks.select(key, F.concat(gaps, rest.cast("array<struct<from:bigint,to:bigint>>")).alias(gaps)), "marks")
    marks = broadcast_if_small(marks, 64 + 24 * F.size(gaps))
    rows = df.withColumn(key, row_key(repository_col, owner_col, text_col)).join(marks, key, "left")
    rows = rows.withColumn(parts, F.when(F.col(gaps).isNotNull(), F.regexp_extract_all(text_col, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))))

    def text_of(g: Column) -> Column:
        """A gap's text from the parts that it lies in, so that no text is walked from its start for each gap."""
        first, last = (F.floor(g["from"] / PART)).cast("int"), F.least(F.floor(g["to"] / PART), F.size(parts)).cast("int")
        some = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
        return F.substring(some, (g["from"] - first * PART + 1).cast("int"), (F.least(g["to"] - g["from"], F.length(some).cast("long"))).cast("int"))

    whole = F.array_join(F.transform(gaps, text_of), mask)
    return rows.withColumn(text_col, F.when(F.col(gaps).isNull(), F.col(text_col)).otherwise(whole)).select(*columns_of(df))


def _told(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k, _, _ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans"), "n_live", "n_examples")


def _sql(kind: int) -> str:
    name, pattern, group = KINDS[kind]
    p = pattern.replace("'", "''")
    good = ("length(v) >= 6", "true", "true", "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")[kind]
    return f"""
m{kind} AS (SELECT r, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g
  FROM (SELECT r, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS gs FROM d) WHERE len(ms) > 0),
s{kind} AS (SELECT r, {kind} AS k, '{name}' AS kind, e - length(m) AS s, e, v FROM (SELECT *, sum(length(m) + length(g)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS e FROM m{kind}) WHERE {good}),"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),{"".join(map(_sql, range(len(KINDS))))}
base AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
bare AS (SELECT * FROM s3 WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = s3.r AND base.s < s3.e AND s3.s < base.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
own AS (SELECT v, count(DISTINCT coalesce('=' || source, '-')) < {EXAMPLE_OWNERS} AS live FROM every JOIN d USING (r) GROUP BY v),
told AS (SELECT r, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {BASE}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {BASE} OR live) AS spans,
  count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h FROM every JOIN own USING (v) GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_examples, 0)::BIGINT AS n_examples FROM d LEFT JOIN told USING (r)
"""
