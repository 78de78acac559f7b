r"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased. An
item's windows are its runs of WINDOW consecutive words (an item of fewer, but not
none, is one window). A window's fingerprint is the least hash of the K-word grams
inside it (winnowing), so that a document that holds a whole window holds its
fingerprint too: no shared window is missed. Equal fingerprints of neighbouring
windows are kept once, with the range of windows that they stand for.

Fingerprints of documents carry the few words that their windows cover and meet
those of the benchmark; hits are extended to the windows in their range, which are
compared word for word with the benchmark's distinct windows. A benchmark whose
fingerprints, or windows, sum to few enough bytes is broadcast, so that documents
aren't shuffled; beyond that both sides are shuffled on the fingerprint, documents of
a common one in parts (``join_hot``).

Nulls and ties: a null text, or one without words, has no windows and no hits; a
null item_id counts as no item but its windows still mark words; repeated items or
rows count once per id, and each input row comes out once. Empty tables give zero
counts, or an empty result. Other columns of the inputs are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns_of, join_hot, read_documents, row_key, saved, table, unused

WINDOW = 10
K = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), "")


def _upto(last: Column) -> Column:
    """0 .. last, or nothing."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


_PRINTS = "array<struct<length:int,hash:bigint,first:int,last:int,covered:array<string>>>"


def _with_fingerprints(df: DataFrame, length: int, words: str = "words") -> DataFrame:
    """Adds ``prints``: a struct for each fingerprint of windows of ``length`` words, with
    length, hash, first and last window, and the words that those windows cover.

    Every array is named by a column that is used more than once, so that the optimizer
    evaluates it once a row. For the same reason readers use explode_outer: explode would
    push a filter on the array's size below, and its whole expression with it.
    """
    k = min(K, length)
    per_window = length - k + 1
    w, g, m, s = (F.col(c) for c in (words, "_grams", "_least", "_new"))
    df = df.withColumn("_grams", F.transform(_upto(F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))))
    if per_window > 1:
        df = df.withColumn("_least", F.transform(_upto(F.size(g) - per_window), lambda i: F.array_min(F.slice(g, i + 1, F.lit(per_window)))))
    else:
        df = df.withColumn("_least", g)
    df = df.withColumn("_new", F.filter(_upto(F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1))))
    last = lambda n: F.coalesce(F.get(s, n + 1), F.size(m)) - 1
    prints = F.transform(
        s,
        lambda i, n: F.struct(
            F.lit(length).alias("length"),
            F.get(m, i).alias("hash"),
            i.alias("first"),
            last(n).alias("last"),
            F.slice(w, i + 1, last(n) - i + length).alias("covered"),
        ),
    )
    return df.withColumn("prints", prints).drop("_grams", "_least", "_new")


def fingerprints(df: DataFrame, lengths: list[int], keep: tuple[str, ...]) -> DataFrame:
    """``keep`` of each row and length, hash, first, last, covered of each of its fingerprints, and
    one row more of length 0 whose first is the row's count of words. ``words`` is an array column."""
    for n in lengths:
        df = _with_fingerprints(df, n).withColumnRenamed("prints", f"_prints{n}")
    count = F.struct(F.lit(0).alias("length"), F.xxhash64(*keep).alias("hash"), F.size("words").alias("first"), F.lit(0).alias("last"), F.array().cast("array<string>").alias("covered"))
    every = F.concat(F.array(count), *(F.coalesce(f"_prints{n}", F.array().cast(_PRINTS)) for n in lengths))
    return df.select(*keep, F.explode_outer(every).alias("p")).select(*keep, "p.*")


def window_text(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def benchmark_windows(items: DataFrame) -> DataFrame:
    """Distinct windows of items (item, words): length, window, fingerprint, item ids (sorted strings)."""
    size = F.size("words")
    parts = []
    for n in range(1, WINDOW + 1):
        prints = fingerprints(items.where(size >= n if n == WINDOW else size == n), [n], ("item",))
        parts.append(prints.where("length > 0"))
    windows = reduce(DataFrame.union, parts).select("item", "length", "hash", "covered", F.explode(F.sequence(F.lit(0), F.col("last") - F.col("first"))).alias("at"))
    return windows.groupBy("length", window_text(F.col("covered"), F.col("at"), F.col("length")).alias("window")).agg(F.first("hash").alias("hash"), F.sort_array(F.collect_set("item")).alias("items"))


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, id_col: str, item_text_col: str, item_id_col: str) -> tuple[DataFrame, DataFrame]:
    """Counts (row_key, doc_id, n_words of every row) and hits (row_key, start, end, items), from one pass over texts."""
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words"))
    windows = saved(benchmark_windows(items), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most WINDOW values
    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    known = saved(windows.select(F.col("length").alias("_length"), F.col("hash").alias("_hash")).distinct().withColumn("known", F.lit(True)), "known")
    met = join_hot(fingerprints(rows, lengths, ("row_key", "doc_id")), known, {"length": "_length", "hash": "_hash"}, ["row_key", "first"], 32, costly=True).where("known OR length = 0")
    met = saved(met.drop("known", "hash"), "met")
    counts = met.where("length = 0").select("row_key", "doc_id", F.col("first").cast("long").alias("n_words"))
    spread = met.where("length > 0").select("row_key", "length", "covered", "first", F.explode(F.sequence(F.lit(0), F.col("last") - F.col("first"))).alias("at"))
    spread = spread.select("row_key", "length", (F.col("first") + F.col("at")).alias("start"), window_text(F.col("covered"), F.col("at"), F.col("length")).alias("window"))
    exact = windows.select(F.col("length").alias("_length"), F.col("window").alias("_window"), "items")
    width = 96 + F.octet_length("_window") + F.aggregate("items", F.lit(0), lambda a, i: a + 24 + F.octet_length(i))
    found = join_hot(spread, exact, {"length": "_length", "window": "_window"}, ["row_key", "start"], width, "inner")
    return counts, found.select("row_key", "start", (F.col("start") + F.col("length")).alias("end"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """row_key (of id and text), start, end, items: where windows of the benchmark stand in documents."""
    return _found(docs, benchmark, text_col, id_col, item_text_col, item_id_col)[1]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """A row for each document: row_key, doc_id, n_words, n_hit, items (sorted), contaminated."""
    rows, found = _found(docs, benchmark, text_col, id_col, item_text_col, item_id_col)
    spans = found.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    end, n = F.lit(0), F.lit(0).cast("long")
    covered = F.aggregate(
        "spans",
        F.struct(end.alias("end"), n.alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    marked = spans.select("row_key", covered.alias("n_hit"), "items")
    return (
        rows.join(marked, "row_key", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    key = unused(docs, "_key")
    hit = saved(hits(docs, benchmark, text_col, id_col, item_text_col, item_id_col).select(F.col("row_key").alias(key)).distinct(), "hit")
    return docs.withColumn(key, row_key(id_col, text_col)).join(broadcast_if_small(hit, 48), key, "left_anti").select(*columns_of(docs))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
hi AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
