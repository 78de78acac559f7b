r"""Quality rules with a verdict by host.

Rules count over whole texts (words are runs of [^\x20\x09-\x0D]): few words, and
words in 3-word windows that come again. Failures are summed by host (two counts
a host, map-side combined), each host's failure rate is shrunk with a beta prior
that is fitted to all hosts by moments, and hosts whose shrunk rate passes a limit
are rejected; the verdict is joined back to documents, those of a large host in parts.

Nulls and ties: a null or empty text has no words and fails; a null host has no
verdict, so that its documents stand on their own; repeated rows each count and
each come out; an empty table gives an empty result. Columns of the input that
aren't named below pass through ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import join_hot, read_documents, saved, unused

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected where its shrunk failure rate is over this.
MAX_HOST_RATE = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = tb.byte_class(*b"#*$%&|<>")
_NEWLINE = tb.byte_class(0x0A)


def count_texts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of some texts."""
    t = tb.Joined(texts)
    starts, ends, owner = t.runs(tb.NOT_BLANK)
    words = tb.hashes(t.bytes, starts, ends)
    out = {
        "n_words": np.bincount(owner, minlength=t.n),
        "n_symbols": t.count(_SYMBOLS),
        "word_chars": t.count(tb.NOT_BLANK & tb.CHARACTER),
    }
    lines = np.flatnonzero(_NEWLINE[t.bytes])
    line_starts = np.concatenate(([0], lines[:-1] + 1))
    line_of = np.searchsorted(lines, starts)
    with_word = np.unique(line_of)
    line_owner = t.owner(line_starts[with_word])
    key = tb.mixed(tb.hashes(t.bytes, line_starts[with_word], lines[with_word]) + line_owner.astype(np.uint64))
    kept = np.bincount(line_owner[tb.first_of(key)], minlength=t.n)
    out["n_dup_lines"] = np.bincount(line_owner, minlength=t.n) - kept

    covered = np.zeros(len(words), dtype=bool)
    if len(words) > 2:
        key = tb.mixed(words[:-2] + owner[:-2].astype(np.uint64)) + tb.mixed(words[1:-1] * np.uint64(3) + words[2:] * np.uint64(0xD6E8FEB86659FD93))
        whole = np.flatnonzero(owner[:-2] == owner[2:])
        codes, distinct = pd.factorize(key[whole])
        again = whole[np.bincount(codes, minlength=len(distinct))[codes] > 1]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=t.n)
    return out


def with_counts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` (of any types, the text itself too) and the counts of each row's text."""
    names = [f"_k{i}" for i in range(len(keep))]
    shown = text_col in keep
    at = keep.index(text_col) if shown else len(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            kept = batch if shown else batch.select(names)
            for a, b in tb.pieces(texts):
                counts = count_texts(texts[a:b])
                arrays = [*kept.slice(a, b - a).columns, *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *COUNTS])

    rows = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), *([] if shown else [F.col(text_col).alias("_text")]))
    fields = [f for f in rows.schema if f.name != "_text"]
    out = rows.mapInArrow(count, T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]))
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(counted: DataFrame, host_col: str = "source", failed_col: str = "base_failed") -> DataFrame:
    """host, n_docs, n_failed, prior alpha and beta, shrunk rate and verdict.

    The prior's strength follows from the spread of the hosts' rates (method of
    moments over hosts); without spread it is the weight of all documents, with
    spread above that of any beta it is one document.
    """
    hosts = counted.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed_col).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    over_all = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.var_pop(rate).alias("spread"), F.sum("n_docs").cast("double").alias("total"))
    mean, spread = F.col("mean"), F.col("spread")
    strength = F.when(spread <= 0, F.col("total")).otherwise(F.greatest(F.lit(1.0), F.least(F.col("total"), F.try_divide(mean * (1 - mean), spread) - 1)))
    prior = over_all.select((mean * strength).alias("alpha"), ((1 - mean) * strength).alias("beta"))
    return (
        hosts.join(F.broadcast(prior))  # one row
        .withColumn("shrunk_rate", (F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta")))
        .withColumn("host_rejected", F.col("shrunk_rate") > MAX_HOST_RATE)
    )


def judge(df: DataFrame, text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the host, the counts, base_failed, shrunk_rate, host_rejected and kept."""
    columns = tuple(dict.fromkeys((*keep, host_col)))
    counted = saved(with_counts(df, text_col, columns).withColumn("base_failed", base_failed()), "rules")
    host = unused(counted, "_host")
    verdicts = saved(host_verdicts(counted, host_col).select(F.col("host").alias(host), "shrunk_rate", "host_rejected"), "hosts")
    judged = join_hot(counted, verdicts, {host_col: host}, [*keep[:1], "n_words", "word_chars"], 64 + F.length(host))
    return judged.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules and their host's verdict keep, with its columns."""
    short = {c: f"_d{i}" for i, c in enumerate(df.columns)}
    judged = judge(df.withColumnsRenamed(short), short[text_col], short[host_col], tuple(short.values()))
    return judged.where("kept").select(*(F.col(s).alias(c) for c, s in short.items()))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS tri FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.doc_id, d.source, len(w.ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS mean, var_pop(bad / n) AS spread, sum(n)::DOUBLE AS total FROM h),
p AS (SELECT mean, CASE WHEN spread <= 0 THEN total ELSE greatest(1.0, least(total, mean * (1 - mean) / spread - 1)) END AS strength FROM m),
v AS (SELECT source, (bad + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(v.rejected, FALSE) AS kept
FROM f LEFT JOIN v ON f.source = v.source
"""
