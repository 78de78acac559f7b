r"""Source divergence audit: how far the sources of a language are apart in their words, and by which.

Terms are words ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` of whole texts, A-Z lower-cased. A language keeps the
V terms that stand in at least MIN_DOCS of its documents. A group is a (language, source) pair that
occurs. Of a group, or a language, a kept term of count occurrences has p = 1 + (10**9 * (count + 5)) div
(N + 5 * V), N being the count of all kept terms together.

1. Document frequencies, exact: a task sums up the distinct terms of its documents by language.
2. The kept terms, cut into blocks of at most BLOCK_BYTES, each with blanks around it, become an
   Aho-Corasick automaton for each language. Every text of a language, its words between single blanks,
   runs through it whole; what it meets are occurrences. Each block is held against all rows.
3. Counts are sparse postings (term, source, p). Terms that a group doesn't have all have the
   same p there, its base. So the sum of |p - q| over all kept terms is the one over all pairs of
   groups' bases, corrected by each group's own terms, and by the terms that both have: only
   those are met term by term. A task takes the postings of a term as they come, in tiles of TILE
   by TILE sources, and gives sums, not pairs of postings.
4. Ranks are counted within a group, those of terms only to TOP_TERMS.

Result, a row for each other source of a group's language (part ``pair``) and for each of its strongest
terms (part ``term``): lang, source, part, item, value, rank.

Nulls and ties: a null text, language or source is empty; a group without terms has pairs; a language
without kept terms has pairs of value 0; equal values stand by item in UTF-8; repeated rows
count as often as they stand there; an empty table gives an empty result. Extra columns are not
read. Memory: a block's automaton, and tables of at most MAX_HELD sums that a task sends on when full.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import broadcast_if_small, read_documents, saved

MIN_DOCS, TOP_TERMS = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Most bytes of the terms of an automaton, most sums that a task holds, sources of a tile.
BLOCK_BYTES, MAX_HELD, TILE = 2 << 20, 1 << 20, 512

#: A text's bytes with A-Z lower-cased and all that is no term's a blank.
TERMS = bytes(tb.LOWER[b] if b >= 0x41 and tb.LETTER_DIGIT[b] else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def _texts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(named(lang_col).alias("lang"), named(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def kept_terms(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term of the terms in at least ``min_docs`` documents of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, c in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["lang", "term", "docs"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(lang, Counter()).update(set(terms(text.as_py())))
            if sum(map(len, sums.values())) > MAX_HELD:
                yield from told()
        yield from told()

    found = texts.select("lang", "text").mapInArrow(run, "lang string, term binary, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"))


_loaded: dict[str, dict] = {}


def _automata(name: str, block: list[tuple[str, str, int]]) -> dict:
    """By language an automaton over its terms between blanks, with their numbers. A Python worker serves many tasks and keeps the last."""
    if name not in _loaded:
        import ahocorasick

        _loaded.clear()
        out = _loaded[name] = {}
        for lang, term, number in block:
            out.setdefault(lang, ahocorasick.Automaton()).add_word(f" {term} ", number)
        for a in out.values():
            a.make_automaton()
    return _loaded[name]


def occurrences(texts: DataFrame, kept: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, number and count (over 0) of the terms in ``kept`` (a written table: lang, term, number) of each group."""
    bytes_ = kept.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    n_blocks = max(1, -(-2 * bytes_ // block_bytes)) if bytes_ > block_bytes else 1
    parts = []
    for k in range(n_blocks):
        block = kept.where(F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == k).select("lang", "term", "number").collect()  # block_bytes bounds it
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            automata = _loaded.get(name) or _automata(name, shared.value)
            sums: dict[tuple[str, str], Counter] = {}

            def told() -> pa.RecordBatch:
                # a row for each group, its numbers and counts side by side
                sizes = np.array([0, *map(len, sums.values())])
                numbers, counts = (np.fromiter((x for c in sums.values() for x in side(c)), np.int64, int(sizes.sum())) for side in (Counter.keys, Counter.values))
                ends = pa.array(np.cumsum(sizes), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (numbers, counts)]
                return pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in sums], pa.string()) for i in (0, 1)), *lists], names=["lang", "source", "numbers", "counts"])

            for batch in batches:
                for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if lang in automata and (said := terms(text.as_py())):
                        whole = b" " + b" ".join(said) + b" "
                        found = automata[lang].iter(whole.decode("utf-8", "replace"))
                        sums.setdefault((lang, source), Counter()).update(map(itemgetter(1), found))
                if sum(map(len, sums.values())) > MAX_HELD:
                    yield told()
                    sums = {}
            if sums:
                yield told()

        each = texts.mapInArrow(run, "lang string, source string, numbers array<long>, counts array<long>")
        parts.append(each.select("lang", "source", F.explode(F.arrays_zip("numbers", "counts")).alias("x")).select("lang", "source", F.col("x.numbers").alias("number"), F.col("x.counts").alias("count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("lang", "source", "number").agg(F.sum("count").alias("count"))


def _share(count: str, n: str, v: str) -> Column:
    """p, in whole numbers; null where no term is kept."""
    return F.expr(f"1 + ({SCALE}L * ({count} + {PRIOR})) div nullif({n} + {PRIOR} * {v}, 0)")


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From postings sorted by number of term: lang, a, b (numbers of sources, a < b) and the sum, over
    terms that both have, of |p - q| - |p - base of b| - |q - base of a| + |base of a - base of b|."""
    tiles: dict[tuple, np.ndarray] = {}

    def add(lang: str, at: np.ndarray, p: np.ndarray, base: np.ndarray) -> None:
        order = np.argsort(at)
        at, p, base = at[order], p[order], base[order]
        cuts = np.flatnonzero(np.diff(at // TILE)) + 1
        runs = [s for s in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True)]
        for k, (a, b) in enumerate(runs):
            for c, d in runs[k:]:
                x, y = slice(a, b), slice(c, d)
                apart = np.abs(p[x, None] - p[y]) - np.abs(p[x, None] - base[y]) - np.abs(base[x, None] - p[y]) + np.abs(base[x, None] - base[y])
                tile = tiles.setdefault((lang, int(at[a]) // TILE, int(at[c]) // TILE), np.zeros((TILE, TILE), dtype=np.int64))
                tile[np.ix_(at[x] % TILE, at[y] % TILE)] += apart

    def told() -> Iterator[pd.DataFrame]:
        for (lang, i, j), tile in tiles.items():
            a, b = np.nonzero(np.triu(tile, 1) if i == j else tile)
            yield pd.DataFrame({"lang": lang, "a": i * TILE + a, "b": j * TILE + b, "both": tile[a, b]})
        tiles.clear()

    rest: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        change = np.flatnonzero(np.diff(pdf["number"].to_numpy())) + 1
        last = int(change[-1]) if len(change) else 0
        lang, at, p, base = (pdf[c].to_numpy() for c in ("lang", "at", "p", "base"))
        for a, b in zip([0, *change[:-1].tolist()], change.tolist(), strict=False):
            add(lang[a], at[a:b], p[a:b], base[a:b])
        rest = pdf.iloc[last:]
        if len(tiles) > 64:
            yield from told()
    if rest is not None and len(rest):
        add(rest["lang"].iat[0], *(rest[c].to_numpy() for c in ("at", "p", "base")))
    yield from told()


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank."""
    texts = _texts(df, text_col, lang_col, source_col)
    kept = saved(kept_terms(texts, min_docs).withColumn("number", F.monotonically_increasing_id()), "kept")
    counts = saved(occurrences(texts, kept, block_bytes), "counts")
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("own"))
    groups = texts.select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["n", "own", "v"])
    by_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "n", "own", "v", F.sum("n").over(by_lang).alias("n_lang"), (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("at"), F.coalesce(_share("0", "n", "v"), F.lit(0)).alias("base"))
    groups = saved(groups, "groups")
    told = broadcast_if_small(groups, 80 + F.octet_length("lang") + F.octet_length("source"))
    postings = saved(counts.join(told, ["lang", "source"]).withColumn("p", _share("count", "n", "v")), "shares")

    # what both have
    sorted_ = postings.select("lang", "number", "at", "p", "base").repartition("number").sortWithinPartitions("number")
    both = sorted_.mapInPandas(_met, "lang string, a long, b long, both long").groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))
    # each group's own terms against the base of the others: equal p are one row
    own = postings.groupBy("lang", "at", "p").agg(F.count(F.lit(1)).alias("times"))
    others = groups.select("lang", F.col("at").alias("other"), F.col("base").alias("q"))
    alone = own.join(others, (own["lang"] == others["lang"]) & (F.col("at") != F.col("other"))).groupBy(own["lang"], "at", "other").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("q"))).alias("alone"))
    alone = alone.groupBy("lang", F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b")).agg(F.sum("alone").alias("alone"))
    side = lambda s: groups.select("lang", F.col("at").alias(s), F.col("source").alias(f"source_{s}"), F.col("base").alias(f"base_{s}"), F.col("own").alias(f"own_{s}"), *(["v"] if s == "a" else []))
    pairs = side("a").join(side("b"), "lang").where("a < b").join(both, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left")
    rest = (F.col("v") - F.col("own_a") - F.col("own_b")) * F.abs(F.col("base_a") - F.col("base_b"))
    value = (F.coalesce("both", F.lit(0)) + F.coalesce("alone", F.lit(0)) + rest).cast("long")
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = pairs.select("lang", value.alias("value"), ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    of_lang = counts.groupBy("number").agg(F.sum("count").alias("count_l")).join(kept, "number").select("number", "term", "count_l")
    strong = postings.join(of_lang, "number").withColumn("q", _share("count_l", "n_lang", "v")).where("p > q")
    strong = strong.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())).alias("rank")
    strong = strong.select("*", ranked).where(F.col("rank") <= top)
    return pairs.select("*", ranked).unionByName(strong)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT lang, source, r, term, count(*)::BIGINT AS n FROM (SELECT lang, source, r, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*)::BIGINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT d.lang, d.source, coalesce(v.v, 0)::BIGINT AS v FROM d LEFT JOIN v ON v.lang = d.lang),
c AS (SELECT g.lang, g.source, k.term, g.v, coalesce(x.n, 0)::BIGINT AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, sum(n)::BIGINT AS n FROM o GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::BIGINT + 5 * v) AS p FROM c),
l AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::BIGINT + 5 * v) AS q FROM (SELECT lang, term, v, sum(n)::BIGINT AS n FROM c GROUP BY ALL)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(a.f, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - l.q)::BIGINT AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
