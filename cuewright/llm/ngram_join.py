r"""N-gram Jaccard join by MinHash banding.

Texts (A-Z lower-cased, words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``) become sets of
hashed word n-grams; a text of fewer words, but not none, is one n-gram. Rows and
bands of the signature follow from the wanted recall at the threshold. Then:

1. One row a document: digest of its set, band hashes (numpy inside tasks).
2. Documents with the same digest are one class (map-side combined, so a group of
   copies of any size is one row from here on).
3. Band hashes of classes are counted; buckets of one are gone. Larger ones are
   cut into blocks and every pair of blocks is a unit of bounded size, so that no
   bucket meets in one task. A pair of classes belongs to the first band that it
   shares, so that it is judged once.
4. Only classes with such a pair send their text on; each unit verifies its pairs
   on the full n-gram sets and returns links by class and a root for every linked
   member, not the pairs.
5. Roots are joined into components.

Result, a row for every input row: doc_id, n_ngrams, copy_id (least doc_id with the
same n-gram set), class_id (least doc_id of the component of links), n_links
(documents at or over the threshold, copies included, itself not).

Nulls and ties: a null text, or one without words, has no n-grams and no links: it
is its own class. A null doc_id is allowed; ids come out as the least that isn't
null. Repeated rows are copies of each other and all come out. An empty table gives
an empty result. Missed links: the share 1 - recall at the threshold, and fewer
above it; links that aren't real: none but for 64-bit hash collisions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import broadcast_if_small, columns_of, join_hot, read_documents, row_key, saved, unused
from .graph import components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Most hashes in a signature.
MAX_HASHES = 80
#: Most members and n-grams of a block.
BLOCK_ROWS, BLOCK_NGRAMS = 2048, 1 << 20


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false candidates) whose bands
    reach the recall at the threshold, 1 - (1 - s**rows)**bands, within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError(f"recall {recall} at {threshold} takes more than {most} hashes")
    return best


def ngram_sets(texts: list[str | None], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of some texts, text after text, and how many each has."""
    t = tb.Joined(texts)
    starts, ends, owner = t.runs(tb.LETTER_DIGIT)
    words = tb.hashes(tb.LOWER[t.bytes], starts, ends)
    count = np.bincount(owner, minlength=t.n)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    salt = tb.mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    gram = sum((padded[k : k + len(words)] * salt[k] for k in range(n)), np.zeros(len(words), np.uint64))
    short = np.flatnonzero((count > 0) & (count < n))
    for i in short:  # a short text's gram stops at its end
        gram[first[i]] = (words[first[i] : first[i] + count[i]] * salt[: count[i]]).sum(dtype=np.uint64)
    gram = tb.mixed(gram)
    number = np.arange(len(words)) - first[owner]
    stands = (number <= count[owner] - n) | ((number == 0) & (count[owner] < n))
    gram, owner = gram[stands], owner[stands]
    one = tb.first_of(tb.mixed(gram + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return gram[one], np.bincount(owner[one], minlength=t.n)


def signatures(grams: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests (two 64-bit values) and band hashes (uint32) of each set that isn't empty."""
    full = np.flatnonzero(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1])).astype(np.int64)
    digest = np.stack([np.add.reduceat(tb.mixed(grams ^ np.uint64(k)), starts) for k in (0x5BD1E995, 0x1B873593)], axis=1)
    rng = np.random.default_rng(20240501)
    low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(full), bands), dtype=np.uint32)
    for b in range(bands):
        band = np.zeros(len(full), dtype=np.uint64)
        for _ in range(rows):
            a, c, d = (np.uint32(x) for x in rng.integers(1, 1 << 32, 3))
            h = (low * (a | np.uint32(1)) + d) ^ (high * (c | np.uint32(1)))
            band = tb.mixed(band * np.uint64(31) + np.minimum.reduceat(h, starts).astype(np.uint64))
        out[:, b] = (band >> np.uint64(32)).astype(np.uint32)
    return digest, out


def sign(df: DataFrame, text_col: str, id_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """row_key, doc_id (of the id's type), n_ngrams, digest (null without n-grams), bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("_text").tolist()
            for a, b in tb.pieces(texts):
                grams, sizes = ngram_sets(texts[a:b], n)
                out = pdf.iloc[a:b].copy()
                out["n_ngrams"] = sizes
                digests, vectors = np.full(b - a, None, dtype=object), np.full(b - a, None, dtype=object)
                if len(grams):
                    digest, vector = signatures(grams, sizes, bands, rows)
                    for k, i in enumerate(np.flatnonzero(sizes)):
                        digests[i], vectors[i] = digest[k].tobytes(), vector[k].view(np.int32)
                out["digest"], out["bands"] = digests, vectors
                yield out

    at = df.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("_text"))
    signed = at.mapInPandas(run, "row_key binary, doc_id string, n_ngrams long, digest binary, bands array<int>")
    return signed.withColumn("doc_id", F.col("doc_id").cast(df.schema[id_col].dataType))


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole units (runs of equal unit keys), some at a time, with the runs' bounds."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf["unit"].to_numpy()
        if rest and rest[-1]["unit"].iat[-1] == key[0] == key[-1]:  # in the midst of a unit
            rest.append(pdf)
            continue
        pdf = pd.concat([*rest, pdf], ignore_index=True) if rest else pdf
        key = pdf["unit"].to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        last = int(change[-1]) if len(change) else 0
        if last:
            yield pdf.iloc[:last], np.concatenate(([0], change))
        rest = [pdf.iloc[last:].reset_index(drop=True)]
    if rest:
        pdf = pd.concat(rest, ignore_index=True)
        yield pdf, np.array([0, len(pdf)])


def _first_shared(vectors: np.ndarray, band: int, side: np.ndarray, crossing: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the later members of which ``band`` is the first band that both share."""
    for i in range(len(vectors) - 1):
        rest = vectors[i + 1 :]
        hit = rest[:, band] == vectors[i, band]
        if band:
            hit &= ~(rest[:, :band] == vectors[i, :band]).any(axis=1)
        if crossing:
            hit &= side[i + 1 :] != side[i]
        yield i, hit


def _active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf, bounds in _units(batches):
        vectors, bands = np.stack(pdf["bands"].to_numpy()), pdf["band"].to_numpy()
        side, crossing = pdf["block"].to_numpy(), (pdf["x"] != pdf["y"]).to_numpy()
        on = np.zeros(len(pdf), dtype=bool)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for i, hit in _first_shared(vectors[a:b], bands[a], side[a:b], crossing[a]):
                if hit.any():
                    on[a + i] = True
                    on[a + i + 1 : b] |= hit
        if on.any():
            yield pdf.loc[on, ["unit", "band", "block", "x", "y", "digest", "bands", "n_docs"]]


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a unit."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    codes, distinct = pd.factorize(np.concatenate(sets))
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    common = np.bincount(codes, minlength=len(distinct)) > 1
    number = np.cumsum(common) - 1
    codes, owner = number[codes[common[codes]]], owner[common[codes]]
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    out = np.zeros((n, n), dtype=np.int64)
    width = max(64, (1 << 22) // n)
    for at in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(codes, (at, at + width))
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[lo:hi], codes[lo:hi] - at] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _units(batches):
            vectors, bands = np.stack(pdf["bands"].to_numpy()), pdf["band"].to_numpy()
            side, crossing = pdf["block"].to_numpy(), (pdf["x"] != pdf["y"]).to_numpy()
            digests, grams, weight = pdf["digest"].to_numpy(), pdf["grams"].to_numpy(), pdf["n_docs"].to_numpy()
            found: list[tuple[bytes, bytes, int]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                sets = [np.frombuffer(g, dtype=np.uint64) for g in grams[a:b]]
                size = np.array([len(s) for s in sets])
                both, w = _overlaps(sets), weight[a:b]
                links, label = np.zeros(b - a, dtype=np.int64), np.arange(b - a)
                pairs = []
                for i, hit in _first_shared(vectors[a:b], bands[a], side[a:b], crossing[a]):
                    # at least the threshold, in whole numbers of a millionth
                    near = i + 1 + np.flatnonzero(hit & (both[i, i + 1 :] * 1_000_000 >= round(threshold * 1_000_000) * (size[i] + size[i + 1 :] - both[i, i + 1 :])))
                    if len(near):
                        pairs.append((i, near))
                        links[i] += w[near].sum()
                        links[near] += w[i]
                while True:
                    was = label.copy()
                    for i, near in pairs:
                        label[i] = min(label[i], label[near].min())
                        label[near] = np.minimum(label[near], label[i])
                    if (was == label).all():
                        break
                found += [(digests[a + i], digests[a + label[i]], int(links[i])) for i in np.flatnonzero(links)]
            if found:
                yield pd.DataFrame(found, columns=["digest", "root", "links"])

    return run


def _grams(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("_text").tolist()
            for a, b in tb.pieces(texts):
                grams, sizes = ngram_sets(texts[a:b], n)
                out = pdf.iloc[a:b].copy()
                out["grams"] = [np.sort(g).tobytes() for g in np.split(grams, np.cumsum(sizes)[:-1])]
                yield out

    return run


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> DataFrame:
    """row_key (of id and text), doc_id, n_ngrams, copy_id, class_id, n_links and
    keep (true on the one row key of each class that stays: least id, then key)."""
    bands, rows = plan_bands(threshold, recall, max_hashes)
    signed = saved(sign(df, text_col, id_col, n, bands, rows), "signed")
    classes = saved(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("copy_id"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"))).alias("first"), F.first("bands").alias("bands"), F.first("n_ngrams").alias("n_ngrams")),
        "classes",
    )
    slots = classes.select("digest", "n_ngrams", F.posexplode("bands").alias("band", "hash")).select("digest", "n_ngrams", "band", F.xxhash64("band", "hash").alias("bucket"))
    crowded = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n_ngrams").alias("weight")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("weight") / BLOCK_NGRAMS)).cast("int")
    # what is left of the slots is narrow; band hashes and counts are joined to those that meet others
    crowded = saved(crowded.select(F.col("bucket").alias("full"), blocks.alias("n_blocks")), "crowded")
    placed = join_hot(slots.select("digest", "band", "bucket"), crowded, {"bucket": "full"}, ["digest"], 32, "inner")
    placed = placed.join(classes.select("digest", "bands", "n_docs"), "digest")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    x, y = F.least("block", "other"), F.greatest("block", "other")
    placed = placed.select(F.xxhash64("bucket", x, y).alias("unit"), "band", "block", x.alias("x"), y.alias("y"), "digest", "bands", "n_docs")
    unit = "unit long, band int, block int, x int, y int, digest binary, bands array<int>, n_docs long"
    active = saved(placed.repartition("unit").sortWithinPartitions("unit").mapInPandas(_active, unit), "active")

    wanted = saved(active.select("digest").distinct().join(classes.select("digest", F.col("first.k").alias("row_key")), "digest"), "wanted")
    texts = df.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("_text"))
    texts = texts.join(broadcast_if_small(wanted, 96), "row_key").select("digest", "_text")
    sets = texts.mapInPandas(_grams(n), "digest binary, grams binary").dropDuplicates(["digest"])
    judged = active.join(sets, "digest").repartition("unit").sortWithinPartitions("unit").mapInPandas(_verify(threshold), "digest binary, root binary, links long")
    linked = saved(judged.groupBy("digest", "root").agg(F.sum("links").alias("links")), "linked")
    links = linked.groupBy(F.col("digest").alias("linked")).agg(F.sum("links").alias("links"))
    roots = components(linked, "digest", "root").select(F.col("id").alias("member"), "root")
    # classes of one document without a link are their own; only the others are told of a head
    some = classes.join(roots, F.col("digest") == F.col("member"), "left").where("n_docs > 1 or root is not null")
    some = some.join(links, F.col("digest") == F.col("linked"), "left")
    some = saved(some.select("digest", "n_docs", "copy_id", "first", F.coalesce("root", "digest").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "grouped")
    least = F.min(F.struct(F.col("first.n"), F.col("first.d"), F.col("first.k")))
    heads = saved(some.groupBy(F.col("root").alias("of")).agg(least.alias("head")), "heads")
    told = join_hot(some, heads, {"root": "of"}, ["digest"], 160)
    told = saved(told.select(F.col("digest").alias("copy_key"), "n_docs", "copy_id", F.col("head.d").alias("class_id"), F.col("head.k").alias("head_key"), "links"), "told")
    alone = F.col("n_docs").isNull()
    return join_hot(signed.drop("bands"), told, {"digest": "copy_key"}, ["row_key"], 160).select(
        "row_key",
        "doc_id",
        "n_ngrams",
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("links") + F.col("n_docs") - 1).alias("n_links"),
        F.coalesce(F.col("row_key") == F.col("head_key"), F.lit(True)).alias("keep"),
    )


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of ``df`` of each class of near duplicates: the one with the least id."""
    key = unused(df, "_key")
    stays = near_duplicates(df, text_col, id_col).where("keep").select(F.col("row_key").alias(key)).distinct()
    return df.withColumn(key, row_key(id_col, text_col)).join(stays, key, "left_semi").dropDuplicates([key]).select(*columns_of(df))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir)).select("doc_id", "n_ngrams", "copy_id", "class_id", "n_links")


#: Every pair by its common n-grams: exact, and quadratic in the rows that share one.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.r < b.r GROUP BY ALL),
l AS (SELECT p.a, p.b, c = x.n AND c = y.n AS equal FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE c * 1000000 >= 800000 * (x.n + y.n - c)),
e AS (SELECT a, b, equal FROM l UNION ALL SELECT b, a, equal FROM l),
reach AS (SELECT DISTINCT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_ngrams, least(d.doc_id, (SELECT min(o.doc_id) FROM e JOIN d o ON o.r = e.b WHERE e.a = d.r AND e.equal)) AS copy_id,
  least(d.doc_id, (SELECT min(o.doc_id) FROM reach JOIN d o ON o.r = reach.b WHERE reach.a = d.r)) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.r) AS n_links
FROM d LEFT JOIN n USING (r)
"""
