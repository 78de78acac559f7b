"""Which texts of a group stand within which others, by anchors.

1. Of every inner text a few windows of bytes, evenly spread, are hashed (PROPOSALS of the largest power of
   two up to SIZES[-1] that it holds). These narrow rows, in blocks of groups of at most BLOCK, are sent to all tasks.
2. Outer texts are written by block where they lie. Every one is walked once, by the block of its group (a group of more
   than BLOCK proposals has several), a rolling hash of each size at all places at once; what comes out are ids of
   outer texts beside the proposals that they hold.
3. An inner text keeps the one proposal that the fewest outer texts hold, its anchor; one that has a
   proposal which none holds stands in none. Anchor and proposals meet as ids.
4. Only pairs with an anchor in common get their texts back, to be compared whole.

So texts are shuffled for surviving pairs alone, and a phrase that all texts of a group share costs
nothing while an inner text has a rarer one. Nothing is missed, and a hash that two windows share costs a
comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

SIZES = (1, 2, 4, 8, 16, 32)
PROPOSALS = 8
#: Most proposals that tasks hold at once (eight bytes each).
BLOCK = 1 << 20

_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def windows(text: bytes, size: int, group: int) -> np.ndarray:
    """A hash of each window of ``size`` bytes, with its group's."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data) - size + 1
    h = np.full(max(n, 0), size, dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        h = h * _BASE + data[k : k + n]
    h = (h ^ np.array(group, dtype=np.int64).view(np.uint64)) * _SPREAD
    return (h ^ (h >> np.uint64(32))) * _BASE


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, groups, sizes, keys = [], [], [], []
        for id_, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size = max(s for s in SIZES if s <= len(text))
            at = np.unique(np.linspace(0, len(text) - size, PROPOSALS).astype(np.int64))
            found = np.unique(np.concatenate([windows(text[k : k + size], size, group) for k in at.tolist()]).view(np.int64))
            ids += [id_] * len(found)
            groups += [group] * len(found)
            sizes += [size] * len(found)
            keys += found.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(groups, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())], names=["_i", "g", "size", "key"])


def _holding(wanted) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = wanted.value
        for batch in batches:
            for id_, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for size, keys in by_size.items():
                    h = windows(text, size, group).view(np.int64)
                    found = np.unique(h[keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h])
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), id_)), pa.array(found)], names=["_o", "key"])

    return run


def held(inner: DataFrame, outer: DataFrame, by: str, least: Column, block: int = BLOCK) -> DataFrame:
    """``by``, inner, outer and ``least`` for texts of ``inner`` (not empty) that stand within texts of ``outer``
    of the same ``by``. ``least`` is a column of either side. Null groups and null texts meet nothing."""
    numbered = lambda df, text, key: df.where(F.col(by).isNotNull() & (F.col(text) != "")).withColumn(key, F.monotonically_increasing_id())
    i = written(numbered(inner, "inner", "_i"), "inner")
    group = F.xxhash64(F.col(by).cast("string"))
    proposals = written(i.select("_i", group.alias("g"), F.col("inner").cast("binary").alias("t")).mapInArrow(_proposed, "_i long, g long, size int, key long"), "proposals")
    wanted = written(proposals.select("g", "size", "key").distinct(), "wanted")
    n_all = wanted.count()
    n_blocks = 1 if n_all <= block else -(-3 * n_all // (2 * block))  # with room for blocks that aren't even
    block_of = lambda g: F.pmod(g, F.lit(n_blocks)).cast("int")
    o = written(numbered(outer, "outer", "_o").withColumn("_block", block_of(group)), "outer", "_block")
    parts = []
    for k, n in wanted.groupBy(block_of(F.col("g"))).count().collect() or [(0, 0)]:
        places = o.where(F.col("_block") == k).select("_o", group.alias("g"), F.col("outer").cast("binary").alias("t"))
        splits = max(1, -(-n // block))  # more than one for a group that has more than a block
        for j in range(splits):
            found = wanted.where((block_of(F.col("g")) == k) & (F.pmod(F.xxhash64("key"), F.lit(splits)) == j)).select("size", "key").toPandas()  # about ``block`` rows
            by_size = {int(size): np.sort(some["key"].to_numpy()) for size, some in found.groupby("size")}
            parts.append(places.mapInArrow(_holding(inner.sparkSession.sparkContext.broadcast(by_size)), "_o long, key long"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    hits = written(hits, "hits")
    seen = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    anchors = proposals.join(seen, "key", "left").groupBy("_i").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("a")).where("a.n > 0").select("_i", F.col("a.key").alias("key"))
    pairs = anchors.join(hits, "key").select("_i", "_o")
    both = pairs.join(i, "_i").join(o.drop("_block").withColumnRenamed(by, "_by"), "_o").where((F.col(by) == F.col("_by")) & F.col("outer").contains(F.col("inner")))
    return both.select(by, "inner", "outer", least.alias("least"))
