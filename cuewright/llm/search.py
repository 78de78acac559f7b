r"""Ranked lexical search: the best documents for each of a set of query texts.

Terms are words ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` of whole texts, A-Z lower-cased. N counts the
documents with a term, L all terms, n one document's, df the documents that hold a term, tf its
occurrences there. With w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 25 + (75 * n * N) div L a
document's score is the sum of w * ((10**9 * tf) div (1000 * tf + 8 * m)) over the query's terms, repeats
included.

1. Query texts are dealt by hash into blocks of about BLOCK_TERMS terms, so that what a task holds of
   them is bounded however many there are; each block is searched against all rows.
2. A task numbers its documents as it reads them and cuts the numbers into windows of WINDOW. The
   postings of a window (document numbers and tf, term by term) are one written row: texts are read
   once and never shuffled. Only terms of the block are posted, as no other scores.
3. N, L and df are sums over the windows.
4. Windows are traversed one by one. A posting's share is worked out once for all queries. For each query
   the shares of its terms are scatter-added into an array of WINDOW scores, which stays in the
   processor's cache, and the terms' bitsets are or-ed into the bitset of occupied places; those alone
   are harvested, into a heap of the TOP best that the task keeps for each query.
5. The tasks' heaps meet by query.

Nulls and ties: a null text has no terms; documents without terms count for nothing; equal scores stand
by ascending id, a null id last; repeated rows are documents of their own. Query texts without terms, or
whose terms no document holds, get no rows; rows that repeat a query's id are queries of their own, each
with its ranks. An empty table gives an empty result. Extra columns are not read. Memory: a window's
postings, and a block of queries.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import read_documents, saved, table

TOP = 10
#: Documents of a window, and most postings after which one is closed before it is full.
WINDOW, WINDOW_POSTINGS = 2048, 1 << 20
#: Terms of a block of query texts.
BLOCK_TERMS = 1 << 20

#: A text's bytes with A-Z lower-cased and all that is no term's a blank.
TERMS = bytes(tb.LOWER[b] if tb.LETTER_DIGIT[b] else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


_POSTINGS = "n_docs long, n_terms long, ids array<string>, sizes binary, term binary, start binary, place binary, tf binary"


class _Window:
    """Postings of documents as they come."""

    def __init__(self) -> None:
        self.ids: list[str | None] = []
        self.sizes: list[int] = []
        self.terms: list[int] = []
        self.places: list[int] = []
        self.tf: list[int] = []

    def add(self, id_: str | None, size: int, found: dict[int, int]) -> None:
        self.terms += found
        self.tf += found.values()
        self.places += [len(self.ids)] * len(found)
        self.ids.append(id_)
        self.sizes.append(size)

    def full(self) -> bool:
        return len(self.ids) >= WINDOW or len(self.terms) >= WINDOW_POSTINGS

    def row(self) -> pa.RecordBatch:
        term = np.array(self.terms, dtype=np.int32)
        order = np.argsort(term, kind="stable")
        distinct, start = np.unique(term[order], return_index=True)
        place, tf = np.array(self.places, dtype=np.int32)[order], np.array(self.tf, dtype=np.int64)[order]
        sizes = np.array(self.sizes, dtype=np.int64)
        values = [len(self.ids), int(sizes.sum()), self.ids, sizes.tobytes(), distinct.astype(np.int32).tobytes(), np.append(start, len(term)).astype(np.int32).tobytes(), place.tobytes(), tf.tobytes()]
        types = [pa.int64(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[f.split()[0] for f in _POSTINGS.split(", ")])


def postings(df: DataFrame, vocabulary: dict[bytes, int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each window of documents with a term: its ids, sizes, and postings of the terms in ``vocabulary`` (by number)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, window = shared.value, _Window()
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                count = Counter(words)
                window.add(id_.as_py(), len(words), {known[w]: count[w] for w in known.keys() & count.keys()})
                if window.full():
                    yield window.row()
                    window = _Window()
        if window.ids:
            yield window.row()

    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    return rows.mapInArrow(run, _POSTINGS)


def shares(sizes: np.ndarray, place: np.ndarray, tf: np.ndarray, n: int, total: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 8 * m) of each posting, in whole numbers of any size."""
    if len(sizes) and 75 * int(sizes.max()) * n >= 1 << 63:
        m = np.array([25 + 75 * s * n // total for s in sizes.tolist()], dtype=np.int64)
    else:
        m = 25 + 75 * sizes * n // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m[place])


def _better(id_: object, score: int) -> tuple:
    return -score, id_ is None, id_ if id_ is not None else 0


def scored(windows: DataFrame, queries: list[dict[int, int]], weights: np.ndarray, n: int, total: int, top: int, id_type: str, number) -> DataFrame:
    """query (its place in ``queries``), doc_id (as text) and score: the best of each task."""
    shared = windows.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = shared.value
        best: list[list[tuple[tuple, str | None]]] = [[] for _ in asked]
        scores = np.zeros(WINDOW, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                ids = row["ids"]
                term, start, place, tf = (np.frombuffer(row[c], dtype=t) for c, t in (("term", np.int32), ("start", np.int32), ("place", np.int32), ("tf", np.int64)))
                share = shares(np.frombuffer(row["sizes"], dtype=np.int64), place, tf, n, total) * np.repeat(w[term], np.diff(start))
                held = {}
                for t, a, b in zip(term.tolist(), start[:-1].tolist(), start[1:].tolist(), strict=True):
                    bits = np.zeros(WINDOW, dtype=bool)
                    bits[place[a:b]] = True
                    held[t] = place[a:b], share[a:b], int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
                for heap, query in zip(best, asked, strict=True):
                    occupied = 0
                    for t, times in query.items():
                        if t in held:
                            at, value, bits = held[t]
                            scores[at] += value if times == 1 else value * times
                            occupied |= bits
                    if not occupied:
                        continue
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(occupied.to_bytes(WINDOW // 8, "little"), dtype=np.uint8), bitorder="little"))
                    got = scores[at]
                    scores[at] = 0
                    least = max(1, -heap[-1][0][0]) if len(heap) >= top else 1
                    for k in np.flatnonzero(got >= least).tolist() if top else ():
                        id_ = ids[at[k]]
                        heap.append((_better(number(id_), int(got[k])), id_))
                    if len(heap) > top:
                        heap[:] = heapq.nsmallest(top, heap, key=lambda x: x[0])
                    else:
                        heap.sort(key=lambda x: x[0])
        rows = [(q, id_, -key[0]) for q, heap in enumerate(best) for key, id_ in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["query", "doc_id", "score"])

    return windows.mapInArrow(run, "query int, doc_id string, score long").withColumn("doc_id", F.col("doc_id").cast(id_type))


def _whole(id_: str | None) -> int | None:
    return None if id_ is None else int(id_)


def _as_text(id_: str | None) -> bytes | None:
    return None if id_ is None else id_.encode()


def _block(docs: DataFrame, items: list, top: int, text_col: str, id_col: str) -> DataFrame:
    """query (its place in ``items``), doc_id, score and rank."""
    vocabulary: dict[bytes, int] = {}
    queries = [dict(Counter(vocabulary.setdefault(w, len(vocabulary)) for w in terms(text))) for text in items]
    windows = saved(postings(docs, vocabulary, text_col, id_col), "postings")
    n, total = windows.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for term, start in zip(batch.column(0), batch.column(1), strict=True):
                df[np.frombuffer(term.as_py(), dtype=np.int32)] += np.diff(np.frombuffer(start.as_py(), dtype=np.int32))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held], pa.int64())], names=["term", "df"])

    weights = np.zeros(len(vocabulary), dtype=np.int64)
    held = windows.select("term", "start").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in held.toLocalIterator():  # at most the terms of a block
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    kind = docs.schema[id_col].dataType
    whole = kind.simpleString() in ("tinyint", "smallint", "int", "bigint")
    best = scored(windows, queries, weights, n, total, top, kind, _whole if whole else _as_text)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, text_col: str = "text", id_col: str = "doc_id", query_text_col: str = "text", query_id_col: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id (under its own name), rank (from 1), doc_id and score: the ``top`` documents of each query text with a score over 0.

    Ids are whole numbers or texts."""
    spark = docs.sparkSession
    asked = saved(queries.select(F.monotonically_increasing_id().alias("number"), F.col(query_id_col).alias("item"), F.coalesce(F.col(query_text_col), F.lit("")).cast("binary").alias("said")), "queries")
    about = F.octet_length("said") / 2 + 1  # no text of so many bytes holds more terms
    n_blocks = max(1, math.ceil((asked.agg(F.sum(about)).first()[0] or 0) / block_terms))
    parts = []
    for k in range(n_blocks):
        of = F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == k
        items = asked.where(of).orderBy("number").collect()  # one block: BLOCK_TERMS bounds it
        if not items:
            continue
        found = _block(docs, [bytes(r["said"]) for r in items], top, text_col, id_col)
        named = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(items)], f"_q int, item {asked.schema['item'].dataType.simpleString()}")
        parts.append(found.join(F.broadcast(named), F.col("query") == F.col("_q")).select(F.col("item").alias(query_id_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score"))
    if not parts:
        return docs.limit(0).select(F.lit(None).cast(asked.schema["item"].dataType).alias(query_id_col), F.lit(0).alias("rank"), F.col(id_col), F.lit(0).cast("long").alias("score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT r, doc_id, len(ws)::BIGINT AS n, ws FROM a WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(ws) AS term FROM i) GROUP BY ALL),
t AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, nn),
c AS (SELECT q.i, q.item_id, t.r, t.doc_id, sum(q.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * t.n * s.nn) // s.ll))))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM c WHERE score > 0) WHERE rank <= 10
"""
