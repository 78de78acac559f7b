"""Quality of texts by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted in numpy inside tasks. Trees are grown in numpy on the
statistics of a bounded sample of labelled rows (SAMPLE): values fall into at most BINS bins
by quantile, and every level of a tree is chosen from sums of gradients by bin. They are
flattened into arrays, and all trees are walked at once, a level at a time, for batches of
documents.

Nulls and ties: a null or empty text has statistics of zero and is scored like any other; rows
whose label is null, and ids that are null, aren't learned from; an id with both labels is
learned from once for each; equal gains go to the first statistic and bin; without labels every
score is 0.5; repeated rows each come out; an empty table gives an empty result. Columns
besides the named ones aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import read_documents, table
from .language_id import held_out
from .quality_rules import count_texts

SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, SHRINK, LEAST = 64, 60, 4, 0.15, 1.0, 10

_CLASSES = {
    "upper": tb.byte_class(range(0x41, 0x5B)),
    "lower": tb.byte_class(range(0x61, 0x7B)),
    "digit": tb.byte_class(range(0x30, 0x3A)),
    "mark": tb.byte_class(*b"!?"),
    "stop": tb.byte_class(*b".,;:"),
    "symbol": tb.byte_class(*b"#*$%&|<>@^~_=+\\/{}[]"),
    "bar": tb.byte_class(*b"|"),
    "line": tb.byte_class(0x0A),
    "wide": tb.byte_class(range(0xC0, 0x100)),
    "character": tb.CHARACTER,
}
STATISTICS = ("words", "word_length", "symbols", "dup_lines", "repeats", "distinct", *_CLASSES, "line_words", "longest")


def statistics(texts: list[str | None]) -> np.ndarray:
    """(n, len(STATISTICS)) float32."""
    t = tb.Joined(texts)
    base = count_texts(texts)
    starts, ends, owner = t.runs(tb.NOT_BLANK)
    words = base["n_words"].astype(np.float64)
    over = np.maximum(words, 1)
    size = np.maximum(t.ends - t.starts, 1)
    lines = t.count(_CLASSES["line"]) + 1
    key = tb.mixed(tb.hashes(tb.LOWER[t.bytes], starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(owner[tb.first_of(key)], minlength=t.n) if len(key) else np.zeros(t.n)
    longest = np.zeros(t.n)
    np.maximum.at(longest, owner, (ends - starts).astype(np.float64))
    columns = [np.log1p(words), base["word_chars"] / over, base["n_symbols"] / over, base["n_dup_lines"] / lines, base["n_repeat_words"] / over, distinct / over]
    columns += [t.count(c) / size for c in _CLASSES.values()]
    columns += [words / lines, np.log1p(longest)]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Forest:
    """Complete trees as arrays: feature and threshold of inner nodes, value of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.prior)
        if len(self.feature):
            row, tree = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total = total + self.value[tree, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees for labels 0 and 1 by the logistic loss."""
    n, width = x.shape
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = (y.sum() + 1) / (n + 2)
    prior = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="lower")) for f in range(width)] if n else []
    if not n or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), prior if n else 0.0)
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(n, prior)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, dtype=np.int64)  # within the level
        for depth in range(DEPTH):
            k = 2**depth
            best = np.full(k, 1e-9)
            split = np.full(n, False)
            chosen = [(-1, 0)] * k
            for f in range(width):
                at = node * BINS + binned[:, f]
                gs, hs, cs = (np.bincount(at, w, minlength=k * BINS).reshape(k, BINS).cumsum(axis=1) for w in (g, h, None))
                left, right = slice(0, BINS - 1), slice(BINS - 1, BINS)
                score = lambda a, b: a * a / (b + SHRINK)
                gain = score(gs[:, left], hs[:, left]) + score(gs[:, right] - gs[:, left], hs[:, right] - hs[:, left]) - score(gs[:, right], hs[:, right])
                gain[(cs[:, left] < LEAST) | (cs[:, right] - cs[:, left] < LEAST)] = 0
                at_best = gain.argmax(axis=1)
                for i in np.flatnonzero(gain.max(axis=1) > best):
                    if at_best[i] < len(edges[f]):
                        best[i], chosen[i] = gain[i, at_best[i]], (f, int(at_best[i]))
            for i, (f, b) in enumerate(chosen):
                if f >= 0:
                    feature[k - 1 + i], threshold[k - 1 + i] = f, edges[f][b]
                    mine = node == i
                    split[mine] = binned[mine, f] > b
            node = 2 * node + split
        value = RATE * np.bincount(node, g, minlength=leaves) / (np.bincount(node, h, minlength=leaves) + SHRINK)
        total += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.stack(features), np.stack(thresholds), np.stack(values), prior)


def train(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """Trees for the labelled rows that aren't held out, at most about ``sample`` of them (drawn by hash of the id).

    The bound is one of labels, not of rows: of rows that repeat an id, one of each distinct label is learned from, the one
    whose text comes first."""
    known = labels.where(~held_out(id_col, 3, 1) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).distinct()
    n = known.count()
    steps = 1 << 40
    drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(steps)) < int(min(1.0, sample / max(1, n)) * steps))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["_text"].tolist()
            for a, b in tb.pieces(texts):
                yield pd.DataFrame({"y": pdf["_y"].to_numpy()[a:b], "x": list(statistics(texts[a:b]))})

    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(drawn), "_id")  # about ``sample`` rows
    rows = rows.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_y", "_text")
    got = rows.mapInPandas(run, "y double, x array<float>").toPandas()
    x = np.stack(got["x"].to_numpy()).astype(np.float32) if len(got) else np.zeros((0, len(STATISTICS)), np.float32)
    y = got["y"].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T, y))  # the same trees whatever order rows come in
    return grow(x[order], y[order])


def score(df: DataFrame, forest: Forest, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("_text").tolist()
            for a, b in tb.pieces(texts):
                yield pdf.iloc[a:b].assign(score=forest.score(statistics(texts[a:b])))

    rows = df.select(*(F.col(c).cast("string").alias(c) for c in keep), F.col(text_col).alias("_text"))
    out = rows.mapInPandas(run, ", ".join([*(f"`{c}` string" for c in keep), "score double"]))
    return out.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in keep), "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
