"""Language of texts by a convolutional network over bytes.

Filters of several widths slide over one-hot bytes (A-Z lowered) of fixed-length windows; the
largest response of each filter in a window goes through a softmax. The network is trained in
numpy on windows of a sample of labelled rows (SAMPLE documents, as many of each language and
about LEAST of each at least; SAMPLE_WINDOWS windows of each, spread over the whole text) and sent with the
task. The sample is bounded by documents: an id counts once however many rows repeat it, and of more than
LANGUAGES labels those with most documents are learned (a label a row would make the corpus the sample).
Every window of every whole text is scored, in batches; a text's language has the largest
mean probability over its windows, which is its score.

Nulls and ties: a null text, or one without a letter, is ``und`` with score 0; so is every text
where no row can be learned from; equal probabilities go to the first language by name; a null
id is never learned from; repeated rows each come out; an empty table gives an empty result.
Columns besides the named ones aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import read_documents

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE, SAMPLE_WINDOWS = 3000, 3
#: Documents drawn of each language at least, as expected; one is always drawn.
LEAST = 16
#: Languages learned at most, those with most documents, so that LANGUAGES * LEAST documents are drawn at most.
LANGUAGES = 1024
#: Steps of the hash by which documents are drawn.
_STEPS = 1 << 40
EPOCHS, BATCH, RATE = 10, 64, 0.01
#: Windows scored at once.
AT_ONCE = 256
_STRIDE = WINDOW - max(WIDTHS) + 1
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a letter (of any script; a number sign such as ½ is none)."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def windows(text: str) -> np.ndarray:
    """Every window of a text's bytes: (n, WINDOW) uint8. Neighbours share what the widest filter needs."""
    data = tb.LOWER[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    n = max(1, -(-(len(data) - (WINDOW - _STRIDE)) // _STRIDE))
    padded = np.full((n - 1) * _STRIDE + WINDOW, 0x20, dtype=np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STRIDE]


class Network:
    """Tables (width, 256, FILTERS) of each width, a bias for each filter, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3 / w**0.5, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)

    def responses(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for w, t in zip(WIDTHS, self.tables, strict=True):
            n = x.shape[1] - w + 1
            r = t[0][x[:, :n]]
            for k in range(1, w):
                r += t[k][x[:, k : k + n]]
            yield r

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Slopes of the mean log loss of windows x with labels y, by the weights in order."""
        places = [r.argmax(axis=1) for r in self.responses(x)]
        row, col = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        pooled = np.concatenate([sum(t[k][x[row, p + k], col] for k in range(w)) for w, t, p in zip(WIDTHS, self.tables, places, strict=True)], axis=1)
        p = self.probabilities(pooled)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        hidden = np.maximum(pooled, 0)
        back = (p @ self.out.T) * (pooled > 0)
        slopes = []
        for i, (w, t) in enumerate(zip(WIDTHS, self.tables, strict=True)):
            g = np.zeros_like(t)
            for k in range(w):
                np.add.at(g[k], (x[row, places[i] + k], np.broadcast_to(col, places[i].shape)), back[:, i * FILTERS : (i + 1) * FILTERS])
            slopes.append(g)
        return [*slopes, hidden.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        weights = [*self.tables, self.out, self.bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                batch = order[at : at + BATCH]
                step += 1
                for w_, g, m, v in zip(weights, self.gradients(x[batch], y[batch]), first, second, strict=True):  # Adam
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


class Scorer:
    """A trained network with the tables of neighbouring bytes summed beforehand."""

    def __init__(self, network: Network):
        self.network = network
        self.pairs = []
        for w, t in zip(WIDTHS, network.tables, strict=True):
            pair = [(k, (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS)) for k in range(0, w - 1, 2)]
            self.pairs.append((w, pair, [(w - 1, t[w - 1])] if w % 2 else []))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = []
        for w, pairs, singles in self.pairs:
            n = x.shape[1] - w + 1
            r = None
            for k, t in pairs:
                got = np.take(t, two[:, k : k + n], axis=0)
                r = got if r is None else np.add(r, got, out=r)
            for k, t in singles:
                r += np.take(t, x[:, k : k + n], axis=0)
            out.append(r.max(axis=1))
        return np.concatenate(out, axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.network.probabilities(self.pooled(x[a : a + AT_ONCE])) for a in range(0, len(x), AT_ONCE)])


def held_out(id_col: str = "doc_id", mod: int = 4, rest: int = 2) -> Column:
    """Whether a row isn't learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(True))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Network | None:
    """A network for the rows that aren't held out; None where there are none."""
    rows = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(_STEPS)).alias("at"))
    # ids are counted by a sketch, repeated ones once
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n"), F.min("at").alias("first"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    each = max(sample / len(languages), LEAST)
    below = [(r["lang"], max(each / max(r["n"], 1) * _STEPS, r["first"] + 1.0)) for r in counts]
    drawn = rows.join(F.broadcast(df.sparkSession.createDataFrame(below, "lang string, below double")), "lang").where("at < below")  # at most LANGUAGES rows
    drawn = drawn.groupBy("lang", "at").agg(F.min("text").alias("text"))  # rows that repeat an id are one

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if has_letter(text):
                    w = windows(text)
                    out += [(lang, w[i].tobytes()) for i in sorted({int(i) for i in np.linspace(0, len(w) - 1, SAMPLE_WINDOWS)})]
            yield pd.DataFrame(out, columns=["lang", "window"])

    got = drawn.select("lang", "text").mapInPandas(cut, "lang string, window binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "window"])
    x = np.frombuffer(b"".join(got["window"]), dtype=np.uint8).reshape(-1, WINDOW)
    return Network(languages).fit(x, np.searchsorted(languages, got["lang"].to_numpy(dtype=str)))


def predict(df: DataFrame, network: Network | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(network) if network else None
        for pdf in batches:
            texts = [t if has_letter(t) else "" for t in pdf.pop("_text")]
            langs, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            for a, b in tb.pieces(texts) if scorer else ():
                at = [i for i in range(a, b) if texts[i]]
                if at:
                    parts = [windows(texts[i]) for i in at]
                    p = scorer.score(np.concatenate(parts))
                    sizes = np.array([len(w) for w in parts])
                    mean = np.add.reduceat(p, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
                    langs[at] = np.array(network.languages, dtype=object)[mean.argmax(axis=1)]
                    scores[at] = np.clip(mean.max(axis=1), 0, 1)
            yield pdf.assign(lang_pred=langs, score=scores)

    rows = df.select(*(F.col(c).cast("string").alias(c) for c in keep), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = rows.mapInPandas(run, ", ".join([*(f"`{c}` string" for c in keep), "lang_pred string", "score double"]))
    return out.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in keep), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
