"""Samples that models learn from are bounded, whatever repeats or labels there are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cuewright.llm import language_id, quality_classifier


def _seen(monkeypatch):
    seen = []

    def fit(self, x, y):
        seen.append((list(self.languages), len(x), np.bincount(y, minlength=len(self.languages))))
        return self

    monkeypatch.setattr(language_id.Network, "fit", fit)
    return seen


def test_a_repeated_id_is_learned_from_once(spark, monkeypatch):
    seen = _seen(monkeypatch)
    docs = spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("words of row "), "id").alias("text"), F.lit("a").alias("lang"))
    docs = docs.union(spark.range(100, 200).select("id", F.lit("another text"), F.lit("b")))
    language_id.train(docs)
    languages, n, each = seen[0]
    kept = docs.where(~language_id.held_out()).select("doc_id", "lang").distinct().count()
    assert n == kept and languages == (["a", "b"] if each[0] else ["b"])


def test_a_label_a_row_does_not_make_the_corpus_the_sample(spark, monkeypatch):
    seen = _seen(monkeypatch)
    monkeypatch.setattr(language_id, "LANGUAGES", 20)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.concat(F.lit("z"), "id").alias("lang"))
    docs = docs.union(spark.range(3000, 3400).select("id", F.lit("more words"), F.lit("common")))
    language_id.train(docs, sample=60)
    languages, n, each = seen[0]
    assert len(languages) == 20 and "common" in languages
    assert n <= 19 + 60  # a document of each rare label and about LEAST of the common one


def test_labels_of_a_repeated_id_are_learned_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "grow", lambda x, y: seen.append((x, y)))
    docs = spark.range(4000).select(F.when(F.col("id") < 3900, F.lit(2).cast("long")).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(4000).select((F.col("id") % 7).alias("doc_id"), F.lit(1).alias("quality")).union(spark.range(3900, 4000).select("id", F.lit(0)))
    quality_classifier.train(docs, labels)
    x, y = seen[0]
    known = labels.where(~quality_classifier.held_out("doc_id", 3, 1)).distinct().join(docs, "doc_id", "left_semi").count()
    assert len(x) == len(y) == known and known < 110
