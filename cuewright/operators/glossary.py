"""Glossary terms in texts.

A glossary is cut into blocks of at most BLOCK_BYTES. A block's terms, and the words that tell what an
ambiguous one means, become one Aho-Corasick automaton in each Python worker; every text is walked
through it once, where it lies. Texts aren't shuffled: what comes out is a text's key beside the terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.shared import written
from .containment import held

#: Most bytes of the terms of an automaton.
BLOCK_BYTES = 4 << 20

_loaded: dict[str, tuple] = {}


class _Block:
    """An automaton over some terms and their indicators."""

    def __init__(self, entries: list[tuple]):
        import ahocorasick

        self.entries = entries
        numbers: dict[str, int] = {}
        self.of: dict[int, list[int]] = {}  # entries by the number of their term
        self.told: list[frozenset[int] | None] = []
        for k, (src, _, _, indicators) in enumerate(entries):
            self.of.setdefault(numbers.setdefault(src, len(numbers)), []).append(k)
            self.told.append(None if indicators is None else frozenset(numbers.setdefault(w, len(numbers)) for w in indicators if w is not None))
        self.everywhere = {numbers[""]} if "" in numbers else set()
        self.automaton = ahocorasick.Automaton()
        for word, number in numbers.items():
            if word:
                self.automaton.add_word(word, number)
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[int]:
        """Entries whose term stands in a text, ambiguous ones with an indicator."""
        found = set(self.everywhere)
        if len(self.automaton):
            found.update(number for _, number in self.automaton.iter(text))
        return [k for number in sorted(found) for k in self.of.get(number, ()) if self.told[k] is None or not found.isdisjoint(self.told[k])]


def _block(name: str, entries: list[tuple]) -> _Block:
    """A Python worker serves many tasks and keeps the last block."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = _Block(entries)
    return _loaded[name]


def _meeting(texts: DataFrame, glossary: DataFrame, text: str, key: str, output: str | None = None) -> DataFrame:
    """key, src and target of each term that stands in a text, an ambiguous one with one of its indicators; of
    those whose target isn't in the ``output`` (any case), where one is given."""
    width = F.octet_length("src") + F.coalesce(F.octet_length(F.array_join("indicators", ",")), F.lit(0)) + 8
    terms = written(glossary.where("src IS NOT NULL").select("src", "target", F.lower("target").alias("lowered"), F.col("indicators").cast("array<string>").alias("indicators")), "glossary")
    n_blocks = max(1, -(-(terms.agg(F.sum(width.cast("long"))).first()[0] or 0) // BLOCK_BYTES))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_text"), *([F.lower(output).alias("_output")] if output else []))
    schema = StructType([rows.schema[0], StructField("src", StringType()), StructField("target", StringType())])
    parts = []
    for n in range(n_blocks):
        block = terms.where(F.pmod(F.xxhash64("src"), F.lit(n_blocks)) == n).collect()  # BLOCK_BYTES bounds it
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            block = _loaded.get(name) or _block(name, shared.value)
            for batch in batches:
                at, found = [], []
                outputs = batch.column(2) if output else None
                for k, value in enumerate(batch.column(1)):
                    hits = block.hits(value.as_py())
                    if hits and outputs is not None:
                        said = outputs[k].as_py()
                        hits = [h for h in hits if said is not None and block.entries[h][2] is not None and block.entries[h][2] not in said]
                    at += [k] * len(hits)
                    found += [block.entries[h] for h in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array([e[c] for e in found], pa.string()) for c in (0, 1))], names=[batch.schema.names[0], "src", "target"])

        parts.append(rows.mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def term_hits(texts: DataFrame, glossary: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """key and hits (src:target by term) of the texts that hold a term. Glossary: src, target, indicators (null: not ambiguous)."""
    return _meeting(texts, glossary, text, key).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "src", "target"))), ",").alias("hits"))


def violations(texts: DataFrame, glossary: DataFrame, text: str, output: str, key: str = "id") -> DataFrame:
    """key and src where a term stands in a text (an ambiguous one with an indicator) and its target not in the output (any case)."""
    return _meeting(texts, glossary, text, key, output).select(key, "src")


def fuzzy_match(sentences: DataFrame, segments: DataFrame, by: str) -> DataFrame:
    """For each sentence the first segment of the same ``by`` that equals it, holds it or is held by it.

    Null texts match nothing; an empty text is held by every text of its group."""
    s = sentences.select(by, "sentence").distinct()
    g = segments.where("segment IS NOT NULL").groupBy(by, "segment").agg(F.min("segment_id").alias("least"))
    inner, outer = F.col("segment").alias("inner"), F.col("segment").alias("outer")
    within = held(g.select(by, inner, "least"), s.select(by, F.col("sentence").alias("outer")), by, F.col("least")).select(by, F.col("outer").alias("sentence"), "least")
    around = held(s.select(by, F.col("sentence").alias("inner")), g.select(by, outer, "least"), by, F.col("least")).select(by, F.col("inner").alias("sentence"), "least")
    of_all = g.groupBy(by).agg(F.min("least").alias("any"), F.min(F.when(F.col("segment") == "", F.col("least"))).alias("empty"))
    rest = s.where("sentence IS NOT NULL").join(of_all, by).select(by, "sentence", F.when(F.col("sentence") == "", F.col("any")).otherwise(F.col("empty")).alias("least"))
    found = within.unionByName(around).unionByName(rest).groupBy(by, "sentence").agg(F.min("least").alias("segment_id")).where("segment_id IS NOT NULL")
    return sentences.select(by, "sentence_id", "sentence").join(found, [by, "sentence"]).groupBy(by, "sentence_id").agg(F.min("segment_id").alias("segment_id"))


def listing(glossary: DataFrame, dramas: DataFrame, drama_id: int | None = None, user_id: int | None = None) -> DataFrame:
    """id, drama_id, drama_name, type, src, target of a drama's entries, of those of a user's dramas, or of all, in order.

    A drama's entries, and all, stay where the drama isn't known; a user's dramas are known ones."""
    d = dramas.select(F.col("id").alias("_d"), F.col("name").alias("drama_name"), F.col("user_id").alias("_user"))
    of = glossary if drama_id is None else glossary.where(F.col("drama_id") == drama_id)
    told = of.join(d, F.col("drama_id") == F.col("_d"), "left")
    if drama_id is None and user_id is not None:
        told = told.where(F.col("_user") == user_id)
    return told.select("id", "drama_id", "drama_name", "type", "src", "target").orderBy("drama_id", "type", "src")


def name_report(texts: DataFrame, names: str, key: str = "id", group: str = "episode_id") -> DataFrame:
    """name, n (uses), n_groups and n_texts of an array column of names, most used first by n."""
    each = texts.select(key, group, F.explode(names).alias("name"))
    return each.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("n_groups"), F.count_distinct(key).alias("n_texts"))
