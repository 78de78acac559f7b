"""Segments of an utterance on its time axis, and scores of its sentences: folds over arrays in a row."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .text import collapse_space, strip

_SEGMENT = "struct<start_ms:long,end_ms:long,text:string>"
_SCORE = "struct<text:string,score:double>"


def sentences(text: Column) -> Column:
    """Cut after 。！？!?; blank ones go."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？!?])"), lambda x: strip(x)), lambda x: x != "")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once a row: what stands within a lambda is made again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clauses(text: Column, dur_ms: Column) -> Column:
    """Cut after , . ? ! — ; : where a part holds a letter or digit. A text without these marks goes
    in runs of 8 to 12 words, about 2 seconds each; one of which nothing is left goes whole."""
    marks = r"[,.?!—;:]"
    said = F.filter(F.transform(F.split(text, rf"(?<={marks})\s*"), lambda x: strip(x)), lambda x: x.rlike(r"[\p{L}\p{N}_]"))

    def runs(words: Column) -> Column:
        per = F.greatest(F.lit(8), F.least(F.lit(12), F.floor(F.size(words) / F.greatest(F.lit(1.0), dur_ms / 2000.0)).cast("int")))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / per).cast("int")), lambda i: F.array_join(F.slice(words, i * per + 1, per), " "))

    parts = F.when(text.rlike(marks), said).otherwise(_let(F.split(collapse_space(text), " "), runs))
    return _let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(strip(text))))


def time_axis(texts: Column, weights: Column, start: Column, end: Column) -> Column:
    """Segments whose share of the time is that of their weights; each end is cut to whole ms and
    starts the next, the last is the end."""

    def axis(parts: Column, total: Column) -> Column:
        n = F.size(parts)

        def step(a: Column, i: Column) -> Column:
            until = F.least(end, F.floor(a["at"] + F.get(parts, i)["w"] * ((end - start) / total)))
            until = F.when(i == n - 1, end).otherwise(until)
            one = F.struct(a["at"].alias("start_ms"), until.alias("end_ms"), F.get(parts, i)["t"].alias("text")).cast(_SEGMENT)
            return F.struct(until.cast("long").alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

        zero = F.struct(start.cast("long").alias("at"), F.array().cast(f"array<{_SEGMENT}>").alias("out"))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda a: a["out"])).otherwise(F.array().cast(f"array<{_SEGMENT}>"))

    parts = F.zip_with(texts, weights, lambda t, w: F.struct(t.alias("t"), w.alias("w")))
    return _let(parts, lambda p: _let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x["w"]), lambda total: axis(p, total)))


def merge_short(segments: Column, least_ms: int = 500) -> Column:
    """Segments under ``least_ms`` join the one before; a short first one the second."""

    def joined(a: Column, b: Column) -> Column:
        return F.struct(a["start_ms"].alias("start_ms"), b["end_ms"].alias("end_ms"), F.concat(F.rtrim(a["text"]), F.lit(" "), b["text"]).alias("text")).cast(_SEGMENT)

    short = lambda s: s["end_ms"] - s["start_ms"] < least_ms

    def step(a: Column, s: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        return F.when((F.size(a) > 0) & short(s), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined(last, s)))).otherwise(F.concat(a, F.array(s)))

    def first(a: Column) -> Column:
        rest = F.slice(a, 3, F.greatest(F.size(a) - 2, F.lit(0)))
        return F.when((F.size(a) > 1) & short(F.get(a, F.lit(0))), F.concat(F.array(joined(F.get(a, F.lit(0)), F.get(a, F.lit(1)))), rest)).otherwise(a)

    return F.aggregate(segments, F.array().cast(f"array<{_SEGMENT}>"), step, first)


#: Words spoken a second, windows that aren't cut; fixed values.
TARGET_WPS, WHOLE_MS = 2.5, 1500


def resegment(text: Column, start: Column, end: Column, least_ms: int = 500) -> Column:
    """Clauses of a text on its time axis by their words, short ones merged. A window under WHOLE_MS
    isn't cut; without a text or a window there are none."""
    dur = end - start

    def cut(parts: Column) -> Column:
        weights = F.transform(parts, lambda p: F.size(F.split(collapse_space(p), " ")) / F.lit(TARGET_WPS) * 1000.0)
        return merge_short(time_axis(parts, weights, start, end), least_ms)

    whole = F.array(F.struct(start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), strip(text).alias("text")).cast(_SEGMENT))
    none = F.array().cast(f"array<{_SEGMENT}>")
    return F.when((strip(text) == "") | (dur <= 0), none).when(dur < WHOLE_MS, whole).otherwise(_let(clauses(text, dur), cut))


#: Marks and blanks that no character of speech stands for; fixed values.
SILENT = "，。！？、；：\"'（）…—\\s,\\.!?\\-"


def sentence_scores(texts: Column, scores: Column) -> Column:
    """text and score, the mean of its characters' scores, of each sentence. Sentences follow one
    another; marks and blanks have no score, sentences of them alone and those past the scores go."""

    def step(a: Column, t: Column) -> Column:
        n = F.length(F.regexp_replace(t, f"[{SILENT}]", ""))
        mine = F.slice(scores, a["at"] + 1, n)
        one = F.struct(t.alias("text"), (F.aggregate(mine, F.lit(0.0), lambda s, x: s + x) / F.size(mine)).alias("score")).cast(_SCORE)
        return F.struct((a["at"] + n).alias("at"), F.when((n > 0) & (F.size(mine) > 0), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SCORE}>").alias("out"))
    return F.aggregate(texts, zero, step, lambda a: a["out"])


@F.pandas_udf(ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("text", StringType())])))
def _walked(texts: pd.Series, chars: pd.Series) -> pd.Series:
    """The first and last place of each sentence's characters in a text of one character a mark."""
    silent = re.compile(f"[{SILENT}]")

    def walk(ts, marks: str | None) -> list[tuple[int, int, str]] | None:
        if ts is None or marks is None:
            return None
        out, at = [], 0
        for t in ts:
            first = last = -1
            scan = at
            for c in silent.sub("", t):
                scan = marks.find(c, scan) + 1
                if not scan:
                    break
                last = scan - 1
                first = last if first < 0 else first
            if first >= 0:
                out.append((first, last, t))
                at = last + 1
        return out

    return pd.Series([walk(t, m) for t, m in zip(texts, chars, strict=True)], dtype=object)


def align_sentences(texts: Column, marks: Column) -> Column:
    """Start and end of each sentence by one walk over marks (text of one character, start and end in
    seconds): its characters but marks and blanks, each the next one that equals it. A sentence of
    which no character is found goes; one that would take no time ends where the next mark starts,
    or after 200 ms. Only the marks' characters go to Python, places of them come back."""
    char = lambda m: F.when(F.length(m["text"]) == 1, m["text"]).otherwise(F.lit(" "))  # noqa: E731  a blank is never looked for
    found = _walked(texts, F.array_join(F.transform(marks, char), ""))

    def timed(m: Column, found: Column) -> Column:
        ms = lambda k, side: (F.get(m, k)[side] * 1000).cast("long")

        def one(s: Column) -> Column:
            start, end = ms(s["first"], "start"), ms(s["last"], "end")
            until = F.when((end <= start) & (s["last"] + 1 < F.size(m)), ms(s["last"] + 1, "start")).otherwise(end)
            return F.struct(start.alias("start_ms"), F.when(until > start, until).otherwise(start + 200).alias("end_ms"), s["text"].alias("text"))

        return F.transform(found, one)

    return F.get(F.zip_with(F.array(marks), F.array(found), timed), F.lit(0))
