"""Parsing of numbered translations, and text rules that walk a text in order (batches of Arrow)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import CLAUSE_MARKS, clean_output, collapse_space, strip

#: A numbered text up to the next number, what numbers a plain line, a tag and the line after it; fixed values.
NUMBERED = r"(?s)\[(\d{1,9})\]\s*(.+?)(?=\s*\[\d+\]|\z)"
NUMBER_OF_LINE = r"^\[?\d+\]?\s*[:.\-]?\s*"
TAGGED = r"(?smd)<<<(\d+)>>>\s*\n(.*?)(?=\n<<<\d+>>>|$)"


def numbered_output(text: Column, n: Column | int) -> Column:
    """n texts from "[i] text" (over lines, up to the next number): the last of a number wins, missing are
    empty. Without any, the lines themselves, without what numbers them."""
    n = F.lit(n) if isinstance(n, int) else n
    text = strip(text)
    found = F.arrays_zip(F.transform(F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1)), lambda x: x.cast("int")).alias("k"), F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(2)).alias("t"))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != "")
    wanted = F.sequence(F.lit(1), n)
    numbered = F.transform(wanted, lambda i: F.coalesce(strip(F.try_element_at(F.filter(found, lambda z: z["k"] == i), F.lit(-1))["t"]), F.lit("")))
    plain = F.transform(wanted, lambda i: F.coalesce(strip(F.regexp_replace(F.get(lines, i - 1), NUMBER_OF_LINE, "")), F.lit("")))
    return F.when(n < 1, F.array().cast("array<string>")).when(F.exists(numbered, lambda x: x != ""), numbered).otherwise(plain)


def simple_output(text: Column, n: int) -> Column:
    """Lines without leading numbers, filled up or cut to n."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, r"^[0-9. ]+", ""))), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.get(lines, i - 1), F.lit("")))


def tagged_output(text: Column, n: int) -> Column:
    """n texts from tags <<<0>>>, <<<1>>>, ... on lines of their own: the line after a tag (blank ones
    skipped), the last of a number wins, missing are empty."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(TAGGED), F.lit(1)), lambda x: x.try_cast("int"))
    found = F.arrays_zip(numbers.alias("k"), F.regexp_extract_all(text, F.lit(TAGGED), F.lit(2)).alias("t"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(strip(F.try_element_at(F.filter(found, lambda z: z["k"] == i), F.lit(-1))["t"]), F.lit("")))


def corpus_context(scene: Column, hotwords: Column) -> Column:
    """The context of a recognizer as JSON: the scene, then the hot words in one text; null without both."""
    words = F.when(F.size(hotwords) > 0, F.concat(F.lit("常见词汇："), F.array_join(hotwords, "、")))
    data = F.filter(F.array(F.struct(F.nullif(scene, F.lit("")).alias("text")), F.struct(words.alias("text"))), lambda x: x["text"].isNotNull())
    return F.when(F.size(data) > 0, F.to_json(F.struct(F.lit("dialog_ctx").alias("context_type"), data.alias("context_data"))))


def json_update(old: Column, new: Column) -> Column:
    """A JSON object with the fields of ``new`` put over it (whole values, nested ones too); old fields keep their
    places. What is null, or no object, has no fields; of a field that comes twice the last counts."""
    kind = "map<string,variant>"

    def fields(c: Column) -> Column:
        found = F.map_entries(F.coalesce(F.from_json(c, kind), F.from_json(F.lit("{}"), kind)))
        later = lambda e, i: F.exists(F.slice(found, i + 2, F.size(found)), lambda x: x["key"] == e["key"])
        return F.map_from_entries(F.filter(found, lambda e, i: ~later(e, i)))

    a, b = fields(old), fields(new)
    kept = F.transform(F.map_entries(a), lambda e: F.struct(e["key"].alias("key"), F.when(F.map_contains_key(b, e["key"]), F.try_element_at(b, e["key"])).otherwise(e["value"]).alias("value")))
    added = F.filter(F.map_entries(b), lambda e: ~F.map_contains_key(a, e["key"]))
    return F.to_json(F.map_from_entries(F.concat(kept, added)))


def split_at_ratio(text: Column, ratio: Column) -> Column:
    """Two parts of a text, cut at the mark nearest the ratio (the one at or after it of two as near),
    which goes; at the ratio itself, but after a character at least, without a mark."""
    want = F.floor(F.length(text) * ratio + 0.5).cast("int")
    left, right = F.substring(text, F.lit(1), want), F.substring(text, want + 1, F.length(text))
    after = F.length(F.regexp_extract(right, rf"(?s)^([^{CLAUSE_MARKS}]*)[{CLAUSE_MARKS}]", 1))
    before = F.length(F.regexp_extract(left, rf"(?s)[{CLAUSE_MARKS}]([^{CLAUSE_MARKS}]*)\z", 1))
    has = lambda part: part.rlike(f"[{CLAUSE_MARKS}]")
    at = F.when(has(right) & (~has(left) | (after <= before)), want + after).when(has(left), want - 1 - before)
    cut = F.greatest(F.lit(1), want)
    return F.array(F.substring(text, F.lit(1), F.coalesce(at, cut)), F.substring(text, F.coalesce(at + 1, cut) + 1, F.length(text)))


def name_variants(a: str, b: str) -> list[str]:
    """Spellings that a translation may give a two-part name: an apostrophe or nothing between."""
    return [f"{a}'{b.lower()}", f"{a}{b.lower()}"]


#: Rows that are Python objects at once; the rest of a batch stays in Arrow.
ROWS = 256


def _row_by_row(f: Callable[..., str | None], *columns: pa.Array) -> pa.Array:
    starts = range(0, len(columns[0]), ROWS)
    return pa.concat_arrays([pa.array(map(f, *(c.slice(k, ROWS).to_pylist() for c in columns)), pa.string()) for k in starts] or [pa.array([], pa.string())])


_NAME_MARK = re.compile(r"<<NAME_(\d{1,9})(?::[^>]*)?>>")


def _restored(t: str | None, ns: list | None) -> str | None:
    return t if t is None or ns is None else _NAME_MARK.sub(lambda m: ns[int(m[1])] if int(m[1]) < len(ns) else m[0], t)


def _repaired(t: str | None, ns: list | None) -> str | None:
    for name in ns if t is not None and ns is not None else []:
        parts = name.split() if name else []
        if len(parts) != 2 or name.lower() in t.lower():
            continue
        for v in name_variants(*parts):
            t, n = re.subn(re.escape(v), lambda _, name=name: name, t, flags=re.IGNORECASE)
            if n:
                break
    return t


@F.arrow_udf(StringType())
def restore_names(text: pa.Array, names: pa.Array) -> pa.Array:
    """<<NAME_i>> and <<NAME_i:...>> by the i-th name; numbers without a name stay."""
    return _row_by_row(_restored, text, names)


@F.arrow_udf(StringType())
def repair_names(text: pa.Array, names: pa.Array) -> pa.Array:
    """Two-part names that a text lacks, put for the first of their spellings (of any case) that it holds."""
    return _row_by_row(_repaired, text, names)


@F.arrow_udf(StringType())
def restore_and_repair_names(text: pa.Array, names: pa.Array) -> pa.Array:
    """Both at once: one after the other, each text would go to Python twice, to two workers a task."""
    return _row_by_row(lambda t, ns: _repaired(_restored(t, ns), ns), text, names)


def finished_translation(text: Column, names: Column) -> Column:
    """A translation as it is stored: names restored and repaired, without placeholders, separators and Han
    characters, spaces as one. Names that are null aren't known; a null text is empty."""
    known = F.coalesce(names, F.array().cast("array<string>"))
    t = clean_output(restore_and_repair_names(F.coalesce(text, F.lit("")), known))
    return collapse_space(F.regexp_replace(t, "[\u4e00-\u9fff]+", ""))


def byte_range(header: Column, size: Column) -> Column:
    """start and end (inclusive) of the first range of a header like bytes=0-99, bytes=100- or
    bytes=-500 within ``size`` bytes; null where it isn't one or lies outside."""
    spec = F.trim(F.regexp_extract(header, r"^\s*bytes\s*=([^,]*)", 1))
    part = lambda pattern, k: F.regexp_extract(spec, pattern, k).cast("long")
    last, from_, both = r"^-(\d{1,18})$", r"^(\d{1,18})-$", r"^(\d{1,18})-(\d{1,18})(?:-.*[^-])?$"
    start = F.when(spec.rlike(last), F.greatest(F.lit(0), size - part(last, 1))).when(spec.rlike(from_), part(from_, 1)).when(spec.rlike(both), part(both, 1))
    end = F.when(spec.rlike(both), F.least(part(both, 2), size - 1)).otherwise(size - 1)
    return F.when((start <= F.when(spec.rlike(both), part(both, 2)).otherwise(end)) & (start < size), F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))


def atempo(rate: Column) -> Column:
    """A tempo as a chain of factors from 0.5 to 2."""
    up = F.greatest(F.lit(0), F.ceil(F.log2(rate)) - 1).cast("int")
    down = F.greatest(F.lit(0), F.ceil(-F.log2(rate)) - 1).cast("int")
    rest = rate / F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), down)
    return F.concat(F.array_repeat(F.lit(2.0), up), F.array_repeat(F.lit(0.5), down), F.array(rest))


@F.pandas_udf(StructType([StructField("masked", StringType()), StructField("names", ArrayType(StringType()))]))
def guard_names(text: pd.Series, names: pd.Series) -> pd.DataFrame:
    """Known names, longer ones first, as <<NAME_i>>, numbered by first use; and the names used."""

    def mask(t: str | None, ns) -> tuple[str | None, list[str]]:
        known = sorted({n for n in (ns if ns is not None else []) if n}, key=lambda n: (-len(n), n))
        used: list[str] = []
        if t is None or not known:
            return t, used

        def put(m: re.Match) -> str:
            if m[0] not in used:
                used.append(m[0])
            return f"<<NAME_{used.index(m[0])}>>"

        return re.sub("|".join(map(re.escape, known)), put, t), used

    return pd.DataFrame([mask(t, n) for t, n in zip(text, names, strict=True)], columns=["masked", "names"])


@F.pandas_udf(StringType())
def canonical_hash(document: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text in canonical form: without nulls and empty containers, keys sorted,
    no spaces. Null where it isn't JSON."""
    import hashlib
    import json

    def bare(x):
        if isinstance(x, dict):
            x = {k: bare(v) for k, v in x.items()}
            return {k: v for k, v in x.items() if v is not None and v != {} and v != []}
        if isinstance(x, list):
            return [y for y in map(bare, x) if y is not None and y != {} and y != []]
        return x

    def digest(t: str | None) -> str | None:
        try:
            x = json.loads(t) if t is not None else None
        except ValueError:
            return None
        return None if t is None else hashlib.sha256(json.dumps(bare(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return pd.Series([digest(t) for t in document])
