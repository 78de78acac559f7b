"""Text rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that a line may lose at its end; fixed values.
TRAILING_MARKS = "，。,.、；：;:"
_SPACE = r"[\s\u0085   -     　]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{_SPACE}|{_SPACE}\z", "")


def normalize(text: Column) -> Column:
    """Wide spaces to plain ones, runs of spaces to one, none at the ends."""
    return F.regexp_replace(strip(F.translate(text, "　", " ")), " +", " ")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def strip_trailing_marks(text: Column) -> Column:
    """Null where nothing is left."""
    left = F.regexp_replace(strip(text), f"[{TRAILING_MARKS}]+$", "")
    return F.when(strip(left) != "", left)


def clean_output(text: Column) -> Column:
    """A translation without name and slang placeholders; separators become spaces."""
    for pattern, by in ((r"<sep>", " "), (r"<<NAME_\d+(?::[^>]*)?>>", ""), (r"<SLANG:[^>]+>", "")):
        text = F.regexp_replace(text, pattern, by)
    return collapse_space(text)


#: Marks between clauses; fixed values.
CLAUSE_MARKS = "，。！？、；：,.!?;:"


def merge_texts(text: Column, following: Column) -> Column:
    """Two texts as one, with a comma between them where the first isn't empty and ends in no mark."""
    bare = (text != "") & ~text.rlike(rf"[{CLAUSE_MARKS}]\z")
    return F.concat(text, F.when(bare, F.lit("，")).otherwise(F.lit("")), following)


def only_marks(text: Column) -> Column:
    return text.rlike(r"^[\s\p{P}\p{S}]*$")


def count_class(text: Column, letters: str) -> Column:
    """Characters of a regex class."""
    return F.length(F.regexp_replace(text, f"[^{letters}]", "")).cast("long")


def timecode(ms: Column, mark: str = ",", legacy: bool = False) -> Column:
    """HH:MM:SS,mmm. ``legacy`` goes by binary seconds, truncated, and loses a millisecond now and then."""
    if legacy:
        ms = F.floor((ms / F.lit(1000.0)) * 1000)
    part = lambda by, mod: F.pmod(F.floor(ms / by), F.lit(mod)).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)).cast("long"))


def short_timecode(ms: Column) -> Column:
    """MM:SS.mmm; minutes aren't wrapped."""
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60_000).cast("long"), F.pmod(F.floor(ms / 1000), F.lit(60)).cast("long"), F.pmod(ms, F.lit(1000)).cast("long"))


def iso_utc(at: Column) -> Column:
    """A time (of a session in UTC) as 2024-01-01T00:00:00.123456+00:00, without the fraction where it is 0."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(at, "SSSSSS") != "000000", F.date_format(at, ".SSSSSS")).otherwise(F.lit("")), F.lit("+00:00"))


def name_style(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "keep").when(name.rlike(r"^(Mr\.|Ms\.) "), "honorific+surname").when(name.contains(" "), "pinyin").otherwise("given-name")


def json_object(text: Column) -> Column:
    """From the first { to the last }; null without both."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & text.contains("}") & (last > first), F.substring(text, first, last - first + 1))


def ago(then_ms: Column, now_ms: Column) -> Column:
    """How long ago, in whole minutes, hours, days or months of 30 days; -- without a time."""
    minutes = F.floor((now_ms - then_ms) / 60_000)
    part = lambda by, unit: F.concat(F.floor(minutes / by).cast("string"), F.lit(unit))
    told = F.when(minutes < 1, "刚刚").when(minutes < 60, part(1, "分钟前")).when(minutes < 1440, part(60, "小时前")).when(minutes < 43_200, part(1440, "天前"))
    return F.when(then_ms.isNull(), "--").otherwise(told.otherwise(part(43_200, "个月前")))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template whose {name} marks are filled with values (null: empty), all at once: what a value says is no mark,
    and marks without a value stay."""
    names = sorted(values)
    mark = r"\{(" + "|".join(names) + r")\}"
    parts, marks = F.split(template, mark, -1), F.regexp_extract_all(template, F.lit(mark), F.lit(1))
    of = F.create_map(*(x for n in names for x in (F.lit(n), F.coalesce(values[n].cast("string"), F.lit("")))))
    return F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, F.coalesce(of[m], F.lit("")))), "")


def label(key: Column, labels: dict[str, str], default: str) -> Column:
    """The label of a key, or the default."""
    out = F.lit(default)
    for k, v in labels.items():
        out = F.when(key == k, v).otherwise(out)
    return out
