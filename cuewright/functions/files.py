"""Names and paths of media files, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that hold dubbed output, and suffixes with a kind of their own; fixed values.
DUBBED = ("/dub/", "/output/")
KINDS = ("json", "srt", "wav", "mp4", "mp3")


def video_file(path: Column, drama: Column, number: Column) -> Column:
    """The original video: ``path`` as it is, but where it is null, empty or dubbed output, drama/number.mp4."""
    original = path != ""
    for folder in DUBBED:
        original = original & ~path.contains(folder)
    return F.when(original, path).otherwise(F.concat(drama, F.lit("/"), number.cast("string"), F.lit(".mp4")))


def episode_number(stem: Column) -> Column:
    """The number (long) that a file's name without suffix is, alone or as 第…集; null for other names.

    Digits are 0 to 9; a number beyond a long is null, too."""
    whole = F.regexp_extract(stem, "^(?:[0-9]+|第[0-9]+集)$", 0)
    return F.regexp_extract(whole, "[0-9]+", 0).try_cast("long")


def episodes_of(span: Column) -> Column:
    """The episodes (strings) that an argument names: each from a to b for a-b (none if b is less), else itself; null for null."""
    a, b = (F.regexp_extract(span, r"^([0-9]+)-([0-9]+)$", k).try_cast("long") for k in (1, 2))
    listed = F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda n: n.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.when(a.isNotNull() & b.isNotNull(), listed).when(span.isNotNull(), F.array(span))


def file_kind(path: Column) -> Column:
    """``dir`` for a path that ends in a slash, its suffix (in any case) if it is one of KINDS, else ``bin``."""
    suffix = F.lower(F.regexp_extract(path, r"[^/]\.([^/.]+)$", 1))
    return F.when(path.endswith("/"), "dir").when(suffix.isin(*KINDS), suffix).when(path.isNotNull(), "bin")
