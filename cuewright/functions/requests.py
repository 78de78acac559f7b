"""Rules for requests to a recognizer, and paths of artifacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Artifacts and their paths within an episode's folder; fixed values.
ARTIFACTS = {
    "extract.audio": "{episode_stem}.wav",
    "extract.vocals": "{episode_stem}-vocals.wav",
    "extract.accompaniment": "{episode_stem}-accompaniment.wav",
    "asr.doubao": "asr-doubao.json",
    "subs.zh_srt": "output/{episode_stem}-zh.srt",
    "subs.en_srt": "output/{episode_stem}-en.srt",
    "tts.segments_dir": "tts/segments",
    "mix.audio": "{episode_stem}-mix.wav",
    "burn.video": "output/{episode_stem}-dubbed.mp4",
}


def artifact_path(key: Column, folder: Column) -> Column:
    """Where an artifact of an episode is: by the table, else domain/name, or misc/key without a dot."""
    known = F.create_map(*(F.lit(x) for entry in ARTIFACTS.items() for x in entry))
    dot = F.instr(key, ".")
    other = F.when(dot > 0, F.concat(F.substring(key, F.lit(1), dot - 1), F.lit("/"), F.substring(key, dot + 1, F.length(key)))).otherwise(F.concat(F.lit("misc/"), key))
    path = F.replace(F.coalesce(F.try_element_at(known, key), other), F.lit("{episode_stem}"), F.substring_index(folder, "/", -1))
    return F.concat(folder, F.lit("/"), path)


def request_faults(vad: Column, window_ms: Column, ssd: Column, speakers: Column, split: Column, channels: Column, language: Column) -> Column:
    """The rules that a request breaks, in order; none for a valid one. Flags that are null are off."""
    vad, speakers, split = (F.coalesce(c, F.lit(False)) for c in (vad, speakers, split))
    rules = {
        "segments by voice need a window": vad & window_ms.isNull(),
        "the window isn't within 300 and 5000": vad & ~window_ms.between(300, 5000),
        "a window needs segments by voice": ~vad & window_ms.isNotNull(),
        "a speaker model needs speakers": ssd.isNotNull() & ~speakers,
        "split channels need two": split & ~channels.eqNullSafe(F.lit(2)),
        "a speaker model is for Chinese": ssd.isNotNull() & speakers & ~F.coalesce(language, F.lit("")).isin("", "zh-CN"),
    }
    return F.filter(F.array(*(F.when(broken, name) for name, broken in rules.items())), lambda x: x.isNotNull())


def require(faults: Column, value: Column) -> Column:
    """``value``, or an error that names the faults."""
    return F.when(F.size(faults) > 0, F.raise_error(F.array_join(faults, "; "))).otherwise(value)
