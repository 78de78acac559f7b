"""Short content hashes: the first 16 hex digits of SHA-256 over parts joined by a bar."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import collapse_space


def short_hash(*parts: Column | str) -> Column:
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 16)


def source_hash(cues: Column | str) -> Column:
    """Of an ordered array of cues: text, start_ms, end_ms and emotion of each."""
    return F.substring(F.sha2(F.array_join(F.transform(cues, lambda c: F.concat_ws("|", c["text"], c["start_ms"], c["end_ms"], c["emotion"])), "|"), 256), 1, 16)


def voice_hash(text_en: Column | str, role_id: Column | str, emotion: Column | str) -> Column:
    role = F.col(role_id) if isinstance(role_id, str) else role_id
    return short_hash(text_en, F.coalesce(role.cast("string"), F.lit("_default")), emotion)


@F.pandas_udf(StringType())
def sorted_json(document: pd.Series) -> pd.Series:
    """A JSON text with its keys sorted, ", " and ": " between, and what isn't ASCII escaped. Null where it isn't JSON."""

    def told(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True)
        except ValueError:
            return None

    return pd.Series([told(t) for t in document], dtype=object)


#: What a request's prosody holds where nothing is said.
PROSODY = {"rate": 1.0, "pitch": 0, "style": "general", "role": "", "volume": ""}


@F.pandas_udf(StringType())
def _request(fields: pd.DataFrame) -> pd.Series:
    """Rows as JSON with sorted keys and nothing escaped that needn't be, PROSODY's fields in an object of their own."""
    rows = zip(*(fields[c].tolist() for c in fields.columns), strict=True)
    told = [dict(zip(fields.columns, row, strict=True)) for row in rows]
    nested = [{k: v for k, v in x.items() if k not in PROSODY} | {"prosody": {k: x[k] for k in PROSODY}} for x in told]
    return pd.Series([json.dumps(x, sort_keys=True, ensure_ascii=False) for x in nested], dtype=object)


def synthesis_key(engine: str, version: str, text: Column, voice: Column, prosody: Column | None = None, language: Column | None = None) -> Column:
    """Of a synthesized text: engine, version, text (white space collapsed), voice, and, where the engine
    has them, prosody (a JSON text, taken with sorted keys) and language."""
    more = [] if prosody is None else [sorted_json(prosody)]
    more += [] if language is None else [language]
    return short_hash(F.lit(engine), F.lit(version), collapse_space(text), voice, *more)


def payload_key(engine: str, version: str, text: Column, voice: Column, prosody: dict[str, Column], language: Column, form: str, sample_rate: int, channels: int) -> Column:
    """All 64 digits of SHA-256 over a request as JSON with sorted keys; what ``prosody`` lacks, or is null, is as in PROSODY."""
    fields = {"engine": F.lit(engine), "engine_ver": F.lit(version), "voice": voice, "lang": language, "format": F.lit(form), "sample_rate": F.lit(sample_rate), "channels": F.lit(channels), "text": collapse_space(text)}
    fields |= {k: F.coalesce(prosody[k], F.lit(v)) if k in prosody else F.lit(v) for k, v in PROSODY.items()}
    return F.sha2(_request(F.struct(*(c.alias(k) for k, c in fields.items()))), 256)
