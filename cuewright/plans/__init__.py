"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from . import catalogue, ingest, media, rules, streams, texts, timeline, walks, whole, workflow  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
