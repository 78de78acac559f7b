"""The rules of ``cuewright.operators.reactor`` over a stream, one state an episode.

A micro-batch's rows of an episode are taken in order of seq. The state is kept in Spark's state store, so
that a query that starts again from its checkpoint goes on where it was. Events have a time (``ts``): a state
goes once the watermark is ``keep`` milliseconds beyond the last event of its episode, so that what is kept
is bounded by the episodes of that time. (Time by the clock would keep a query that is to end with what is
there, by ``availableNow``, running for ever.)
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reactor import ACTION, NOTICE, Rule, feed_rule, reactor, result_of

#: A week.
KEEP_MS = 7 * 24 * 3_600_000


def _stateful(rule: Rule, fields: list[str], names: list[str], keep: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        out = []
        for seq, event in zip(rows["seq"], rows["event"].map(json.loads), strict=True):
            made, now = rule(now, tuple(event.get(f) for f in fields))
            out += [(key[0], seq, k, *row) for k, row in enumerate(made)]
        state.update((json.dumps(now),))
        newest = pd.to_datetime(rows["ts"]).max()
        state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + keep)
        yield pd.DataFrame(out, columns=names, dtype=object)

    return run


def _over(events: DataFrame, rule: Rule, fields: list[str], said: str, late: str, keep: int) -> DataFrame:
    schema = result_of(events, said)
    rows = events.select("episode_id", "seq", "ts", F.to_json(F.struct(*fields)).alias("event")).withWatermark("ts", late)
    return rows.groupBy("episode_id").applyInPandasWithState(_stateful(rule, fields, schema.names, keep), schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def react(events: DataFrame, first: str | None = None, last: str | None = None, late: str = "1 hour", keep: int = KEEP_MS) -> DataFrame:
    """``reactions`` over a stream of events (episode_id, seq, ts, kind, type)."""
    return _over(events, reactor(first, last), ["kind", "type"], ACTION, late, keep)


def watch(events: DataFrame, late: str = "1 hour", keep: int = KEEP_MS) -> DataFrame:
    """``told`` over a stream of events (episode_id, seq, ts, task_id, type, status, error). Of an episode whose feed has
    ended one mark is kept, for ``keep``; then it may be watched anew."""
    return _over(events, feed_rule(), ["task_id", "type", "status", "error"], NOTICE, late, keep)
