"""Rules of one event at a time, over tables and over streams that stop and start again."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cuewright.operators import reactor
from cuewright.streaming import feed
from cuewright.streaming import reactor as streamed

EVENT = "episode_id long, seq long, ts timestamp, kind string, type string"
TASK = "episode_id long, seq long, ts timestamp, task_id long, type string, status string, error string"
T0 = datetime(2024, 1, 1)


def walk(rule, events):
    state, out = None, []
    for e in events:
        made, state = rule(state, e)
        out.append(made)
    return out


def ok(*types):
    return [("task_succeeded", t) for t in types]


def test_phases_follow_each_other_and_gates_wait():
    rule = reactor.reactor()
    got = walk(rule, [("status", "running"), *ok("extract", "asr", "parse", "source_review", "translate", "translation_review", "tts", "mix", "burn")])
    assert got == [
        [], [("create", "asr", False)], [("create", "parse", False)],
        [("create", "source_review", None), ("status", "review", None), ("emit", "gate_awaiting", None)],
        [("create", "translate", False), ("status", "running", None)],
        [("create", "translation_review", None), ("status", "review", None), ("emit", "gate_awaiting", None)],
        [("create", "tts", False), ("status", "running", None)], [("create", "mix", False)], [("create", "burn", False)],
        [("status", "succeeded", None), ("emit", "pipeline_done", None)],
    ]
    assert walk(rule, ok("source_review", "parse"))[1] == [("create", "translate", False)]  # a gate that was passed


def test_stopped_and_failed_episodes_get_no_phase():
    rule = reactor.reactor()
    assert walk(rule, [("status", "ready"), *ok("extract")]) == [[], []]
    assert walk(rule, [("task_failed", "asr"), *ok("extract")]) == [[("status", "failed", None), ("emit", "pipeline_failed", None)], []]
    assert walk(rule, [("status", "ready"), *ok("source_review")])[1] == [("status", "running", None)]


def test_a_range_of_phases_is_forced():
    rule = reactor.reactor("translate", "tts")
    got = walk(rule, ok("source_review", "translate", "translation_review", "tts"))
    assert got[0] == [("status", "succeeded", None), ("emit", "pipeline_done", None)]  # parse isn't in the range
    assert walk(rule, ok("translation_review", "translate"))[1][0] == ("create", "translation_review", None)  # asked for again
    assert walk(rule, [("status", "review"), *ok("translation_review")])[1] == [("create", "tts", True), ("status", "running", None)]
    with pytest.raises(ValueError):
        reactor.reactor("tts", "asr")


def test_what_a_watcher_is_told():
    rule = reactor.feed_rule()
    row = lambda i, t, s, e=None: (i, t, s, e)
    now = lambda s: (None, None, s, None)
    assert walk(rule, [row(1, "asr", "pending"), row(1, "asr", "running"), row(1, "asr", "running"), row(1, "asr", "failed", "no sound"), now("failed"), row(2, "tts", "running")]) == [
        [], [("asr_running", "asr", 1, None)], [], [("asr_failed", "asr", 1, None)], [("pipeline_failed", None, None, "no sound")], [],
    ]
    assert walk(rule, [row(1, "asr", "succeeded"), now("failed")])[1] == [("pipeline_failed", None, None, "Pipeline failed (unknown error)")]
    assert walk(rule, [now("ready")]) == [[("pipeline_stopped", None, None, None)]]
    review = walk(rule, [row(1, "parse", "running"), row(2, "source_review", "pending"), now("review"), row(1, "parse", "succeeded")])
    assert review[2] == [] and review[3] == [("parse_succeeded", "parse", 1, None), ("gate_awaiting", "source_review", None, None)]


def restarted(spark, tmp_path, schema, batches, over):
    """Rows that ``over`` says of some folders of rows, with a query that ends and starts again after each; and its last progress."""
    came, out, progress = f"{tmp_path}/came", f"{tmp_path}/out", None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(came)
        stream = over(spark.readStream.schema(schema).parquet(came))
        query = feed.run(stream, out, f"{tmp_path}/progress")
        progress = query.lastProgress or progress
    return spark.read.schema(stream.schema).parquet(out), progress


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stream_and_table_give_the_same_and_a_restart_goes_on(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(7), n, T0 + timedelta(seconds=n), k, t) for n in range(240) for k, t in [rng.choice([*ok("extract", "parse", "source_review", "translate", "tts", "burn"), ("task_failed", "asr"), ("status", "running"), ("status", "ready")])]]
    wanted = plain(reactor.reactions(spark.createDataFrame(rows, EVENT)))
    got, _ = restarted(spark, tmp_path / "a", EVENT, [rows[:80], rows[80:170], rows[170:]], streamed.react)
    assert plain(got) == wanted and len(wanted) > 200
    tasks = [(rng.randrange(7), n, T0 + timedelta(seconds=n), *rng.choice([(rng.randrange(20), rng.choice(["asr", "source_review"]), rng.choice(["pending", "running", "succeeded"]), None), (None, None, rng.choice(["running"] * 6 + ["review", "failed"]), None)])) for n in range(240)]
    wanted = plain(reactor.told(spark.createDataFrame(tasks, TASK)))
    got, _ = restarted(spark, tmp_path / "b", TASK, [tasks[:80], tasks[80:170], tasks[170:]], streamed.watch)
    assert plain(got) == wanted and len(wanted) > 20


def test_state_of_a_feed_is_bounded(spark, tmp_path):
    """Every batch brings new episodes; those that nothing came for within ``keep`` are forgotten."""
    batches = [[(b * 100 + e, b, T0 + timedelta(hours=b), e, "asr", "running", None) for e in range(20)] for b in range(5)]
    _, progress = restarted(spark, tmp_path, TASK, batches, lambda s: streamed.watch(s, "1 minute", 60_000))
    assert 20 <= progress["stateOperators"][0]["numRowsTotal"] <= 40


def test_debounced_edits_out_of_order_and_late(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "episode_id long, ts timestamp"
    first = [(1, at(0)), (1, at(1.5)), (2, at(0)), (1, at(10)), (9, at(30))]
    second = [(1, at(28)), (1, at(26.5)), (1, at(3)), (1, at(31)), (9, at(60))]  # 26.5 out of order, 3 too late
    third = [(9, at(120))]
    got, progress = restarted(spark, tmp_path, schema, [first, second, third], lambda s: feed.settled(s, "2 seconds", "10 seconds"))
    rows = sorted((r.episode_id, r.n_edits, (r.last_edit - T0).total_seconds()) for r in got.collect())
    assert rows == [(1, 1, 10.0), (1, 1, 31.0), (1, 2, 1.5), (1, 2, 28.0), (2, 1, 0.0), (9, 1, 30.0), (9, 1, 60.0)]
    assert progress["stateOperators"][0]["numRowsTotal"] == 1


def test_no_query_waits_for_more(spark, tmp_path):
    began = time.time()
    got, _ = restarted(spark, tmp_path, EVENT, [[(1, 1, T0, "task_failed", "asr")]], streamed.react)
    assert got.count() == 2 and time.time() - began < 60
    assert got.where(F.col("value") == "failed").first().seq == 1
