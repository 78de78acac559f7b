"""Replacement in place, intervals and points, names by signs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions import names
from cuewright.operators import intervals, stored


def files(path):
    return {f"{d}/{n}" for d, _, ns in os.walk(path) for n in ns if n.endswith(".parquet")}


def rows_of(spark, path, schema):
    return sorted(map(tuple, stored.stored(spark, path, schema).collect()))


def test_only_the_buckets_of_a_group_change(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "episode_id long, id long"
    df = spark.createDataFrame([(e, e * 10 + k) for e in range(20) for k in range(3)], schema)
    stored.store(df, path, "episode_id", 16)
    before = files(path)
    new = spark.createDataFrame([(3, 1), (3, 2), (4, 9)], schema)
    scope = spark.createDataFrame([(3,), (3,), (5,), (None,)], "episode_id long")
    stored.replace(path, new, scope, "episode_id", 16)
    wanted = sorted([(e, e * 10 + k) for e in range(20) for k in range(3) if e not in (3, 5)] + [(3, 1), (3, 2)])
    assert rows_of(spark, path, df.schema) == wanted
    touched = {r[0] for r in scope.where("episode_id IS NOT NULL").select(F.pmod(F.xxhash64("episode_id"), F.lit(16))).collect()}
    changed = {int(f.split("bucket=")[1].split("/")[0]) for f in before ^ files(path)}
    assert changed == touched and len(touched) < 3
    stored.replace(path, new, scope, "episode_id", 16)
    assert rows_of(spark, path, df.schema) == wanted  # again: the same


def test_a_bucket_that_loses_all_goes(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "episode_id long, id long"
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], schema)
    stored.store(df, path, "episode_id", 1)
    none = spark.createDataFrame([], schema)
    stored.replace(path, none, spark.createDataFrame([(1,), (2,)], "episode_id long"), "episode_id", 1)
    assert files(path) == set()
    stored.replace(path, df, spark.createDataFrame([], "episode_id long"), "episode_id", 1)
    assert files(path) == set()


def test_reparse_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    c, u = f"{tmp_path}/c", f"{tmp_path}/u"
    cues = spark.createDataFrame([(e, k) for e in (1, 2) for k in range(4)], "episode_id long, id long")
    utterances = spark.createDataFrame([(1, 7), (2, 8)], "episode_id long, uid long")
    stored.store(cues, c, "episode_id", 4)
    stored.store(utterances, u, "episode_id", 4)
    new, again = spark.createDataFrame([(1, 100)], cues.schema), spark.createDataFrame([(1,)], "episode_id long")
    real = stored._put

    def fails(rows, path):
        if path == c:
            raise OSError("lost")
        real(rows, path)

    monkeypatch.setattr(stored, "_put", fails)
    with pytest.raises(OSError):
        stored.reparse(c, u, utterances.schema, new, again, 4)
    monkeypatch.setattr(stored, "_put", real)
    assert rows_of(spark, u, utterances.schema) == [(2, 8)]
    stored.reparse(c, u, utterances.schema, new, again, 4)
    assert rows_of(spark, u, utterances.schema) == [(2, 8)] and rows_of(spark, c, cues.schema) == [(1, 100)] + [(2, k) for k in range(4)]


def test_points_and_the_cues_that_cover_them(spark):
    rng = random.Random(9)
    cues = [(k, rng.choice("ab"), s, s + rng.choice([0, 1, 2, 7, 100, 5000, -3])) for k in range(120) for s in [rng.randrange(-50, 4000)]] + [(200, "a", None, 5), (201, "a", 5, None), (202, None, 0, 9000)]
    points = [(rng.choice(["a", "b", "c"]), rng.randrange(-60, 5000)) for _ in range(500)] + [("a", None), (None, 5)]
    wanted = {}
    for e, t in points:
        of = [(s, i) for i, c, s, z in cues if c == e and None not in (e, t, s, z) and s <= t < z]
        if of:
            wanted[e, t] = min(of)[1]
    got = intervals.covering(spark.createDataFrame(points, "episode_id string, t long"), spark.createDataFrame(cues, "id long, episode_id string, start_ms long, end_ms long"))
    assert got.columns == ["episode_id", "t", "cue_id"] and {(r.episode_id, r.t): r.cue_id for r in got.collect()} == wanted


def test_many_points_and_long_cues_of_one_episode(spark):
    """A cue over the whole time, short ones, a thousand points: a point meets the cells that it lies in."""
    cues = spark.range(20_000).selectExpr("id", "1 AS episode_id", "id * 1000 AS start_ms", "id * 1000 + 900 AS end_ms").union(spark.sql("SELECT 20000L, 1, 0L, 20000000L"))
    points = spark.range(1000).selectExpr("1 AS episode_id", "id * 20000 + 950 AS t")
    short = cues.where("id < 20000")
    assert {r.cue_id for r in intervals.covering(points.withColumn("t", F.col("t") - 100), short).collect()} == {k * 20 for k in range(1000)}
    assert intervals.covering(points, short).count() == 0
    assert [r.cue_id for r in intervals.covering(points, cues).select("cue_id").distinct().collect()] == [20_000]
    assert intervals.covering(points, cues.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("平老哥你好", ("<<NAME_0>>哥你好", ["平老"])),  # 60 for a suffix, 40 for a call, 10 for its length
        ("平安哥你好", ("平安哥你好", [])),  # a name without a suffix of its own has 50
        ("平安哥，平安哥", ("平安哥，平安哥", [])),  # 90
        ("好，平老哥", ("好，平老哥", [])),  # no call
        ("好，平老哥，平老", ("好，<<NAME_0>>哥，平老", ["平老"])),  # said twice
        ("好 <sep> 平老哥", ("好 <sep> <<NAME_0>>哥", ["平老"])),
        ("平老哥 <sep> 平老哥", ("<<NAME_0>>哥 <sep> <<NAME_0>>哥", ["平老"])),
        ("我老哥", ("我老哥", [])),  # a pronoun
        ("去老哥", ("去老哥", [])),  # a verb
        ("abc", ("abc", [])),
        ("", ("", [])),
    ],
)
def test_names_by_signs(text, wanted):
    assert names.masked(text, names.NameRules()) == wanted


def test_known_names_stand_anywhere_but_within_windows(spark):
    rules = names.NameRules(known=frozenset({"王明", "李"}), never=frozenset({"平老"}))
    assert names.masked("王明来了，李", rules) == ("<<NAME_0>>来了，<<NAME_1>>", ["王明", "李"])
    assert names.masked("平老哥", rules) == ("平老哥", [])
    assert names.masked("看王明来", rules) == ("看王明来", [])  # windows of two begin at the first: 看王, 明来
    df = spark.createDataFrame([(1, "王明"), (2, None), (3, "")], "id long, text string").select("id", names.guard(F.col("text"), rules).alias("g"))
    assert {r.id: (r.g.masked, r.g.names) for r in df.collect()} == {1: ("<<NAME_0>>", ["王明"]), 2: (None, []), 3: ("", [])}


def test_points_make_no_row_for_each_length_of_cues(spark, capsys):
    """Cues of 40 lengths: a point stays one row, and meets cues in the order of time, without a join."""
    cues = spark.range(40).selectExpr("id", "1L AS episode_id", "0L AS start_ms", "CAST(pow(2, id) AS long) AS end_ms")
    points = spark.range(2000).selectExpr("1L AS episode_id", "id AS t", "'p' AS more")
    got = intervals.covering(points, cues)
    assert got.columns == ["episode_id", "t", "more", "cue_id"]
    assert {r.t: r.cue_id for r in got.collect()} == {t: t.bit_length() for t in range(2000)}
    got.explain("simple")
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Generate" not in plan


def test_names_are_scored_by_all_tasks(spark, sf_dir, capsys):
    """Names are narrow: a table that one task reads is dealt out before Python scores it."""
    from cuewright.plans import QUERIES

    QUERIES["str_27_scored_names"](spark, sf_dir).explain("simple")
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning(id" in plan[plan.index("ArrowEvalPython") :]
