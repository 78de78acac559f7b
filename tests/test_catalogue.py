"""Listings of dramas, stored subtitles, translations as they are stored."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cuewright.functions import parse
from cuewright.operators import catalogue
from cuewright.sources import formats


def test_totals_and_dates(spark):
    day = lambda n: datetime.date(2020, 1, n)
    dramas = spark.createDataFrame([(1, "a", 7, day(9)), (2, "b", 7, day(5)), (3, "c", 7, None), (4, "d", 8, day(1)), (5, "e", 8, day(9))], "id long, name string, user_id long, updated_at date")
    episodes = spark.createDataFrame([(1, "ready", day(2)), (2, "succeeded", None), (2, "running", day(3)), (3, None, None), (4, "succeeded", day(2)), (4, "ready", None)], "drama_id long, status string, updated_at date")
    dated = {r.id: r[1:] for r in catalogue.drama_totals(dramas, episodes, ("id",)).collect()}
    assert dated == {1: (1, day(2), 0, 0), 2: (2, day(5), 1, 2), 3: (1, None, 0, 0), 4: (2, day(2), 1, 1), 5: (0, day(9), 0, 0)}
    plain = {r.id: r.updated_at for r in catalogue.drama_totals(dramas.drop("updated_at"), episodes).collect()}
    assert plain == {1: day(2), 2: day(3), 3: None, 4: day(2), 5: None}
    assert catalogue.drama_totals(dramas, episodes.limit(0)).where("n = 0").count() == 5


def test_conditions_and_pages(spark):
    df = spark.createDataFrame([(i, f"n{i % 3}", i % 2) for i in range(25)], "id long, name string, user_id long")
    assert catalogue.listing(df).count() == 25 and catalogue.listing(df, owner=0).count() == 13 and catalogue.listing(df, 1, "1").count() == 4
    assert df.where(catalogue.allowed(F.col("name"), ["?1", "x*"])).count() == 8 and df.where(catalogue.allowed(F.col("name"), [])).count() == 25
    sorts = {"name": F.desc("name"), "id": F.desc("id")}
    ids = lambda *a: [r.id for r in catalogue.page(df, sorts, *a).collect()]
    assert ids("id", "id", 1, 3) == [24, 23, 22] and ids("unknown", "id", 2, 3) == [11, 14, 17] and len(ids("id", "id", -4, 0)) == 20


def test_subtitles_are_stored_by_episode(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, 0, 1500, "speech", "a"), (2, 1, 2000, 2500, "sing", "b"), (3, 2, 0, 10, "speech", "c")], "id long, episode_id long, start_ms long, end_ms long, kind string, said string")
    formats.write_srt(cues, "said", str(tmp_path / "srt"))
    back = {r.episode_id: r.value for r in spark.read.text(str(tmp_path / "srt"), wholetext=True).collect()}
    assert back == {r.episode_id: r.srt + "\n" for r in formats.srt_blocks(cues, "said").collect()}
    assert back[1].split("\n")[:3] == ["1", "00:00:00,000 --> 00:00:01,500", "a"] and "♪b♪" in back[1]


def test_finished_translation(spark):
    cases = {
        "<<NAME_0>> and <<NAME_1:y>> <<NAME_9>>": "Li Ming and",
        "li'ming  LIMING x": "Li Ming LIMING x",
        "wangfang saw 王芳 here": "wangfang saw here",
        "a<sep>b <SLANG:c>": "a b",
        "你好": "",
        "": "",
        None: "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("names", F.array(F.lit("Li Ming"), F.lit(None)))
    assert {r.t: r.f for r in rows.select("t", parse.finished_translation(F.col("t"), F.col("names")).alias("f")).collect()} == cases
    assert rows.select(parse.finished_translation(F.lit("a <<NAME_0>>"), F.lit(None).cast("array<string>"))).first()[0] == "a"
