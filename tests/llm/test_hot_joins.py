"""Joins whose hot keys are counted first."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuewright.llm import common


def _left(spark):
    return spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.lit(7).cast("long")).otherwise(F.col("id")).alias("k"), F.col("id").alias("i")).union(spark.sql("select null, 5000L"))


@pytest.mark.parametrize("costly", [False, True])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_of_a_key_of_nine_tenths_repeats_only_its_row(spark, monkeypatch, how, costly):
    left, right = _left(spark), spark.range(0, 2500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(repr, left.join(right, F.col("k") == F.col("key"), how).drop("key").collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    assert common.hot_keys(left, ["k"]) == {left.where("k = 7").select(F.xxhash64("k")).first()[0]: 27}
    repeated = []
    explode = F.explode
    monkeypatch.setattr(common.F, "explode", lambda c: repeated.append(c) or explode(c))
    out = common.join_hot(left, right, {"k": "key"}, ["i"], 16, how, costly)
    assert sorted(map(repr, out.collect())) == plain and len(repeated) == 1
    monkeypatch.setattr(common, "HOT_ROWS", 1 << 20)
    assert common.hot_keys(left, ["k"]) == {}
    assert sorted(map(repr, common.join_hot(left, right, {"k": "key"}, ["i"], 16, how, costly).collect())) == plain
    assert len(repeated) == 1


def test_cold_rows_of_a_hot_join_are_not_repeated(spark, monkeypatch):
    left, right = _left(spark), spark.range(0, 2500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    told, join = [], type(right).join

    def noted(self, other, *args, **kwargs):
        if "_salt" in self.columns and "_other" in other.columns:
            told.append(other)
        return join(self, other, *args, **kwargs)

    monkeypatch.setattr(type(right), "join", noted)
    common.join_hot(left, right, {"k": "key"}, ["i"], 16)
    counts = {r["key"]: r["count"] for r in told[0].groupBy("key").count().collect()}
    assert counts.pop(7) == 27 and set(counts.values()) == {1} and len(counts) == 2499


def test_hot_joins_with_clashing_names_empty_sides_and_other_types(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = _left(spark).withColumnRenamed("k", "_salt").withColumn("_hot", F.lit("x")).withColumn("_parts", F.lit(None).cast("string"))
    right = spark.range(0, 50).select(F.col("id").alias("_other"), F.lit(1).alias("v"))
    out = common.join_hot(left, right, {"_salt": "_other"}, ["i"], 16)
    assert out.columns == ["_salt", "i", "_hot", "_parts", "v"] and out.count() == 3001 and out.where("v = 1").count() == 2700 + 5
    assert common.join_hot(left.limit(0), right, {"_salt": "_other"}, ["i"], 16).count() == 0
    assert common.join_hot(left, right.limit(0), {"_salt": "_other"}, ["i"], 16).where("v is null").count() == 3001
    with pytest.raises(TypeError):
        common.join_hot(left, right.withColumn("_other", F.col("_other").cast("string")), {"_salt": "_other"}, ["i"], 16)
