"""Tables kept in folders, a folder for each of some buckets of a key, whose groups are replaced in place.

A group is all rows of a key. Replacing groups rewrites the buckets that hold them and no other: their
other rows and the new ones are written elsewhere first, then put in place of the buckets (dynamic
overwrite). Whatever fails on the way, the same call again ends in the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..sources.shared import remove, written

BUCKETS = 64


def _bucket(by: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")


def _put(rows: DataFrame, path: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def store(rows: DataFrame, path: str, by: str, buckets: int = BUCKETS) -> None:
    """``rows`` as a new table."""
    _put(rows.withColumn("bucket", _bucket(by, buckets)), path)


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add("bucket", IntegerType())).parquet(path).drop("bucket")


def replace(path: str, new: DataFrame, groups: DataFrame, by: str, buckets: int = BUCKETS) -> None:
    """The table's rows of ``groups`` (a column ``by``) become those of ``new``; a group without new rows is gone, rows of
    ``new`` of other groups count for nothing."""
    spark = new.sparkSession
    keys = written(groups.select(by).where(F.col(by).isNotNull()).distinct(), "groups")
    touched = [r[0] for r in keys.select(_bucket(by, buckets).alias("b")).distinct().collect()]  # ``buckets`` at most
    if not touched:
        return
    old = spark.read.schema(StructType([*new.schema.fields]).add("bucket", IntegerType())).parquet(path).where(F.col("bucket").isin(touched))
    rest = old.join(keys, by, "left_anti").select(*new.columns)
    staged = written(rest.unionByName(new.join(keys, by, "left_semi")).withColumn("bucket", _bucket(by, buckets)), "staged")
    left = {r[0] for r in staged.select("bucket").distinct().collect()}
    _put(staged, path)
    for b in touched:
        if b not in left:
            remove(spark, f"{path}/bucket={b}")


def reparse(cues_path: str, utterances_path: str, utterances: StructType, cues: DataFrame, episodes: DataFrame, buckets: int = BUCKETS) -> None:
    """Episodes (episode_id) parsed anew: their utterances go, then their cues are replaced."""
    none = cues.sparkSession.createDataFrame([], utterances)
    replace(utterances_path, none, episodes, "episode_id", buckets)
    replace(cues_path, cues, episodes, "episode_id", buckets)
