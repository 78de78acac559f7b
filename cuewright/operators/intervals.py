"""Points in time and the intervals that cover them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covering(points: DataFrame, cues: DataFrame, by: str = "episode_id", at: str = "t") -> DataFrame:
    """``points`` with cue_id: of the cues of the same ``by`` with start_ms <= ``at`` < end_ms that which starts first
    (of several the least id). Points that none covers aren't in the result; equal points are one.

    In order of their starts, the first cue that ends after a point is its cue, if it starts by then; it ends after
    all cues before it. So only a cue that ends later than all before it is ever told, from where these end: such
    stretches don't overlap, and a point's is the last that begins by then. Rows are one a cue and one a point,
    sorted by time within an episode and read along once; windows spill what an episode has beyond memory."""
    c = cues.where(F.col(by).isNotNull() & (F.col("end_ms") > F.col("start_ms"))).select(F.col(by).alias("_by"), F.col("id").alias("cue_id"), "start_ms", "end_ms")
    before = Window.partitionBy("_by").orderBy("start_ms", "cue_id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_before", F.max("end_ms").over(before)).where("_before IS NULL OR end_ms > _before")
    p = points.where(F.col(by).isNotNull() & F.col(at).isNotNull()).distinct()
    p = p.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_point"), F.struct(*p.columns).alias("_row"))
    told = F.struct(F.col("end_ms").alias("end"), "cue_id")
    c = c.select("_by", F.greatest("start_ms", "_before").alias("_at"), F.lit(0).alias("_point"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), told.alias("_cue"))
    p = p.withColumn("_cue", F.lit(None).cast(c.schema["_cue"].dataType))
    along = Window.partitionBy("_by").orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    met = p.unionByName(c).withColumn("_cue", F.last("_cue", ignorenulls=True).over(along))
    return met.where((F.col("_point") == 1) & (F.col("_at") < F.col("_cue.end"))).select("_row.*", F.col("_cue.cue_id").alias("cue_id"))
