"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and root (the least id of its component) for every id in ``edges``.

    Each round lowers a label to the least one among an id's neighbours, then to
    its label's label, so that rounds grow with the logarithm of the longest path.
    A round is a written table: nothing but a count of changes reaches the driver. An id with
    many neighbours, or the root of many, meets their rows in parts (``join_hot``).
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = saved(e.union(e.select(F.col("v"), F.col("u"))), "edges")
    labels = saved(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("low")).select("id", F.least("id", "low").alias("root")), "labels")
    while True:
        told = labels.select(F.col("id").alias("of"), F.col("root").alias("label"))
        heard = join_hot(e, told, {"v": "of"}, ["u"], 64, "inner").groupBy("u").agg(F.min("label").alias("heard"))
        hooked = saved(labels.join(heard, labels["id"] == heard["u"], "left").select("id", "root", F.least("root", "heard").alias("hooked")), "hooked")
        of = hooked.select(F.col("id").alias("at"), F.col("hooked").alias("jumped"))
        jumped = join_hot(hooked, of, {"hooked": "at"}, ["id"], 64)
        jumped = saved(jumped.select("id", F.least("hooked", "jumped").alias("root"), (F.least("hooked", "jumped") != F.col("root")).alias("changed")), "labels")
        labels = jumped.select("id", "root")
        if jumped.where("changed").isEmpty():
            return labels
