"""Listings of dramas: totals of their episodes, conditions, pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drama_totals(dramas: DataFrame, episodes: DataFrame, keep: tuple[str, ...] = ("id", "name", "user_id")) -> DataFrame:
    """``keep`` of each drama (key id), n, updated_at, succeeded and started of its episodes, with or without any.

    Where ``dramas`` has updated_at it stands in for an episode without a date, and for episodes where
    there are none. Episodes are summed before the join, so that one row a drama is shuffled on either side."""
    status = F.col("status")
    e = episodes.groupBy("drama_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("updated_at").alias("_latest"),
        F.count_if(F.col("updated_at").isNull()).alias("_undated"),
        F.count_if(status == "succeeded").alias("succeeded"),
        F.count_if(status != "ready").alias("started"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    own = F.col("_own") if "updated_at" in dramas.columns else F.lit(None)
    d = dramas.select(*keep, *([F.col("updated_at").alias("_own")] if "updated_at" in dramas.columns else []))
    latest = F.when(F.coalesce("_undated", F.lit(1)) > 0, F.greatest("_latest", own)).otherwise(F.col("_latest"))
    return d.join(e, F.col("id") == F.col("drama_id"), "left").select(*keep, zero("n"), latest.alias("updated_at"), zero("succeeded"), zero("started"))


def listing(dramas: DataFrame, owner: int | None = None, search: str | None = None) -> DataFrame:
    """Conditions only where they are given; % and _ of a search are wildcards."""
    if owner is not None:
        dramas = dramas.where(F.col("user_id") == owner)
    return dramas.where(F.col("name").like(f"%{search}%")) if search else dramas


def allowed(name: Column, globs: list[str]) -> Column:
    """Whether any glob (* and ?) holds; none allows all."""
    patterns = ["^" + re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") + "$" for g in globs]
    return F.exists(F.array(*(F.lit(p) for p in patterns)), lambda p: F.regexp_like(name, p)) if patterns else F.lit(True)


def page(df: DataFrame, sorts: dict[str, Column], by: str, key: str, number: int, size: int, most: int = 100) -> DataFrame:
    """A page of a whitelisted order (the first of ``sorts`` if unknown), ties by key; numbers and sizes are put right."""
    size = min(size, most) if size >= 1 else 20
    return df.orderBy(sorts.get(by, next(iter(sorts.values()))), key).offset((max(1, number) - 1) * size).limit(size)
