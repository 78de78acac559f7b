"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none a temporary one is set; that is for one machine, so that a
    session on a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def shared_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    noted = _noted.get()
    if noted is not None:
        noted.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """A folder's end, in whatever store it is; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write to the shared folder within it are removed at its end.

    What is to outlast it has to be written elsewhere before then: a result of an operator is
    read from such tables, too."""
    paths: list[str] = []
    outer = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(outer)
        for path in paths:
            remove(spark, path)


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut,
    and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: Column | str) -> Column:
    """16 bytes that name a row by the values of ``cols``; nulls are a value of
    their own. Repeated rows share a key, rows that differ don't."""
    parts = []
    for c in cols:
        c = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit("="), c), F.lit("-")))  # no value can pass for two
    return F.unhex(F.md5(F.concat(*parts)))


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of a table that is broadcast.
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, width: Column | int) -> bool:
    """Whether a written table's ``width`` (bytes of a row) sums to at most BROADCAST_BYTES."""
    width = F.lit(width) if isinstance(width, int) else width
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, width: Column | int) -> DataFrame:
    """A written table, marked for broadcast if it fits."""
    return F.broadcast(df) if fits_broadcast(df, width) else df


#: Rows of a key that one task meets; a key of more is dealt into as many parts as it needs.
HOT_ROWS = 1 << 20
#: Keys that are told apart as hot, and keys that a task's sketch tracks to find them.
HOT_KEYS, TRACKED = 1 << 10, 1 << 16


def hot_keys(df: DataFrame, keys: list[str]) -> dict[int, int]:
    """Parts by hash for the keys of ``df`` with more than HOT_ROWS rows.

    Counts come from a sketch of frequent values: a pass over the keys without a shuffle of them, and
    at most HOT_KEYS numbers for the driver. It misses no key of more than about a TRACKED-th of all rows
    beyond HOT_ROWS (and adds at most as much to a count); what a key is taken for changes no result."""
    told = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(F.xxhash64(*keys).alias("_hash"))
    top = told.agg(F.expr(f"approx_top_k(_hash, {HOT_KEYS}, {TRACKED})").alias("top")).first()["top"] or []
    return {r["item"]: -(-r["count"] // HOT_ROWS) for r in top if r["count"] > HOT_ROWS}


def join_hot(left: DataFrame, right: DataFrame, keys: dict[str, str], spread: list[str], width: Column | int, how: str = "left", costly: bool = False) -> DataFrame:
    """A join in which many rows of ``left`` may share a key, and rows of ``right`` don't.

    ``right`` (written, its columns named unlike those of ``left``; ``keys`` names its key, of the
    same type, for each of ``left``'s) is broadcast if it fits. Else hot keys are counted first
    (``hot_keys``); their rows are dealt into parts by the columns ``spread``, as many as their count asks for, and
    only their rows of ``right`` are repeated, once a part. A ``costly`` left side is written, so that it isn't
    made twice. Key columns of ``right`` are dropped; null keys of ``left`` meet nothing."""
    on = [F.col(a) == F.col(b) for a, b in keys.items()]
    if fits_broadcast(right, width):
        return left.join(F.broadcast(right), on, how).drop(*keys.values())
    for a, b in keys.items():
        if left.schema[a].dataType != right.schema[b].dataType:
            raise TypeError(f"keys {a} and {b} differ in type")
    left = saved(left, "left") if costly else left
    hot = hot_keys(left, list(keys))
    if not hot:
        return left.join(right, on, how).drop(*keys.values())
    at, parts, salt, other = (unused(left, unused(right, c)) for c in ("_hot", "_parts", "_salt", "_other"))
    known = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), f"`{at}` long, `{parts}` long"))  # at most HOT_KEYS rows
    n = F.coalesce(F.col(parts), F.lit(1))
    left = left.join(known, F.xxhash64(*keys) == F.col(at), "left").withColumn(salt, F.pmod(F.xxhash64(*spread), n)).drop(at, parts)
    right = right.join(known, F.xxhash64(*keys.values()) == F.col(at), "left").withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop(at, parts)
    return left.join(right, [*on, F.col(salt) == F.col(other)], how).drop(salt, other, *keys.values())


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
