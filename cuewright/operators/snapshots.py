"""Row-level changes as new snapshots: f(old, delta). Keys are unique within each side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rule: dict[str, str]) -> DataFrame:
    """Old rows, changed and added ones. ``rule`` of a column: new (wins), old (wins), fill (new unless
    null), text (new unless empty)."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    had, got = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        kept = {"new": b, "old": a, "fill": F.coalesce(b, a), "text": F.when(F.coalesce(b, F.lit("")) != "", b).otherwise(a)}[rule[c]]
        return F.when(had & got, kept).when(got, b).otherwise(a).alias(c)

    return j.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(pick(c) for c in rule))


def classify(old: DataFrame, new: DataFrame, key: str, source: list[str], role: str, target: str) -> DataFrame:
    """key, change (insert, delete, source, role, target, none) and where work starts again.

    Source fields are compared as text; a source change outranks a role's, that a target text's."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    text = lambda s, c: F.coalesce(F.col(f"{s}.{c}").cast("string"), F.lit(""))
    differs = lambda cs: F.exists(F.array(*(text("o", c) != text("n", c) for c in cs)), lambda x: x)
    change = (
        F.when(F.col(f"o.{key}").isNull(), "insert")
        .when(F.col(f"n.{key}").isNull(), "delete")
        .when(differs(source), "source")
        .when(~F.col(f"o.{role}").eqNullSafe(F.col(f"n.{role}")), "role")
        .when(differs([target]), "target")
        .otherwise("none")
    )
    out = j.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"))
    restart = F.when(F.col("change").isin("insert", "delete", "source"), "source_review").when(F.col("change") == "role", "tts").when(F.col("change") == "target", "translation_review")
    return out.withColumn("restart", restart)


def restarts(changes: DataFrame, by: str) -> DataFrame:
    """Where work on each group starts again: at the earliest place that any of its changes asks for
    (source_review, then tts, then translation_review); null where nothing changed."""
    order = F.array(F.lit("source_review"), F.lit("tts"), F.lit("translation_review"))
    first = F.min(F.nullif(F.array_position(order, F.coalesce("restart", F.lit(""))), F.lit(0)))
    return changes.groupBy(by).agg(F.get(order, (first - 1).cast("int")).alias("restart"))


def prune(rows: DataFrame, keep: DataFrame, key: str, used: DataFrame, used_key: str) -> DataFrame:
    """Rows that are kept by ``keep``, or still used."""
    gone = rows.join(keep.select(key), key, "left_anti").join(used.select(F.col(used_key).alias("_used")).where("_used is not null").distinct(), F.col("id") == F.col("_used"), "left_anti")
    return rows.join(gone.select("id"), "id", "left_anti")


#: The role that speech falls back to and that is never pruned; a fixed value.
DEFAULT_ROLE = "默认"


def set_roles(stored: DataFrame, listed: DataFrame, dramas: DataFrame, used: DataFrame) -> DataFrame:
    """Roles once the lists of ``dramas`` (drama_id) are set; other dramas, and columns a list doesn't have, stay.

    ``listed``: drama_id, position, id, name, voice_type, role_type. A row with a positive id changes that role
    of its drama, if there is one; others change the role of their name or add one (id null). The last row of
    an id or a name counts; ids come before names. Roles that are in no list go, an empty list's too, but for the
    default one and those in ``used`` (drama_id, role_id)."""
    fields = ["name", "voice_type", "role_type"]
    last = lambda rows, key: rows.groupBy("drama_id", key).agg(F.max_by(F.struct(*fields), "position").alias("_new"))
    has_id = F.coalesce(F.col("id") > 0, F.lit(False))
    change = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
    others = [c for c in stored.columns if c not in fields]

    kept = stored.join(last(listed.where(has_id), "id"), ["drama_id", "id"], "left")
    kept = kept.select(*others, *(change(c) for c in fields), F.col("_new").isNotNull().alias("_seen"))
    named = last(listed.where(~has_id), "name").withColumnRenamed("name", "_name").withColumnRenamed("drama_id", "_drama")
    both = kept.join(named, (F.col("drama_id") == F.col("_drama")) & (F.col("name") == F.col("_name")), "full_outer")
    both = both.select(*(F.coalesce(c, "_drama").alias(c) if c == "drama_id" else F.col(c) for c in others), *(change(c) for c in fields), (F.coalesce("_seen", F.lit(False)) | F.col("_new").isNotNull()).alias("_seen"))

    spared = used.where("role_id IS NOT NULL").select(F.col("drama_id").alias("_drama"), F.col("role_id").alias("_role")).distinct()
    both = both.join(spared, (F.col("drama_id") == F.col("_drama")) & (F.col("id") == F.col("_role")), "left")
    both = both.join(dramas.select(F.col("drama_id").alias("_set")).distinct(), F.col("drama_id") == F.col("_set"), "left")
    stays = F.col("_set").isNull() | F.col("_seen") | F.col("name").eqNullSafe(DEFAULT_ROLE) | F.col("_role").isNotNull()
    return both.where(stays).select(*stored.columns)


def delete_cues(cues: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues and links (cue_id, ..) without those of ``gone`` (id)."""
    ids = gone.select("id")
    return cues.join(ids, "id", "left_anti"), links.join(ids.withColumnRenamed("id", "cue_id"), "cue_id", "left_anti").select(*links.columns)


def delete_utterances(utterances: DataFrame, links: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("uid",)) -> tuple[DataFrame, DataFrame]:
    """Utterances and their links without those of ``gone``; both sides have the keys."""
    ids = gone.select(*keys)
    return utterances.join(ids, list(keys), "left_anti").select(*utterances.columns), links.join(ids, list(keys), "left_anti").select(*links.columns)


def update_fields(rows: DataFrame, changes: dict[str, Column], writable: tuple[str, ...]) -> DataFrame:
    """Rows with the changes to writable columns that they have; others are ignored."""
    return rows.withColumns({c: v.cast(rows.schema[c].dataType) for c, v in changes.items() if c in writable and c in rows.columns})


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
