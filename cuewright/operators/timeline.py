"""Operators over cues in time: merging, filling, extending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hashes import source_hash
from ..functions.text import strip
from .folds import fold


def merge_cues(cues: DataFrame, max_gap_ms: int = 500, max_duration_ms: int = 10_000) -> DataFrame:
    """episode_id, head_id (the first cue of its group) and id of every cue.

    A cue joins the group before it if both have the same role (or neither has one and the
    speaker is the same), the same emotion, at most the gap to the cue before, and the group
    stays within the duration. All but the last are conditions on neighbours, which come from
    a window; the duration is folded along an episode's cues, one state at a time.
    """
    w = Window.partitionBy("episode_id").orderBy("start_ms", "id")
    before = lambda c: F.lag(c).over(w)
    same = F.when(F.col("role_id").isNotNull() & before("role_id").isNotNull(), F.col("role_id") == before("role_id")).when(F.col("role_id").isNull() & before("role_id").isNull(), F.col("speaker") == before("speaker")).otherwise(F.lit(False))
    joins = same & (F.col("emotion") == before("emotion")) & (F.col("start_ms") - before("end_ms") <= max_gap_ms)
    rows = cues.repartition("episode_id").select("episode_id", "id", "start_ms", "end_ms", F.coalesce(joins, F.lit(False)).alias("joins"))

    def step(state: tuple | None, row: tuple) -> tuple[object, tuple]:
        _, id_, start, end, joins = row
        if state is None or not joins or (end is not None and state[1] is not None and end - state[1] > max_duration_ms):
            state = id_, start
        return state[0], state

    return fold(rows, "episode_id", ["start_ms", "id"], step, "head_id", cues.schema["id"].dataType, ["episode_id", "id"]).select("episode_id", "head_id", "id")


def utterance_spans(members: DataFrame, cues: DataFrame) -> DataFrame:
    """Joined texts and span of each group: the end is that of the last cue by start, not the largest."""
    c = cues.join(members.select("id", "head_id"), "id")
    row = F.struct("start_ms", "id", "text", strip(F.col("text_en")).alias("en"), "end_ms")
    g = c.groupBy("episode_id", "head_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    last = F.element_at("c", -1)
    return g.select(
        "episode_id",
        "head_id",
        F.size("c").cast("long").alias("n_cues"),
        F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"),
        F.array_join(F.filter(F.transform("c", lambda x: x["en"]), lambda t: t != ""), " ").alias("text_en"),
        F.col("c")[0]["start_ms"].alias("start_ms"),
        last["end_ms"].alias("end_ms"),
    )


def reconcile(members: DataFrame, cues: DataFrame, stored: DataFrame, links: DataFrame) -> DataFrame:
    """The next snapshot of utterances, a row for each group of ``members`` (as merge_cues gives them).

    A group whose cues are just those of a stored utterance of its episode keeps that one (of several the
    largest uid) and all its columns but text, speaker, role_id, emotion and kind, which come from its cues (the last
    four, and gender where cues have one, from the first), and source_hash, which is cleared where it isn't that
    of the cues. Other groups are new: uid and stored columns null. Utterances that no group keeps aren't in the
    result, nor are ``links`` (episode_id, uid, cue_id) of none; ``relinked`` gives the new ones."""
    fields = ("speaker", "role_id", "emotion", "kind", *(("gender",) if "gender" in cues.columns else ()))
    c = cues.join(members.select("id", "head_id"), "id")
    row = F.struct("start_ms", "id", "text", "end_ms", *fields)
    g = c.groupBy("episode_id", "head_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    g = g.select("episode_id", "head_id", F.array_sort(F.transform("c", lambda x: x["id"])).alias("ids"), F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"), *(F.col("c")[0][f].alias(f) for f in fields), source_hash("c").alias("_now"))
    held = links.groupBy("episode_id", "uid").agg(F.array_sort(F.collect_list("cue_id")).alias("ids")).groupBy("episode_id", "ids").agg(F.max("uid").alias("uid"))
    kept = [x for x in stored.columns if x not in ("episode_id", "uid", "text", "source_hash", *fields)]
    old = held.join(stored.select("episode_id", "uid", "source_hash", *kept), ["episode_id", "uid"])
    now = F.when(F.col("source_hash") == F.col("_now"), F.col("source_hash")).alias("source_hash")
    return g.join(old, ["episode_id", "ids"], "left").select("episode_id", "head_id", "uid", "text", *fields, now, *kept)


def relinked(members: DataFrame, snapshot: DataFrame, next_uid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot with a uid for its new utterances, and all links (episode_id, uid, cue_id) of its cues.

    New ones are numbered within their episode, by their first cue's id, after the last of ``next_uid``
    (episode_id, last), or from 1."""
    w = Window.partitionBy("episode_id").orderBy("head_id")
    new = snapshot.where("uid IS NULL").join(next_uid.select(F.col("episode_id").alias("_e"), "last"), F.col("episode_id") == F.col("_e"), "left")
    new = new.withColumn("uid", (F.coalesce("last", F.lit(0)) + F.row_number().over(w)).cast(snapshot.schema["uid"].dataType)).drop("_e", "last")
    told = snapshot.where("uid IS NOT NULL").unionByName(new)
    return told, members.join(told.select("episode_id", "head_id", "uid"), ["episode_id", "head_id"]).select("episode_id", "uid", F.col("id").alias("cue_id"))


def role_cues(cues: DataFrame, episodes: DataFrame, drama_id: int | None = None, role_id: int | None = None) -> DataFrame:
    """Cues that have a role, with the drama and the number of their episode; of a drama's role, where these are given."""
    e = episodes.select(F.col("id").alias("episode_id"), "drama_id", F.col("number").alias("episode_number"))
    c = cues.where("role_id IS NOT NULL" if role_id is None else F.col("role_id") == role_id)
    return c.join(e if drama_id is None else e.where(F.col("drama_id") == drama_id), "episode_id")


def best_samples(cues: DataFrame, episodes: DataFrame, available: DataFrame, wanted_ms: int = 5000) -> DataFrame:
    """drama_id, role_id and id of the cue that a role's voice is taken from: of its cues over the drama, in episodes that
    have a voice track (``available``: episode_id), that whose length is nearest to what is wanted, the first by
    episode and start among equals. Cues of episodes without a track give way to the next best."""
    c = role_cues(cues, episodes).join(available.select("episode_id").distinct(), "episode_id", "left_semi")
    off = F.abs(F.col("end_ms") - F.col("start_ms") - wanted_ms)
    return c.groupBy("drama_id", "role_id").agg(F.min_by("id", F.struct(off.alias("off"), "episode_id", "start_ms", "id")).alias("id"))


def translation_metrics(results: DataFrame) -> DataFrame:
    """One row of totals over ``results`` (status, extend_ms, retries); truncated ones count as failed."""
    s = F.col("status")
    kinds = {"ok": s == "ok", "compressed": s == "compressed", "failed": s.isin("failed", "truncated"), "skipped": s == "skipped"}
    sums = (F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}") for c in ("extend_ms", "retries"))
    return results.agg(F.count(F.lit(1)).alias("total"), *sums, *(F.count_if(of).alias(k) for k, of in kinds.items()))


def extend_ends(cues: DataFrame, least: int = 1200, more: int = 200) -> DataFrame:
    """new_end: longer ends that stay clear of the next start; the last row isn't capped."""
    w = Window.partitionBy("episode_id").orderBy("start_ms", "id")
    wanted = F.greatest("end_ms", F.col("start_ms") + least, F.col("end_ms") + more)
    following = F.lead("start_ms").over(w)
    return cues.withColumn("new_end", F.when(following.isNull(), wanted).otherwise(F.greatest("end_ms", F.least(wanted, following - more))))


def extension_allowance(cues: DataFrame, audio_end: Column) -> DataFrame:
    """gap to the next cue and allow_extend."""
    w = Window.partitionBy("episode_id").orderBy("start_ms", "id")
    gap = F.lead("start_ms").over(w) - F.col("end_ms")
    rest = audio_end - F.col("end_ms")
    base = F.when(gap >= 0, F.when(gap > 0, F.greatest(F.lit(0), gap - 60)).otherwise(F.lit(0))).when(rest > 0, rest).otherwise(F.lit(500))
    base = F.when(gap == 0, F.when(rest > 0, rest).otherwise(F.lit(500))).otherwise(base)
    budget = F.col("end_ms") - F.col("start_ms")
    return cues.withColumn("gap", gap).withColumn("allow_extend", F.when(budget < 900, F.greatest(base, F.least(900 - budget, F.lit(800)))).otherwise(base).cast("long"))


def needed_extension(cues: DataFrame, need: Column) -> DataFrame:
    """extend: what is needed, within 200 ms and 60 ms clear of the next cue."""
    w = Window.partitionBy("episode_id").orderBy("start_ms", "id")
    free = F.coalesce(F.lead("start_ms").over(w) - F.col("end_ms") - 60, F.lit(200))
    cap = F.greatest(F.lit(0), F.least(F.lit(200), free))
    return cues.withColumn("extend", F.least(F.greatest(need, F.lit(0)), cap).cast("long"))


def fill_emotions(cues: DataFrame, emotion: str = "emotion") -> DataFrame:
    """filled: a missing emotion from the nearest of the two cues on either side that have the
    same speaker and a marked one, earlier fills counting; else neutral.

    What comes after a cue is a window's; the two last filled cues are the state of a fold along an
    episode's cues."""
    w = Window.partitionBy("episode_id").orderBy("start_ms", "id", "speaker", "e")
    c = cues.repartition("episode_id").select("episode_id", "start_ms", "id", "speaker", F.col(emotion).alias("e"))
    marked = lambda n: F.when((F.lead("speaker", n).over(w) == F.col("speaker")) & (F.lead("e", n).over(w) != "neutral") & (F.lead("e", n).over(w) != ""), F.lead("e", n).over(w))
    c = c.withColumns({"next1": marked(1), "next2": marked(2)})

    def step(state: tuple | None, row: tuple) -> tuple[object, tuple]:
        _, _, _, speaker, own, next1, next2 = row
        one, two = state or ((None, None), (None, None))
        of = lambda cue: cue[1] if speaker is not None and cue[0] == speaker and cue[1] not in (None, "", "neutral") else None
        value = own if own is not None else of(one) or next1 or of(two) or next2 or "neutral"
        return value, ((speaker, value), one)

    return fold(c, "episode_id", ["start_ms", "id", "speaker", "e"], step, "filled", StringType(), ["episode_id", "id"])
