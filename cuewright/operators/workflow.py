"""States derived from task histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import GATE_AFTER, PHASES, STEPS

#: Stages of the display and their phases; fixed values.
STAGES = {"extract": ("extract",), "recognize": ("asr", "parse"), "translate": ("translate",), "dub": ("tts", "mix"), "compose": ("burn",)}


def latest(tasks: DataFrame, *keys: str) -> DataFrame:
    """The newest task of each key; partial maxima, no sort."""
    names = [c for c in tasks.columns if c not in keys]
    return tasks.groupBy(*keys).agg(F.max_by(F.struct(*names), "id").alias("t")).select(*keys, "t.*")


def episode_status(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    t = latest(tasks.select("episode_id", "id", "status"), "episode_id").select(F.col("episode_id").alias("_e"), F.col("status").alias("s"))
    status = F.when(F.col("s") == "running", "running").when(F.col("s") == "pending", "review").when(F.col("s") == "failed", "failed").otherwise("ready")
    return episodes.join(t, F.col("id") == F.col("_e"), "left").select("id", status.alias("derived"))


def _newest(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """episode_id, of (newest status by type, null without tasks) and legacy: succeeded before there were tasks of phases."""
    t = latest(tasks.select("episode_id", "type", "id", "status"), "episode_id", "type")
    t = t.groupBy(F.col("episode_id").alias("_e")).agg(F.map_from_entries(F.collect_list(F.struct("type", "status"))).alias("of"), F.bool_or(F.col("type").isin(*PHASES)).alias("has"))
    e = episodes.select(F.col("id").alias("episode_id"), F.col("status").alias("_s")).join(t, F.col("episode_id") == F.col("_e"), "left")
    return e.select("episode_id", "of", (F.col("_s").eqNullSafe("succeeded") & ~F.coalesce("has", F.lit(False))).alias("legacy"))


def phases(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every phase of every episode (id, status) with its newest status; without a task it is pending,
    or succeeded where the episode was before there were tasks."""
    e = _newest(episodes, tasks).select("episode_id", "of", "legacy", F.posexplode(F.array(*(F.lit(p) for p in PHASES))).alias("ordinal", "type"))
    return e.select("episode_id", "ordinal", "type", F.coalesce(F.col("of")[F.col("type")], F.when(F.col("legacy"), "succeeded").otherwise("pending")).alias("status"))


def gate_status(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every gate of every episode: passed, awaiting (the phase before it is done) or pending."""
    of = F.col("of")
    state = lambda phase, gate: F.when(F.col("legacy") | of[gate].eqNullSafe("succeeded"), "passed").when(of[phase].eqNullSafe("succeeded"), "awaiting").otherwise("pending")
    return _newest(episodes, tasks).select("episode_id", *(state(phase, gate).alias(gate) for phase, gate in GATE_AFTER.items()))


def stage_status(all_phases: DataFrame) -> DataFrame:
    stage = F.lit(None).cast("string")
    for name, of in STAGES.items():
        stage = F.when(F.col("type").isin(*of), name).otherwise(stage)
    s = F.col("status")
    rolled = F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "running"), "running").when(F.bool_and(s.isin("succeeded", "skipped")), "succeeded").otherwise("pending")
    return all_phases.groupBy("episode_id", stage.alias("stage")).agg(rolled.alias("status"))


def active_range(first: str | None = None, last: str | None = None) -> tuple[str, ...]:
    """Phases from ``first`` to ``last``, by default all."""
    for p in (first, last):
        if p is not None and p not in PHASES:
            raise ValueError(f"unknown phase: {p}")
    a, b = PHASES.index(first) if first else 0, PHASES.index(last) if last else len(PHASES) - 1
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return PHASES[a : b + 1]


def reset_to(tasks: DataFrame, step: str) -> DataFrame:
    """Tasks after work goes back to a step: episodes whose newest task of it succeeded lose it and all later ones, and get a pending one (id null)."""
    ordinal = F.array_position(F.array(*(F.lit(s) for s in STEPS)), F.col("type"))
    back = latest(tasks.where(F.col("type") == step).select("episode_id", "id", "status"), "episode_id").where("status = 'succeeded'").select(F.col("episode_id").alias("_e"))
    kept = tasks.join(back, F.col("episode_id") == F.col("_e"), "left").where(F.col("_e").isNull() | (ordinal < STEPS.index(step) + 1)).select("id", "episode_id", "type", "status")
    return kept.unionByName(back.select(F.lit(None).cast("long").alias("id"), F.col("_e").alias("episode_id"), F.lit(step).alias("type"), F.lit("pending").alias("status")))


def resume(tasks: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """What comes next for every episode with tasks, in the active range: wait (its newest task is
    pending or running), a failed phase again, a gate that isn't passed, the phase after the last that
    succeeded, done, or the first phase. An explicit ``first`` doesn't wait: the range starts anew.

    episode_id, type and status of the newest task, leads_to, creates (whether a task has to be made:
    a gate that is pending already isn't made again)."""
    active = active_range(first, last)
    in_range = F.col("type").isin(*active)
    gates = {g: F.max_by(F.when(F.col("type") == g, F.col("status")), F.when(F.col("type") == g, F.col("id"))) for g in GATE_AFTER.values()}
    t = tasks.groupBy("episode_id").agg(
        F.max_by(F.struct("type", "status"), "id").alias("t"),
        F.max_by(F.when(in_range, F.col("type")), F.when(in_range & (F.col("status") == "succeeded"), F.col("id"))).alias("done"),
        *(s.alias(g) for g, s in gates.items()),
    )
    t = t.select("episode_id", "t.*", "done", *gates)
    after = F.lit(None).cast("string")
    held, open_gate = F.lit(False), F.lit(None).cast("string")
    for phase, gate in GATE_AFTER.items():
        not_passed = (F.col("done") == phase) & ~F.col(gate).eqNullSafe("succeeded")
        open_gate = F.when(not_passed, gate).otherwise(open_gate)
        held = held | F.coalesce(not_passed & F.col(gate).eqNullSafe("pending"), F.lit(False))
    for phase, following in zip(active, (*active[1:], "done"), strict=True):
        after = F.when(F.col("done") == phase, following).otherwise(after)
    busy = F.col("status").isin("pending", "running")
    leads = F.when(F.lit(first is not None), active[0]).when(busy, "wait").when((F.col("status") == "failed") & in_range, F.col("type"))
    leads = leads.otherwise(F.coalesce(open_gate, after, F.lit(active[0])))
    return t.withColumn("leads_to", leads).select("episode_id", "type", "status", "leads_to", (~F.col("leads_to").isin("wait", "done") & ~(F.col("leads_to").isin(*GATE_AFTER.values()) & held)).alias("creates"))


def submit(episodes: DataFrame, tasks: DataFrame, first: str | None = None, last: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tasks (id, episode_id, type, status, force) and episodes once work on every one of ``episodes`` is asked for.

    An episode whose newest task is pending or running stays as it is, unless ``first`` is given: then its
    pending tasks go, and the range starts anew. Others get a task (id null, pending; force as ``first`` is
    given): a failed phase again, a gate that isn't passed, the phase after the last that succeeded, or the first
    one, as an episode without tasks does. Status: review before a gate, running before a phase."""
    active, forced = active_range(first, last), F.lit(first is not None)
    keys = episodes.select(F.col("id").alias("episode_id"))
    t = tasks.join(keys, "episode_id", "left_semi").select("id", "episode_id", "type", "status")
    busy = latest(t, "episode_id").where(F.col("status").isin("pending", "running")).select(F.col("episode_id").alias("_e"))
    kept = tasks.select("id", "episode_id", "type", "status")
    if first is not None:
        kept = kept.join(busy, F.col("episode_id") == F.col("_e"), "left").where(F.col("_e").isNull() | (F.col("status") != "pending")).drop("_e")
    said = keys.join(resume(t, first, last).select("episode_id", "leads_to", "creates"), "episode_id", "left")
    said = said.select("episode_id", F.coalesce("leads_to", F.lit(active[0])).alias("leads_to"), F.coalesce("creates", F.lit(True)).alias("creates"))
    made = said.where("creates").select(F.lit(None).cast(tasks.schema["id"].dataType).alias("id"), "episode_id", F.col("leads_to").alias("type"), F.lit("pending").alias("status"))
    gate = F.col("leads_to").isin(*GATE_AFTER.values())
    status = said.where(~F.col("leads_to").isin("wait", "done")).select(F.col("episode_id").alias("_e"), F.when(gate, "review").otherwise("running").alias("_s"))
    told = episodes.join(status, F.col("id") == F.col("_e"), "left").withColumn("status", F.coalesce("_s", "status")).drop("_e", "_s")
    return kept.withColumn("force", F.lit(None).cast("boolean")).unionByName(made.withColumn("force", F.when(~F.col("type").isin(*GATE_AFTER.values()), forced))), told


def transition(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """``tasks`` (id, status, claimed_at, finished_at, error, ..) after ``changes`` (id, change, at, error): claim a pending
    task, complete or fail any; pass a pending gate. Of several changes of a task they take effect in order of at:
    a claim or a pass of a task that isn't pending by then does nothing."""
    order = F.sort_array(F.collect_list(F.struct("at", "change", "error")))
    c = changes.groupBy(F.col("id").alias("_id")).agg(order.alias("_c"))
    names = ("status", "claimed_at", "finished_at", "error")
    state = F.struct(*(F.col(n) for n in names))

    def step(s: Column, x: Column) -> Column:
        is_ = lambda *k: x["change"].isin(*k)
        pending = s["status"] == "pending"
        claims, ends = is_("claim") & pending, is_("complete", "fail") | (is_("pass") & pending)
        status = F.when(claims, "running").when(ends, F.when(is_("fail"), "failed").otherwise("succeeded")).otherwise(s["status"])
        return F.struct(status.alias("status"), F.when(claims, x["at"]).otherwise(s["claimed_at"]).alias("claimed_at"), F.when(ends, x["at"]).otherwise(s["finished_at"]).alias("finished_at"), F.when(is_("fail"), x["error"]).otherwise(s["error"]).alias("error"))

    j = tasks.join(c, F.col("id") == F.col("_id"), "left").withColumn("_s", F.aggregate(F.coalesce("_c", F.array().cast(c.schema["_c"].dataType)), state, step))
    return j.select(*(F.col(f"_s.{n}").alias(n) if n in names else F.col(n) for n in tasks.columns))


def pass_gate(tasks: DataFrame, gate: str) -> DataFrame:
    """id, episode_id, type, status of all tasks once a gate is passed: its newest pending task succeeded,
    or, where none is pending and it isn't passed, a new one (id null). Episodes with another task pending
    or running last stay as they are."""
    t = tasks.select("id", "episode_id", "type", "status")
    of = t.groupBy(F.col("episode_id").alias("_e")).agg(
        F.max(F.when((F.col("type") == gate) & (F.col("status") == "pending"), F.col("id"))).alias("gate"),
        F.max_by(F.when(F.col("type") == gate, F.col("status")), F.when(F.col("type") == gate, F.col("id"))).alias("was"),
        F.max_by(F.struct("type", "status"), "id").alias("last"),
    )
    busy = (F.col("last.type") != gate) & F.col("last.status").isin("pending", "running")
    of = of.where(~busy).drop("last")
    told = t.join(of, F.col("episode_id") == F.col("_e"), "left").select("id", "episode_id", "type", F.when(F.col("id") == F.col("gate"), "succeeded").otherwise(F.col("status")).alias("status"))
    made = of.where("gate IS NULL AND NOT was <=> 'succeeded'").select(F.lit(None).cast(t.schema["id"].dataType).alias("id"), F.col("_e").alias("episode_id"), F.lit(gate).alias("type"), F.lit("succeeded").alias("status"))
    return told.unionByName(made)


def reset_orphans(episodes: DataFrame, tasks: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """Running tasks failed, as no worker has them; and the status of the episodes that had one, from their newest task."""
    lost = F.col("status") == "running"
    reset = tasks.withColumn("error", F.when(lost, error)).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))
    of = reset.groupBy(F.col("episode_id").alias("_e")).agg(F.max_by("status", "id").alias("_s"), F.count("error").alias("_lost")).where("_lost > 0")
    derived = F.when(F.col("_s") == "pending", "review").when(F.col("_s") == "failed", "failed").otherwise("ready")
    told = episodes.join(of, F.col("id") == F.col("_e"), "left").withColumn("status", F.when(F.col("_e").isNull(), F.col("status")).otherwise(derived))
    return told.drop("_e", "_s", "_lost"), reset


def should_run(forced: Column, recorded: Column, version_same: Column, inputs: Column, outputs: Column, status: Column) -> Column:
    return F.when(forced, "forced").when(~recorded, "not recorded").when(~version_same, "version changed").when(~inputs, "missing input").when(~outputs, "missing output").when(status != "succeeded", "status").otherwise("skip")


def reusable(size: Column, force: Column) -> Column:
    """Whether an artifact of ``size`` bytes (null: there is none) stands for another run."""
    return (F.coalesce(size, F.lit(0)) > 0) & ~force
