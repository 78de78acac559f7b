"""What follows from a task's end, and what a watcher of an episode is told: rules of one event at a time.

A rule is a function of a state and an event. Over a table of events it is folded along each episode
(``reactions``, ``told``); ``cuewright.streaming.reactor`` runs the same rules over a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..sources.adapters import GATE_AFTER, PHASES
from .folds import fold
from .workflow import active_range

State = dict
Rule = Callable[[State | None, tuple], tuple[list[tuple], State]]

#: What a rule says of an event; both tables and streams have these columns after episode_id and seq.
ACTION = "action string, value string, force boolean"
NOTICE = "event string, type string, task_id long, error string"

_GATES = {gate: phase for phase, gate in GATE_AFTER.items()}


def reactor(first: str | None = None, last: str | None = None) -> Rule:
    """The rule of what is done when a task ends, for work on the phases from ``first`` to ``last``.

    Events are (kind, type): task_succeeded and task_failed with the task's type, status with an episode's new
    status. Actions: create (a task of a type; force where ``first`` is given and the phase isn't before it),
    status (of the episode), emit (gate_awaiting, pipeline_done, pipeline_failed). A phase is only
    created for an episode that is running or in review (or of unknown status): one that was stopped stays so.
    A passed gate isn't asked for again unless ``first`` is given."""
    active = active_range(first, last)
    following = dict(zip(active, active[1:], strict=False))

    def rule(state: State | None, event: tuple) -> tuple[list[tuple], State]:
        kind, type_ = event
        status, passed = (state or {}).get("status"), dict((state or {}).get("passed", {}))
        out: list[tuple] = []

        def say(action: str, value: str, force: bool | None = None) -> None:
            nonlocal status
            out.append((action, value, force))
            if action == "status":
                status = value

        def go_on(phase: str) -> None:
            if status in (None, "running", "review"):
                say("create", phase, first is not None and PHASES.index(phase) >= PHASES.index(first))

        def done() -> None:
            say("status", "succeeded")
            say("emit", "pipeline_done")

        if kind == "status":
            status = type_
        elif kind == "task_failed":
            passed.pop(type_, None)
            say("status", "failed")
            say("emit", "pipeline_failed")
        elif kind == "task_succeeded" and type_ in _GATES:
            passed[type_] = True
            phase = following.get(_GATES[type_])
            if phase:
                go_on(phase)
                say("status", "running")
            else:
                done()
        elif kind == "task_succeeded":
            phase, gate = following.get(type_), GATE_AFTER.get(type_)
            if phase is None:
                done()
            elif gate and (first is not None or not passed.get(gate)):
                passed.pop(gate, None)
                say("create", gate)
                say("status", "review")
                say("emit", "gate_awaiting")
            else:
                go_on(phase)
        return out, {"status": status, "passed": passed}

    return rule


def feed_rule() -> Rule:
    """The rule of a feed over an episode that ends.

    Events are (task_id, type, status, error) of a task, or of an episode (task_id null, its status). Each (task,
    status) that isn't pending is told once. Once the episode's status is succeeded, failed (with the error of
    its newest task) or ready, or review with no phase pending or running, a last notice follows; what
    is known of its tasks is forgotten then, and nothing is told any more."""

    def rule(state: State | None, event: tuple) -> tuple[list[tuple], State]:
        state = state or {"seen": [], "tasks": {}, "status": None}
        if state.get("ended"):
            return [], state
        id_, type_, status, error = event
        out: list[tuple] = []
        if id_ is None:
            state = {**state, "status": status}
        else:
            state = {**state, "tasks": {**state["tasks"], str(id_): [type_, status, error]}}
            if status != "pending" and [id_, status] not in state["seen"]:
                state = {**state, "seen": [*state["seen"], [id_, status]]}
                out.append((f"{type_}_{status}", type_, id_, None))
        now, tasks = state["status"], state["tasks"]
        last = None
        if now in ("succeeded", "failed"):
            newest = tasks[max(tasks, key=int)] if tasks else (None, None, None)
            last = (f"pipeline_{now}", None, None, (newest[2] or "Pipeline failed (unknown error)") if now == "failed" else None)
        elif now == "ready":
            last = ("pipeline_stopped", None, None, None)
        elif now == "review" and not any(s in ("pending", "running") and t not in _GATES for t, s, _ in tasks.values()):
            gates = [tasks[k][0] for k in sorted(tasks, key=int) if tasks[k][0] in _GATES and tasks[k][1] == "pending"]
            last = ("gate_awaiting", gates[0] if gates else "", None, None)
        if last:
            return [*out, last], {"ended": True}
        return out, state

    return rule


def _folded(events: DataFrame, rule: Rule, fields: list[str], said: str) -> DataFrame:
    kind = ArrayType(StructType.fromDDL(said))
    names = StructType.fromDDL(said).names
    rows = events.select("episode_id", "seq", *fields)
    step = lambda state, row: _as_rows(rule(state, row[2:]), names)
    out = fold(rows, "episode_id", ["seq"], step, "said", kind, ["episode_id", "seq"])
    return out.select("episode_id", "seq", F.posexplode("said").alias("step", "s")).select("episode_id", "seq", "step", "s.*")


def _as_rows(made: tuple[list[tuple], State], names: list[str]) -> tuple[list[dict], State]:
    return [dict(zip(names, row, strict=True)) for row in made[0]], made[1]


def reactions(events: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """episode_id, seq, step, action, value and force of all that follows from ``events`` (episode_id, seq, kind, type)."""
    return _folded(events, reactor(first, last), ["kind", "type"], ACTION)


def told(events: DataFrame) -> DataFrame:
    """episode_id, seq, step, event, type, task_id and error of all that a watcher of each episode is told.
    ``events``: episode_id, seq, task_id, type, status, error."""
    return _folded(events, feed_rule(), ["task_id", "type", "status", "error"], NOTICE)


def result_of(events: DataFrame, said: str) -> StructType:
    """The columns of what is said of ``events``."""
    return StructType([events.schema["episode_id"], events.schema["seq"], *StructType.fromDDL(f"step int, {said}").fields])
