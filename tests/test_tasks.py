"""Tasks submitted and changed, links, samples, templates: at their limits."""

from pyspark.sql import functions as F

from cuewright.functions import rates, text
from cuewright.operators import timeline, workflow

TASK = "id long, episode_id long, type string, status string"


def test_submitted_work(spark):
    e = spark.createDataFrame([(k, "ready") for k in range(1, 7)], "id long, status string")
    t = spark.createDataFrame([(1, 1, "asr", "running"), (2, 2, "asr", "failed"), (3, 3, "parse", "succeeded"), (4, 4, "burn", "succeeded"), (5, 5, "asr", "succeeded"), (6, 5, "source_review", "pending"), (7, 9, "asr", "pending")], TASK)
    made = lambda d: {(r.episode_id, r.type, r.force) for r in d.where("id IS NULL").collect()}
    tasks, episodes = workflow.submit(e, t)
    assert made(tasks) == {(2, "asr", False), (3, "source_review", None), (6, "extract", False)} and tasks.where("id IS NOT NULL").count() == 7
    assert {r.id: r.status for r in episodes.collect()} == {1: "ready", 2: "running", 3: "review", 4: "ready", 5: "ready", 6: "running"}
    tasks, episodes = workflow.submit(e, t, first="translate")
    assert made(tasks) == {(k, "translate", True) for k in range(1, 7)}
    assert sorted(r.id for r in tasks.where("id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 7]  # the pending gate of 5 goes, another episode's task stays
    assert {r.status for r in episodes.collect()} == {"running"}
    assert workflow.submit(e.limit(0), t)[0].where("id IS NULL").count() == 0


def test_transitions_in_order(spark):
    t = spark.createDataFrame([(k, s, None, None, None, "x") for k, s in enumerate(["pending", "running", "pending", "succeeded", "pending", "pending"])], "id long, status string, claimed_at long, finished_at long, error string, more string")
    c = [(0, "claim", 5, None), (0, "claim", 6, None), (0, "complete", 7, None), (1, "claim", 5, None), (1, "fail", 6, "lost"), (2, "pass", 5, None), (2, "pass", 9, None), (3, "pass", 5, None), (4, "pass", 6, None), (4, "claim", 5, None), (99, "fail", 1, None)]
    got = {r.id: (r.status, r.claimed_at, r.finished_at, r.error, r.more) for r in workflow.transition(t, spark.createDataFrame(c, "id long, change string, at long, error string")).collect()}
    assert got == {0: ("succeeded", 5, 7, None, "x"), 1: ("failed", None, 6, "lost", "x"), 2: ("succeeded", None, 5, None, "x"), 3: ("succeeded", None, None, None, "x"), 4: ("running", 5, None, None, "x"), 5: ("pending", None, None, None, "x")}


def test_links_of_new_utterances_and_gender(spark):
    cue = lambda i, s, g: (i, 1, s, s + 50, "a", None, "neutral", f"t{i}", "", "speech", g)
    c = spark.createDataFrame([cue(1, 0, "f"), cue(2, 60, "m"), cue(3, 5000, "m"), cue(4, 9000, None)], "id long, episode_id long, start_ms long, end_ms long, speaker string, role_id long, emotion string, text string, text_en string, kind string, gender string")
    stored = spark.createDataFrame([(1, 7, "old", "m")], "episode_id long, uid long, source_hash string, gender string")
    links = spark.createDataFrame([(1, 7, 1), (1, 7, 2)], "episode_id long, uid long, cue_id long")
    members = timeline.merge_cues(c)
    snapshot = timeline.reconcile(members, c, stored, links)
    told, linked = timeline.relinked(members, snapshot, spark.createDataFrame([(1, 7)], "episode_id long, last long"))
    assert {(r.head_id, r.uid, r.gender) for r in told.collect()} == {(1, 7, "f"), (3, 8, "m"), (4, 9, None)}
    assert {(r.uid, r.cue_id) for r in linked.collect()} == {(7, 1), (7, 2), (8, 3), (9, 4)}


def test_samples_fall_through_to_episodes_with_a_track(spark):
    c = spark.createDataFrame([(1, 1, 0, 5000, 5), (2, 2, 0, 4000, 5), (3, 2, 9, 6009, 5), (4, 3, 0, 6000, 5), (5, 2, 0, 1, None), (6, 1, 0, 1, 6)], "id long, episode_id long, start_ms long, end_ms long, role_id long")
    e = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3)], "id long, drama_id long, number long")
    got = timeline.best_samples(c, e, spark.createDataFrame([(2,), (3,), (3,)], "episode_id long"))
    assert [tuple(r) for r in got.collect()] == [(1, 5, 2)]  # equals stand by episode, then start
    assert timeline.role_cues(c, e, 1, 5).count() == 4 and timeline.role_cues(c, e, 2, 5).count() == 0


def test_templates_and_fast_speech(spark):
    df = spark.createDataFrame([("a {x} {y}{z} $1", "{y}", None), ("", "1", "2"), ("{x}", "\\1 $0", "2"), (None, "1", "2")], "t string, x string, y string")
    assert [r[0] for r in df.select(text.filled(F.col("t"), {"x": F.col("x"), "y": F.col("y")})).collect()] == ["a {y} {z} $1", "", "\\1 $0", None]
    said = {"": False, None: False, "one two three": True, "one two three four": False, "a b c d OH": True, "what is that thing": True, " a  b \n c ": True, "x": True}
    rows = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r[0]: r[1] for r in rows.select("t", rates.aggressive_allowed(F.col("t"))).collect()} == said
    assert [r[0] for r in spark.createDataFrame([("a",), (None,), ("q",)], "k string").select(text.label(F.col("k"), {"a": "A"}, "?")).collect()] == ["A", "?", "?"]
