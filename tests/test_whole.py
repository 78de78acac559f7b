"""Queries over small tables that a cut would show in."""

from pyspark.sql import functions as F

from cuewright.operators import timeline
from cuewright.plans import QUERIES


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def event(i, episode, kind):
    from datetime import datetime

    return (i, datetime(2024, 1, 1, 0, 0, i), episode, kind, 1.0, '{"k": 1}')


def test_ranges_of_every_order(spark, tmp_path):
    sf = written(spark, tmp_path, lineitem=([(1, 1), (199, 2), (200, 3), (90_000, 4)], "l_orderkey long, l_linenumber int"))
    assert sorted(map(tuple, QUERIES["str_20_range"](spark, sf).collect())) == [(o, n, n + k) for o, n in ((1, 1), (199, 2), (200, 3), (90_000, 4)) for k in range(3)]


def test_index_of_every_cue_without_error(spark, tmp_path):
    # role of a cue: none where its id is a multiple of 4, else id % 3; role 1 has a voice, 2 has none, 0 isn't there
    events = [event(i, 7, "error" if i in (5, 6) else "view") for i in range(1, 9)]
    part = [(1, "a", "Brand#1", "t", 1, 1.0), (2, "b", "Brand#2", "t", 50, 1.0)]
    sf = written(spark, tmp_path, events=(events, EVENTS), part=(part, PART))
    assert [tuple(r) for r in QUERIES["snk_5_index"](spark, sf).collect()] == [(7, "1=1:Brand#1,2=2:,3=0:,4=:,7=1:Brand#1,8=:")]


def test_alignment_of_texts_of_any_length(spark, tmp_path):
    import re

    def walk(text):
        out, at = [], 0
        for t in (x.strip() for x in re.split(r"(?<=[。！？!?])", text)):
            said = [c for c in t if not re.match("[，。！？、；：\"'（）…—\\s,.!?-]", c)]
            if said:
                first = last = text.index(said[0], at)
                for c in said[1:]:
                    last = text.index(c, last + 1)
                out.append((int(first * 0.06 * 1000), int((last + 1) * 0.06 * 1000), t))
                at = last + 1
        return out

    long = "How far is it to the 城 over there? 很远。Then let us go at once! " * 60 + "without a mark at the end"
    texts = ["", "One. Two! Three?", "x" * 400 + "! y", "x" * 401 + "! y", long, None]
    sf = written(spark, tmp_path, conversations=([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string"))
    got = sorted((r.id - 1000, r.start_ms, r.end_ms, r.text) for r in QUERIES["win_15_align"](spark, sf).collect())
    assert len(long) > 3000 and got == sorted((k, *s) for k, t in enumerate(texts) for s in walk(t or ""))


def test_every_order_is_an_episode(spark, tmp_path):
    from datetime import datetime

    from cuewright.sources import adapters as A

    orders = [(k, c, "O", datetime(2024, 1, 1)) for k, c in ((1, 1), (2, 1), (3, 1), (4, 2))]
    customers = [(c, f"c{c}", 1, "s") for c in (1, 2, 3)]
    events = [event(i, episode, "view") for i, episode in ((1, 1), (2, 2), (3, 3), (5, 99))]
    sf = written(spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"), customer=(customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"), events=(events, EVENTS))
    assert sorted((r.id, r.drama_id, r.number) for r in A.episodes(spark, sf).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 2, 1)]
    assert A.dramas(spark, sf).join(A.episodes(spark, sf).select(F.col("drama_id").alias("id")), "id", "left_anti").count() == 1
    assert sorted(r.id for r in QUERIES["jn_9_semi"](spark, sf).collect()) == [1, 2, 3]  # 99 has no episode


def test_roles_beyond_the_second_are_found(spark, tmp_path):
    events = [event(i, 1, "view") for i in (1, 2, 3, 4)]  # roles 1, 2, 0, none
    part = [(1, "a", "Brand#1", "t", 1, 1.0), (2, "b", "Brand#2", "t", 1, 1.0)]
    sf = written(spark, tmp_path, events=(events, EVENTS), part=(part, PART))
    assert sorted(map(tuple, QUERIES["jn_12_lookup_with_default"](spark, sf).collect())) == [(1, "a"), (2, "b"), (3, "0"), (4, "-")]


def test_only_marks_of_the_whole_text(spark, tmp_path):
    wanted = {'"quoted" text': False, "(a)": False, "$5": False, "...": True, "“！？” …": True, "- - -\n": True, "": True, ".\na": False}
    sf = written(spark, tmp_path, documents=(list(enumerate(wanted)), "doc_id long, text string"))
    got = {r.doc_id: r.only_marks for r in QUERIES["str_5_6_7_12_classes"](spark, sf).collect()}
    assert [got[i] for i in range(len(wanted))] == list(wanted.values())


def test_parsers_and_names_in_queries(spark, tmp_path):
    sf = written(spark, tmp_path, conversations=([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string"))
    one = lambda q: QUERIES[q](spark, sf).collect()[0][1]
    assert one("str_9_tagged") == ["user", "", "hi"]
    assert one("str_10_simple") == ["user", "hi", ""]
    assert one("str_11_restored") == "Li Ming met Wang Fang. hi"
    assert one("jsn_4_context") == '{"context_type":"dialog_ctx","context_data":[{"text":"episode 1"},{"text":"常见词汇：user"}]}'


def test_roles_in_chinese_order_and_five_recent(spark, tmp_path):
    part = [(5 + 20 * 5 * k, n, "Brand#1", "t", 1, 1.0) for k, n in enumerate("王张李")]
    events = [event(i, 7, f"k{i}") for i in range(1, 8)]
    sf = written(spark, tmp_path, part=(part, PART), events=(events, EVENTS))
    assert [r.names for r in QUERIES["srt_5_roles_by_priority"](spark, sf).collect()] == ["李|王|张"]
    assert sorted(r.id for r in QUERIES["win_10_most_recent"](spark, sf).collect()) == [3, 4, 5, 6, 7]


def test_emotions_are_folded_as_a_stream(spark, capsys):
    import random

    from cuewright.operators import timeline

    rng = random.Random(3)
    cues = [(i, e, i // 2, rng.choice("ab"), rng.choice([None, None, "happy", "sad", "neutral", ""])) for e in (1, 2) for i in range(e * 1000, e * 1000 + 300)]
    wanted = {}
    for e in (1, 2):
        c = [list(x) for x in cues if x[1] == e]
        for i, x in enumerate(c):
            near = [c[k] for k in (i - 1, i + 1, i - 2, i + 2) if 0 <= k < len(c)]
            if x[4] is None:
                x[4] = next((n[4] for n in near if n[3] == x[3] and n[4] not in (None, "", "neutral")), "neutral")
            wanted[x[0]] = x[4]
    out = timeline.fill_emotions(spark.createDataFrame(cues, "id long, episode_id long, start_ms long, speaker string, emotion string"))
    assert {r.id: r.filled for r in out.collect()} == wanted
    out.explain("simple")
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1  # a stream, in the partitions that the window has


def test_a_million_cues_in_one_run(spark):
    """A fold takes time by the number of cues, however long a run is; rows as a plain walk gives them."""
    import time

    n = 1_000_000
    cues = spark.range(n).selectExpr("id", "1L AS episode_id", "id * 10 AS start_ms", "id * 10 + 9 + (id % 7) * 100 AS end_ms", "'a' AS speaker", "CAST(NULL AS long) AS role_id", "'neutral' AS emotion")
    began = time.time()
    got = timeline_of(cues)
    assert time.time() - began < 60
    wanted, head, first = {}, 0, 0
    for i in range(n):
        if i * 10 + 9 + (i % 7) * 100 - first > 10_000:
            head, first = i, i * 10
        wanted[head] = wanted.get(head, 0) + 1
    assert got == wanted
    filled = timeline.fill_emotions(cues.withColumn("emotion", F.expr("CASE WHEN id = 0 THEN 'sad' END")))
    assert [tuple(r) for r in filled.groupBy("filled").count().collect()] == [("sad", n)]


def timeline_of(cues):
    return {r.head_id: r["count"] for r in timeline.merge_cues(cues).groupBy("head_id").count().collect()}


def test_names_are_restored_by_one_worker_a_task(spark, sf_dir, capsys):
    """Texts go to Python once; results of more rows than are objects at once."""
    from cuewright.functions import parse

    for name in ("str_11_restored", "str_11_finished"):
        QUERIES[name](spark, sf_dir).explain("simple")
        assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    names = F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE array('Li Ming', NULL, concat('Wang N', id)) END")
    t = F.expr("CASE WHEN id % 5 <> 0 THEN concat('<<NAME_0>> li\\'ming <<NAME_2:x>> wangn', id, ' <<NAME_9>>') END")
    rows = spark.range(1000).coalesce(1).select("id", t.alias("t"), parse.restore_and_repair_names(t, names).alias("one"), parse.repair_names(parse.restore_names(t, names), names).alias("two")).collect()
    for r in rows:
        wanted = None if r.t is None else r.t if r.id % 3 == 0 else f"Li Ming li'ming Wang N{r.id} wangn{r.id} <<NAME_9>>"
        assert r.one == r.two == wanted
