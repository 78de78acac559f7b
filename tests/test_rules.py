"""Hand-made cases at the rules' limits."""

import pytest
from pyspark.sql import functions as F

from cuewright.functions import parse, rates, text
from cuewright.operators import glossary, snapshots, timeline, workflow
from cuewright.sources import formats
from cuewright.streaming import feed

CUE = "id long, episode_id long, start_ms long, end_ms long, speaker string, role_id long, emotion string, text string, text_en string, kind string"


def cue(i, start, end, speaker="a", role=None, emotion="neutral", episode=1):
    return (i, episode, start, end, speaker, role, emotion, f"t{i}", f" e{i} ", "speech")


def groups(spark, rows):
    out = {}
    for r in timeline.merge_cues(spark.createDataFrame(rows, CUE)).collect():
        out.setdefault(r.head_id, []).append(r.id)
    return sorted(sorted(v) for v in out.values())


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([cue(1, 0, 100), cue(2, 600, 700)], [[1, 2]]),  # a gap of 500
        ([cue(1, 0, 100), cue(2, 601, 700)], [[1], [2]]),
        ([cue(1, 0, 900), cue(2, 100, 700)], [[1, 2]]),  # an overlap
        ([cue(1, 0, 9000), cue(2, 9100, 10_000)], [[1, 2]]),  # a duration of 10,000
        ([cue(1, 0, 9000), cue(2, 9100, 10_001)], [[1], [2]]),
        ([cue(1, 0, 9000), cue(2, 9100, 10_001), cue(3, 10_002, 19_000)], [[1], [2, 3]]),  # the limit counts from the new head
        ([cue(1, 0, 10), cue(2, 20, 30, emotion="sad")], [[1], [2]]),
        ([cue(1, 0, 10, role=1), cue(2, 20, 30, "b", 1)], [[1, 2]]),  # roles outrank speakers
        ([cue(1, 0, 10, role=1), cue(2, 20, 30, role=2)], [[1], [2]]),
        ([cue(1, 0, 10, role=1), cue(2, 20, 30)], [[1], [2]]),
        ([cue(1, 0, 10), cue(2, 20, 30, "b")], [[1], [2]]),
        ([cue(2, 0, 10), cue(1, 0, 10)], [[1, 2]]),  # equal starts
        ([], []),
    ],
)
def test_merge(spark, rows, wanted):
    assert groups(spark, rows) == wanted


def test_spans_end_with_the_last_cue(spark):
    c = spark.createDataFrame([cue(1, 0, 900), cue(2, 100, 700)], CUE)
    r = timeline.utterance_spans(timeline.merge_cues(c), c).first()
    assert (r.text, r.text_en, r.start_ms, r.end_ms, r.n_cues) == ("t1t2", "e1 e2", 0, 700, 2)


def test_emotions_cascade_within_a_speaker(spark):
    rows = [cue(i, i * 10, i * 10 + 5, s, None, e) for i, (s, e) in enumerate([("a", "sad"), ("a", None), ("a", None), ("b", None), ("a", None), ("a", "neutral")])]
    got = {r.id: r.filled for r in timeline.fill_emotions(spark.createDataFrame(rows, CUE)).collect()}
    assert got == {0: "sad", 1: "sad", 2: "sad", 3: "neutral", 4: "sad", 5: "neutral"}


def test_end_extension(spark):
    rows = [cue(1, 0, 100), cue(2, 1000, 1500), cue(3, 1600, 1700)]
    assert [r.new_end for r in timeline.extend_ends(spark.createDataFrame(rows, CUE)).orderBy("id").collect()] == [800, 1500, 2800]


def test_fit(spark):
    cases = [(100, 100, 0), (130, 100, 0), (131, 100, 0), (150, 100, 60), (200, 100, 60), (300, 100, 60)]
    df = spark.createDataFrame(cases, "t long, b long, e long").select(rates.fit(F.col("t"), F.col("b"), F.col("e")).alias("f")).select("f.*")
    assert [(r.status, round(r.rate, 3), r.final_ms) for r in df.collect()] == [("success", 1.0, 100), ("rate_adjusted", 1.3, 100), ("failed", 1.31, 131), ("extended", 1.0, 160), ("extended", 1.25, 160), ("failed", 3.0, 300)]


def test_timecodes(spark):
    df = spark.createDataFrame([(0,), (1000,), (1001,), (3_600_000,)], "ms long")
    got = df.select(text.timecode(F.col("ms")), text.timecode(F.col("ms"), legacy=True), text.short_timecode(F.col("ms"))).collect()
    assert [tuple(r) for r in got] == [("00:00:00,000", "00:00:00,000", "00:00.000"), ("00:00:01,000", "00:00:01,000", "00:01.000"), ("00:00:01,001", "00:00:01,000", "00:01.001"), ("01:00:00,000", "01:00:00,000", "60:00.000")]


def test_text_rules(spark):
    one = spark.createDataFrame([("　你好， world，。",)], "t string")
    t = F.col("t")
    r = one.select(text.normalize(t), text.strip_trailing_marks(text.normalize(t)), text.count_class(t, "一-鿿"), text.only_marks(F.lit(" ，。!")), text.json_object(F.lit("x{a}y}z"))).first()
    assert tuple(r) == ("你好， world，。", "你好， world", 2, True, "{a}y}")
    r = one.select(text.strip_trailing_marks(F.lit("，。")), text.clean_output(F.lit("<sep>a  <<NAME_1:b>> c<SLANG:x>"))).first()
    assert tuple(r) == (None, "a c")


def test_parsing(spark):
    one = spark.range(1)
    r = one.select(parse.numbered_output(F.lit("[2] b\n[1] a\n[2] c\n[7] x"), 3), parse.numbered_output(F.lit("p\n\nq"), 3), parse.simple_output(F.lit("1. x\n2. y\nz"), 2)).first()
    assert tuple(map(list, r)) == (["a", "c", ""], ["p", "q", ""], ["x", "y"])
    r = one.select(parse.split_at_ratio(F.lit("ab,cd,ef"), F.lit(0.5)), parse.restore_names(F.lit("<<NAME_0:x>> and <<NAME_5>>"), F.array(F.lit("Li"))), parse.atempo(F.lit(5.0)), parse.atempo(F.lit(0.2))).first()
    assert list(r[0]) == ["ab,cd", "ef"]
    assert r[1] == "Li and <<NAME_5>>"
    assert list(r[2]) == [2.0, 2.0, 1.25] and list(r[3]) == [0.5, 0.5, 0.8]
    assert "A'b" in parse.name_variants("A", "B")
    r = one.select(parse.numbered_output(F.lit("[1] a [2] b\nmore [3]  c"), 4), parse.numbered_output(F.lit("1. a\n\n[2] - \n3) c"), 3), parse.split_at_ratio(F.lit(",ab"), F.lit(0.1)), parse.split_at_ratio(F.lit("ab,c,"), F.lit(0.7)), parse.split_at_ratio(F.lit("abc"), F.lit(0.0)), parse.split_at_ratio(F.lit("abc"), F.lit(0.5))).first()
    assert tuple(map(list, r)) == (["a", "b\nmore", "c", ""], ["", "- \n3) c", ""], ["", "ab"], ["ab,c", ""], ["a", "bc"], ["ab", "c"])


def test_merged_texts(spark):
    cases = [("a", "b", "a，b"), ("", "b", "b"), ("a、", "b", "a、b"), ("a;", "b", "a;b"), ("a\n", "b", "a\n，b")]
    df = spark.createDataFrame(cases, "a string, b string, t string")
    assert all(r.t == r.got for r in df.select("t", text.merge_texts(F.col("a"), F.col("b")).alias("got")).collect())
    assert spark.range(1).select(text.clean_output(F.lit("a<sep>b <SLANG:> c"))).first()[0] == "a b <SLANG:> c"


def test_speech_tiers(spark):
    cases = [(100, 100, False, 0, 0, "padding"), (120, 100, False, 0, 120, "overflow_allowed"), (125, 100, False, 0, 0, "safe"), (160, 100, True, 0, 0, "moderate"), (200, 100, True, 0, 0, "aggressive"), (200, 100, False, 0, 0, "hard_cut"), (0, 0, False, 0, 0, "padding")]
    df = spark.createDataFrame(cases, "s int, w int, a boolean, at int, next int, t string")
    assert all(r.t == r.got for r in df.select("t", rates.alignment_tier(F.col("s"), F.col("w"), F.col("a"), F.col("at"), F.col("next")).alias("got")).collect())
    assert spark.range(1).select(rates.speed(F.lit(5), F.lit(0)), rates.speed(F.lit(6), F.lit(5))).first()[:] == (1.0, 1.2)


TASK = "id long, episode_id long, type string, status string"


def resumed(spark, tasks, **more):
    return {r.episode_id: (r.leads_to, r.creates) for r in workflow.resume(spark.createDataFrame(tasks, TASK), **more).collect()}


def test_resume(spark):
    tasks = [
        (1, 1, "extract", "succeeded"), (2, 1, "asr", "running"),  # waits
        (3, 2, "extract", "succeeded"), (4, 2, "asr", "failed"),  # again
        (5, 3, "parse", "succeeded"),  # a gate that isn't there
        (6, 4, "parse", "succeeded"), (7, 4, "source_review", "succeeded"),  # passed
        (8, 5, "burn", "succeeded"),  # done
        (9, 6, "source_review", "failed"),  # nothing succeeded in the range
        (10, 7, "parse", "succeeded"), (11, 7, "source_review", "pending"), (12, 7, "source_review", "skipped"),
        (13, 8, "parse", "succeeded"), (14, 8, "source_review", "pending"), (15, 8, "mix", "cancelled"),
    ]
    got = resumed(spark, tasks)
    assert got == {1: ("wait", False), 2: ("asr", True), 3: ("source_review", True), 4: ("translate", True), 5: ("done", False), 6: ("extract", True), 7: ("source_review", True), 8: ("source_review", False)}
    assert resumed(spark, tasks, last="parse")[4] == ("done", False) and set(resumed(spark, tasks, first="tts").values()) == {("tts", True)}
    with pytest.raises(ValueError):
        workflow.active_range("tts", "parse")
    with pytest.raises(ValueError):
        workflow.active_range("none")


def test_phases_and_gates_of_episodes_without_tasks(spark):
    e = spark.createDataFrame([(1, "succeeded"), (2, "running"), (3, "succeeded")], "id long, status string")
    t = spark.createDataFrame([(1, 3, "parse", "succeeded"), (2, 1, "source_review", "pending")], TASK)
    got = {}
    for r in workflow.phases(e, t).collect():
        got.setdefault(r.episode_id, {})[r.type] = r.status
    assert set(got[1].values()) == {"succeeded"} and set(got[2].values()) == {"pending"} and got[3] == {**dict.fromkeys(workflow.PHASES, "pending"), "parse": "succeeded"}
    assert {r.episode_id: (r.source_review, r.translation_review) for r in workflow.gate_status(e, t).collect()} == {1: ("passed", "passed"), 2: ("pending", "pending"), 3: ("awaiting", "pending")}


def test_passed_gates(spark):
    tasks = [(1, 1, "source_review", "pending"), (2, 2, "parse", "succeeded"), (3, 3, "source_review", "succeeded"), (4, 4, "source_review", "pending"), (5, 4, "tts", "running")]
    got = sorted((r.episode_id, r.id or 0, r.type, r.status) for r in workflow.pass_gate(spark.createDataFrame(tasks, TASK), "source_review").collect())
    assert got == [(1, 1, "source_review", "succeeded"), (2, 0, "source_review", "succeeded"), (2, 2, "parse", "succeeded"), (3, 3, "source_review", "succeeded"), (4, 4, "source_review", "pending"), (4, 5, "tts", "running")]


def test_one_restart_an_episode(spark):
    c = spark.createDataFrame([(1, "tts"), (1, "source_review"), (2, "translation_review"), (2, "tts"), (3, None)], "e long, restart string")
    assert {r.e: r.restart for r in snapshots.restarts(c, "e").collect()} == {1: "source_review", 2: "tts", 3: None}


def test_large_glossary_meets_texts_in_blocks(spark, monkeypatch):
    g = spark.createDataFrame([("王", "Wang", None), ("王明", "Wang Ming", None), ("胡", "tile", ["牌"]), ("", "all", None)], "src string, target string, indicators array<string>")
    t = spark.createDataFrame([(1, "见王明"), (2, "胡牌王"), (3, "x"), (4, "")], "id long, text string")
    one = {r.id: r.hits for r in glossary.term_hits(t, g).collect()}
    monkeypatch.setattr(glossary, "BLOCK_BYTES", 9)
    assert {r.id: r.hits for r in glossary.term_hits(t, g).collect()} == one and one[1] == ":all,王:Wang,王明:Wang Ming"


def plain_segments(text, start, end):
    """The rule step by step."""
    import re

    text, dur = text.strip(), end - start
    if not text or dur <= 0:
        return []
    if dur < 1500:
        return [(start, end, text)]
    if re.search(r"[,.?!—;:]", text):
        parts = [p.strip() for p in re.split(r"(?<=[,.?!—;:])", text)]
        parts = [p for p in parts if re.search(r"\w", p)]
    else:
        words = text.split()
        per = max(8, min(12, int(len(words) / max(1, dur / 2000))))
        parts = [" ".join(words[i : i + per]) for i in range(0, len(words), per)]
    parts = parts or [text]
    weights = [len(p.split()) / 2.5 * 1000.0 for p in parts]
    scale, at, out = dur / sum(weights), start, []
    for p, w in zip(parts, weights, strict=True):
        until = min(end, int(at + w * scale))
        out.append([at, until, p])
        at = until
    out[-1][1] = end
    merged = [out[0]]
    for s in out[1:]:
        if s[1] - s[0] < 500:
            merged[-1] = [merged[-1][0], s[1], merged[-1][2].rstrip() + " " + s[2]]
        else:
            merged.append(s)
    if len(merged) > 1 and merged[0][1] - merged[0][0] < 500:
        merged[:2] = [[merged[0][0], merged[1][1], merged[0][2].rstrip() + " " + merged[1][2]]]
    return [tuple(s) for s in merged]


def test_segments_of_every_line_equal_the_plain_rule(spark, sf_dir):
    from cuewright.functions import segments
    from cuewright.sources import adapters as A

    rows = A.lines(spark, sf_dir).select("text", "start_ms", "end_ms", segments.resegment(F.col("text"), F.col("start_ms"), F.col("end_ms")).alias("s")).collect()
    assert len(rows) > 50
    for r in rows:
        assert [tuple(s) for s in r.s] == plain_segments(r.text, r.start_ms, r.end_ms)


def test_recognition_and_subtitles(spark):
    raw = '{"result":{"utterances":[{"start_time":5,"end_time":9,"text":" a  b ","additions":{"speaker":"2","gender":"f"},"words":[{"start_time":5,"end_time":6,"text":" a "},{"text":" "}]},{"start_time":1,"end_time":2,"text":" "}]}}'
    df = spark.createDataFrame([(1, raw)], "episode_id long, raw string")
    assert sorted((r.start_ms, r.text, r.speaker) for r in formats.recognized(df).collect()) == [(1, " ", "0"), (5, " a  b ", "2")]
    r = formats.recognized_strict(df).collect()
    assert [(x.text, x.gender, [tuple(w) for w in x.words]) for x in r] == [("a b", "f", [(5, 6, "a", "2")])]
    bare = spark.createDataFrame([(1, '{"result":{"utterances":[{"text":"x","words":[{"text":"y","start_time":4,"additions":{"speaker":"7"}}]},{"start_time":3,"text":"z"}]}}'), (2, "no"), (3, None)], "episode_id long, raw string")
    assert sorted((x.start_ms, x.end_ms, x.text, x.speaker, [tuple(w) for w in x.words]) for x in formats.recognized_strict(bare).collect()) == [(0, 0, "x", "0", [(4, 4, "y", "7")]), (3, 3, "z", "0", [])]
    v = spark.createDataFrame([('[{"VoiceType":"v","Name":"n","Emotions":[{"Value":"h"},{"Value":""}],"Languages":[{"Language":"en"}]},{"Name":"x"}]',)], "raw string")
    got = formats.voices(v).collect()
    assert [(x.voice_type, x.name, x.gender, [e.value for e in x.emotions], [e.lang for e in x.languages], list(x.categories)) for x in got] == [("v", "n", "", ["h"], ["en"], [])]
    c = spark.createDataFrame([(1, 1, 0, 1000, "la", "sing"), (2, 1, 1000, 2000, " ", "speech"), (3, 1, 2000, 3000, "hi", "speech")], "id long, episode_id long, start_ms long, end_ms long, t string, kind string")
    assert formats.srt_blocks(c, "t").first().srt == "1\n00:00:00,000 --> 00:00:01,000\n♪la♪\n\n2\n00:00:02,000 --> 00:00:03,000\nhi\n"


def test_glossary(spark):
    g = spark.createDataFrame([("胡", "tile", ["牌"]), ("王", "Wang", None)], "src string, target string, indicators array<string>")
    t = spark.createDataFrame([(1, "王 and 胡", "wang"), (2, "胡牌", ""), (3, "x", "")], "id long, text string, out string")
    assert {r.id: r.hits for r in glossary.term_hits(t, g).collect()} == {1: "王:Wang", 2: "胡:tile"}
    assert sorted(tuple(r) for r in glossary.violations(t, g, "text", "out").collect()) == [(2, "胡")]  # 胡 is ambiguous without 牌


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, name string, n long")
    new = spark.createDataFrame([(2, "", None), (3, "c", 7)], "id long, name string, n long")
    got = sorted(tuple(r) for r in snapshots.upsert(old, new, ["id"], {"name": "text", "n": "fill"}).collect())
    assert got == [(1, "a", None), (2, "b", 5), (3, "c", 7)]


def test_reconciled_utterances(spark):
    from cuewright.functions.hashes import source_hash

    c = spark.createDataFrame([cue(1, 0, 100), cue(2, 150, 250), cue(3, 5000, 5100, "b", 7, "sad"), cue(4, 9000, 9100), cue(5, 0, 50, episode=2)], CUE)
    now = c.where("id = 3").select(source_hash(F.array(F.struct("text", "start_ms", "end_ms", "emotion")))).first()[0]
    stored = spark.createDataFrame([(1, 10, "old", "A"), (1, 11, now, "B"), (1, 12, now, "C"), (1, 13, "x", "D"), (2, 14, None, "E")], "episode_id long, uid long, source_hash string, note string")
    links = spark.createDataFrame([(1, 10, 2), (1, 10, 1), (1, 11, 3), (1, 12, 3), (1, 13, 4), (1, 13, 1), (2, 14, 5)], "episode_id long, uid long, cue_id long")
    got = {r.head_id: (r.uid, r.text, r.speaker, r.role_id, r.emotion, r.source_hash, r.note) for r in timeline.reconcile(timeline.merge_cues(c), c, stored, links).collect()}
    # Of two utterances of the same cues the later stays, 13 goes, a hash that isn't the cues' is cleared.
    assert got == {1: (10, "t1t2", "a", None, "neutral", None, "A"), 3: (12, "t3", "b", 7, "sad", now, "C"), 4: (None, "t4", "a", None, "neutral", None, None), 5: (14, "t5", "a", None, "neutral", None, "E")}


def test_role_lists(spark):
    stored = spark.createDataFrame([(1, 1, "a", "v", "lead", "s1"), (2, 1, "b", "v", "extra", "s2"), (3, 1, "默认", "v", "extra", None), (4, 1, "c", "v", "extra", None), (5, 2, "d", "v", "extra", None), (6, 3, "e", "v", "extra", None)], "id long, drama_id long, name string, voice_type string, role_type string, sample string")
    listed = spark.createDataFrame([(1, 0, 1, "a2", "w", "lead"), (1, 1, None, "b", "x", "extra"), (1, 2, 0, "b", "y", "extra"), (1, 3, None, "n", None, "extra"), (1, 4, 6, "zz", "w", "lead")], "drama_id long, position int, id long, name string, voice_type string, role_type string")
    used = spark.createDataFrame([(1, 4), (3, 5), (1, None)], "drama_id long, role_id long")
    got = {(r.id, r.drama_id, r.name, r.voice_type, r.sample) for r in snapshots.set_roles(stored, listed, spark.createDataFrame([(1,), (2,)], "drama_id long"), used).collect()}
    assert got == {(1, 1, "a2", "w", "s1"), (2, 1, "b", "y", "s2"), (3, 1, "默认", "v", None), (4, 1, "c", "v", None), (None, 1, "n", None, None), (6, 3, "e", "v", None)}


def test_requests_paths_and_updates(spark):
    from cuewright.functions import requests

    one = spark.range(1)
    off, no = F.lit(False), F.lit(None)
    faults = lambda *c: list(one.select(requests.request_faults(*c)).first()[0])
    assert faults(off, no.cast("int"), no.cast("string"), off, off, F.lit(1), F.lit("en")) == []
    assert faults(F.lit(True), F.lit(300), F.lit("m"), F.lit(True), F.lit(True), F.lit(2), F.lit("zh-CN")) == []
    assert faults(F.lit(True), F.lit(5001), F.lit("m"), off, F.lit(True), no.cast("int"), F.lit("")) == ["the window isn't within 300 and 5000", "a speaker model needs speakers", "split channels need two"]
    assert one.select(requests.require(F.array().cast("array<string>"), F.lit(3))).first()[0] == 3
    with pytest.raises(Exception, match="broken; twice"):
        one.select(requests.require(F.array(F.lit("broken"), F.lit("twice")), F.col("id"))).collect()
    paths = [requests.artifact_path(F.lit(k), F.lit("/w/5/007")) for k in ("mix.audio", "subs.en_srt", "x.y", "z")]
    assert list(one.select(*paths).first()) == ["/w/5/007/007-mix.wav", "/w/5/007/output/007-en.srt", "/w/5/007/x/y", "/w/5/007/misc/z"]
    updates = [parse.json_update(F.lit(a).cast("string"), F.lit(b).cast("string")) for a, b in (('{"a":{"x":1},"b":[1,2.5]}', '{"c":true,"a":{"y":null}}'), (None, '{"a":1}'), ('{"a":1}', None), ("no", '{"a":"é"}'), ('{"a":1,"a":2,"b":3}', '{"b":4,"b":5}'))]
    assert list(one.select(*updates).first()) == ['{"a":{"y":null},"b":[1,2.5],"c":true}', '{"a":1}', '{"a":1}', '{"a":"é"}', '{"a":2,"b":5}']
    assert [r[0] for r in one.select(F.explode(F.array(*(text.ago(F.lit(t).cast("long"), F.lit(10_000_000_000)) for t in (None, 9_999_999_999, 10_000_000_000 - 59 * 60_000, 0))))).collect()] == ["--", "刚刚", "59分钟前", "3个月前"]


def test_states_without_tasks(spark):
    e = spark.createDataFrame([(1,), (2,)], "id long")
    t = spark.createDataFrame([(1, 1, "asr", "succeeded"), (2, 1, "parse", "pending")], "id long, episode_id long, type string, status string")
    assert {r.id: r.derived for r in workflow.episode_status(e, t).collect()} == {1: "review", 2: "ready"}
    assert {(r.type, r.status) for r in workflow.reset_to(t, "asr").collect()} == {("asr", "pending")}


def test_change_feed_streams_each_change_once(spark, tmp_path):
    schema = "id long, status string"
    for rows in ([(1, "running"), (2, "pending")], [(1, "running"), (1, "succeeded"), (2, "failed")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    feed.consume(feed.changes(feed.task_stream(spark, f"{tmp_path}/in", schema)), lambda df, _: seen.extend(tuple(r) for r in df.collect()), f"{tmp_path}/at")
    assert sorted(seen) == [(1, "running"), (1, "succeeded"), (2, "failed")]


def test_segments(spark):
    from cuewright.functions import segments

    one = spark.range(1)
    at = lambda c: [(s.start_ms, s.end_ms, s.text) for s in one.select(c).first()[0]]
    axis = segments.time_axis(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)), F.lit(0), F.lit(1000))
    assert at(axis) == [(0, 333, "a"), (333, 666, "b"), (666, 1000, "c")]
    assert at(segments.resegment(F.lit("one two, three four. five"), F.lit(0), F.lit(5000))) == [(0, 2000, "one two,"), (2000, 4000, "three four."), (4000, 5000, "five")]
    assert at(segments.resegment(F.lit(" a, b c d e f g h i j, k "), F.lit(0), F.lit(1499))) == [(0, 1499, "a, b c d e f g h i j, k")]
    assert at(segments.resegment(F.lit("a b c d e f g h i j k l m n o p q r s t"), F.lit(0), F.lit(4000))) == [(0, 2000, "a b c d e f g h i j"), (2000, 4000, "k l m n o p q r s t")]
    assert at(segments.resegment(F.lit("?! ..."), F.lit(0), F.lit(4000))) == [(0, 4000, "?! ...")] and at(segments.resegment(F.lit("x"), F.lit(5), F.lit(5))) == []
    assert at(segments.resegment(F.lit(" "), F.lit(0), F.lit(10))) == []
    assert one.select(segments.sentences(F.lit("你好！好吗？x"))).first()[0] == ["你好！", "好吗？", "x"]
    scores = one.select(segments.sentence_scores(F.array(F.lit("a，b。"), F.lit("…！"), F.lit("c?"), F.lit("d")), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.25)))).first()[0]
    assert [tuple(s) for s in scores] == [("a，b。", 0.5), ("c?", 0.25)]
    marks = F.array(*(F.struct(F.lit(c).alias("text"), F.lit(i * 0.5).alias("start"), F.lit(i * 0.5 + 0.5).alias("end")) for i, c in enumerate("abcab")))
    assert at(segments.align_sentences(F.array(F.lit("abc"), F.lit("x"), F.lit("ab")), marks)) == [(0, 1500, "abc"), (1500, 2500, "ab")]  # x isn't there


def test_names_and_hashes(spark):
    one = spark.range(1)
    g = one.select(parse.guard_names(F.lit("王明 and 王 and 王明"), F.array(F.lit("王"), F.lit("王明"))).alias("g")).first().g
    assert (g.masked, list(g.names)) == ("<<NAME_0>> and <<NAME_1>> and <<NAME_0>>", ["王明", "王"])
    assert one.select(parse.restore_names(F.lit(g.masked), F.array(*(F.lit(n) for n in g.names)))).first()[0] == "王明 and 王 and 王明"
    r = one.select(parse.canonical_hash(F.lit('{"b":1,"a":null}')), parse.canonical_hash(F.lit('{ "b" : 1 }')), parse.canonical_hash(F.lit("no"))).first()
    assert r[0] == r[1] and r[2] is None


def test_ranges_and_times(spark):
    headers = ["bytes=0-99", "bytes=10-", "bytes=-5", "bytes=-500", "bytes = 1-2, 5-6", "items=0-1", "bytes=5-2", "bytes=100-", "bytes=", "x", None, "bytes=1-2-3"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, h string")
    got = {r.i: r.r and tuple(r.r) for r in df.select("i", parse.byte_range(F.col("h"), F.lit(100)).alias("r")).collect()}
    assert [got[i] for i in range(12)] == [(0, 99), (10, 99), (95, 99), (0, 99), (1, 2), None, None, None, None, None, None, (1, 2)]
    one = spark.range(1).select(*(text.iso_utc(F.lit(x).cast("timestamp")) for x in ("2024-01-02 03:04:05", "2024-01-02 03:04:05.000120"))).first()
    assert list(one) == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000120+00:00"]
    blank = spark.range(1).select(text.strip(F.lit("\t\u3000a b\u00a0\n")), text.normalize(F.lit("\na\u3000 b\n")), text.strip_trailing_marks(F.lit("x。\n")), text.strip(F.lit(" \n"))).first()
    assert list(blank) == ["a b", "a b", "x", ""]


def test_lengths_and_speeds(spark):
    one = spark.range(1)
    fit = lambda a, b: tuple(one.select(rates.length_fit(F.lit(a).cast("string"), F.lit(b).cast("string"), F.lit(3)).alias("f")).first().f)
    assert [fit('"abc"', None), fit("abcd", "ab"), fit("abcd", "ab cd"), fit("abcd", None), fit(None, "x")] == [("ok", "abc"), ("compressed", "ab"), ("truncated", "ab"), ("failed", "abcd"), ("failed", "")]
    assert [r[0] for r in one.select(F.explode(F.array(*(rates.speed_bucket(F.lit(x)) for x in (0.1, 0.84, 1.26, 9.0))))).collect()] == [0.7, 0.8, 1.3, 1.3]
    assert one.select(rates.loose_allowed(F.lit(900), F.lit("哥")), rates.loose_allowed(F.lit(800), F.lit("x"))).first()[:] == (True, False)


def test_fuzzy_match_equals_all_pairs(spark):
    texts = ["", None, "a", "b", "ab", "abc", "a long sentence of words", "long sentence of words", "sentence of word", "世界", "你好世界", "aé😀", "é😀", "x" * 40, "x" * 17, "ab"]
    s = [(g, i, t) for g in (1, 2) for i, t in enumerate(texts[g - 1 :])] + [(3, 0, "a"), (3, 1, "")]
    g = [(g, 100 + i, t) for g in (1, 2) for i, t in enumerate(reversed(texts[2 * g - 2 :]))] + [(4, 100, "a")]
    wanted = {}
    for by, i, t in s:
        ids = [j for b, j, u in g if b == by and t is not None and u is not None and (t in u or u in t)]
        if ids:
            wanted[by, i] = min(ids)
    got = glossary.fuzzy_match(spark.createDataFrame(s, "by int, sentence_id int, sentence string"), spark.createDataFrame(g, "by int, segment_id int, segment string"), "by")
    assert {(r.by, r.sentence_id): r.segment_id for r in got.collect()} == wanted


def test_glossary_of_many_blocks(spark, monkeypatch):
    t = spark.createDataFrame([(1, "the aé😀 b"), (2, ""), (3, None), (4, "b")], "id int, text string")
    g = spark.createDataFrame([("aé", "x", None), ("é😀", "y", None), ("b", "z", ["the"]), ("", "all", None)], "src string, target string, indicators array<string>")
    small = {r.id: r.hits for r in glossary.term_hits(t, g).collect()}
    monkeypatch.setattr(glossary, "BLOCK_BYTES", 9)
    assert {r.id: r.hits for r in glossary.term_hits(t, g).collect()} == small == {1: ":all,aé:x,b:z,é😀:y", 2: ":all", 4: ":all"}


def test_orphans_and_their_episodes(spark):
    tasks = spark.createDataFrame([(1, 1, "running"), (2, 1, "pending"), (3, 2, "running"), (4, 3, "failed"), (5, 4, "running"), (6, 4, "succeeded")], "id int, episode_id int, status string")
    e, t = workflow.reset_orphans(spark.createDataFrame([(i, "ready") for i in range(1, 6)], "id int, status string"), tasks, "lost")
    assert {r.id: r.status for r in e.collect()} == {1: "review", 2: "failed", 3: "ready", 4: "ready", 5: "ready"}
    assert {r.id: (r.status, r.error) for r in t.collect()} == {1: ("failed", "lost"), 2: ("pending", None), 3: ("failed", "lost"), 4: ("failed", None), 5: ("failed", "lost"), 6: ("succeeded", None)}


def test_keys_of_synthesis(spark):
    import hashlib
    import json

    from cuewright.functions import hashes

    rows = [(" a \t b\n", '{"rate": 1.0, "pitch": 0, "style": "é"}', 1.5), ('"q" \\ \x0e', "{}", None), ("", "not JSON", 1.0)]
    df = spark.createDataFrame(rows, "text string, prosody string, rate double")
    told = df.select("text", "prosody", "rate", hashes.synthesis_key("e", "v", F.col("text"), F.lit("n"), F.col("prosody"), F.lit("en")).alias("k"), hashes.payload_key("e", "v", F.col("text"), F.lit("n"), {"rate": F.col("rate")}, F.lit("en"), "wav", 24000, 1).alias("p"))
    for r in told.collect():
        text = " ".join(r.text.split())
        prosody = "" if r.prosody == "not JSON" else json.dumps(json.loads(r.prosody), sort_keys=True)
        assert r.k == hashlib.sha256("|".join(["e", "v", text, "n", prosody, "en"]).encode()).hexdigest()[:16]
        payload = {"engine": "e", "engine_ver": "v", "voice": "n", "lang": "en", "format": "wav", "sample_rate": 24000, "channels": 1, "text": text}
        payload["prosody"] = {"rate": 1.0 if r.rate is None else r.rate, "pitch": 0, "style": "general", "role": "", "volume": ""}
        assert r.p == hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def test_terms_overlap_and_repeat(spark):
    """Held against a plain version: terms within terms, equal terms, null parts, texts that repeat."""
    import random

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab王 ") for _ in range(rng.randrange(1, n)))
    g = [(word(5), rng.choice(["X", "a", None, "Ab"]), rng.choice([None, None, [], ["b"], ["王", None], [""]])) for _ in range(40)] + [(None, "n", None)]
    t = [(k % 50, word(14), rng.choice([None, "ab", "XX", ""])) for k in range(60)] + [(99, None, "x"), (98, "", "x")]
    holds = lambda e, x: e[0] is not None and x is not None and e[0] in x and (e[2] is None or any(w is not None and w in x for w in e[2]))
    gd, td = spark.createDataFrame(g, "src string, target string, indicators array<string>"), spark.createDataFrame(t, "id long, text string, out string")
    wanted: dict = {}
    for i, x, _ in t:
        for e in g:
            if holds(e, x):
                wanted.setdefault(i, set()).add(":".join(y for y in e[:2] if y is not None))
    assert {r.id: r.hits for r in glossary.term_hits(td, gd).collect()} == {i: ",".join(sorted(v)) for i, v in wanted.items()}
    bad = sorted((i, e[0]) for i, x, out in t for e in g if holds(e, x) and out is not None and e[1] is not None and e[1].lower() not in out.lower())
    assert sorted(map(tuple, glossary.violations(td, gd, "text", "out").collect())) == bad


def test_texts_are_not_shuffled_by_term(spark, capsys):
    t = spark.createDataFrame([(1, "a text")], "id long, text string")
    glossary.term_hits(t, spark.createDataFrame([("a", "b", None)], "src string, target string, indicators array<string>")).explain("simple")
    plan = capsys.readouterr().out
    below = plan[plan.index("Exchange") :]
    assert "Join" not in plan and "_text" not in plan[: plan.index("MapInArrow")] and "MapInArrow" in below


def test_containment_by_the_rarest_anchor(spark):
    """Long texts that share most of what they say, in groups; blocks of proposals; held against a plain version."""
    import random

    from cuewright.operators import containment

    rng = random.Random(8)
    common = " ".join(rng.choice(["so", "it", "goes", "Ünd", "日本"]) for _ in range(3000))
    texts = [common + f" end {k}" for k in range(30)] + [f"{k}" + common[: 1000 + k] for k in range(10)] + ["end 1", "end 2", "d", "日", common, "goes it so", "x" * 50]
    rows = [(g, t) for g in ("a", "b", None) for t in texts[: 40 if g == "b" else None]] + [("a", None), ("a", "")]
    inner = spark.createDataFrame([(g, t, k) for k, (g, t) in enumerate(rows)], "g string, inner string, n int")
    outer = spark.createDataFrame(rows, "g string, outer string")
    wanted = sorted((g, k) for k, (g, t) in enumerate(rows) if g and t for h, u in rows if h == g and u and t in u)
    for block in (containment.BLOCK, 40):
        got = containment.held(inner, outer, "g", F.col("n"), block)
        assert got.columns == ["g", "inner", "outer", "least"] and sorted((r.g, r.least) for r in got.collect()) == wanted


def test_containment_of_megabyte_texts(spark):
    """A group of long texts: only the sentence's own neighbours meet."""
    from cuewright.operators import containment

    long = spark.range(60).selectExpr("1 AS g", "concat(repeat('all of them say this. ', 45000), 'number ', id, '.') AS outer")
    short = spark.range(60).selectExpr("1 AS g", "concat('say this. number ', id, '.') AS inner", "id")
    got = containment.held(short, long, "g", F.col("id")).select("least", F.expr("right(outer, 12)").alias("at")).collect()
    assert sorted(r.least for r in got) == list(range(60)) and all(r["at"].endswith(f" {r.least}.") for r in got)


def test_segments_of_a_text_of_many_clauses(spark):
    """Parts and their words are made once a text, not again for each part."""
    import time

    from cuewright.functions import segments

    text = " ".join(f"clause {k}, and one that has more words;" if k % 3 else "yes!" for k in range(1000))
    began = time.time()
    got = spark.createDataFrame([(text, 0, 60 * len(text))], "t string, a long, b long").select(segments.resegment(F.col("t"), F.col("a"), F.col("b")).alias("s")).first().s
    assert time.time() - began < 20
    assert [tuple(s) for s in got] == plain_segments(text, 0, 60 * len(text))


def test_marks_of_an_alignment_stay_with_spark(spark, capsys):
    """Python gets the marks' characters as one text, and gives places: no row of it for each mark."""
    from cuewright.functions import segments

    marks = F.expr("transform(split(t, ''), (c, i) -> named_struct('text', c, 'start', i * 0.5, 'end', i * 0.5 + 0.5))")
    out = spark.createDataFrame([("a b! c?",), ("",), (None,)], "t string").select(segments.align_sentences(segments.sentences(F.col("t")), marks).alias("s"))
    assert [r.s and [tuple(s) for s in r.s] for r in out.collect()] == [[(0, 1500, "a b!"), (2500, 3000, "c?")], [], None]
    odd = F.expr("array(named_struct('text', 'ab', 'start', 0.0D, 'end', 0.0D), named_struct('text', 'c', 'start', 1.0D, 'end', 1.0D), named_struct('text', null, 'start', 1.5D, 'end', 2.0D))")
    assert [tuple(s) for s in spark.range(1).select(segments.align_sentences(F.array(F.lit("ab"), F.lit("c")), odd)).first()[0]] == [(1000, 1500, "c")]
    out.explain("simple")
    plan = capsys.readouterr().out
    assert "array_join(" in plan[plan.index("ArrowEvalPython") :]


def test_containment_walks_a_text_once(spark, monkeypatch):
    """Blocks hold whole groups, so that a text isn't walked by the blocks of others."""
    from cuewright.operators import containment

    walked, holding = spark.sparkContext.accumulator(0), containment._holding

    def counting(wanted):
        run = holding(wanted)

        def counted(batches):
            for batch in batches:
                walked.add(batch.num_rows)
                yield from run([batch])

        return counted

    monkeypatch.setattr(containment, "_holding", counting)
    inner = spark.range(200).selectExpr("id AS g", "concat('text ', id) AS inner", "id")
    outer = spark.range(200).selectExpr("id AS g", "concat('a text ', id, '.') AS outer")
    got = containment.held(inner, outer, "g", F.col("id"), 60).select("g", "least").collect()
    assert sorted(map(tuple, got)) == [(k, k) for k in range(200)] and walked.value == 200
