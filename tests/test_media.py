"""Names and paths of media files, checksums and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.functions import files
from cuewright.sources import formats


def _map(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_names_and_paths(spark):
    assert _map(spark, ["007", "第012集", "12集", "x1", "", None, "9" * 30, "0", "1\n"], files.episode_number)[:8] == [7, 12, None, None, None, None, None, 0]
    assert _map(spark, ["3-5", "5-3", "4-4", "x", "3-", "", None], files.episodes_of) == [["3", "4", "5"], [], ["4"], ["x"], ["3-"], [""], None]
    assert _map(spark, ["a.JSON", "a/.srt", "a.b/c", "d/", "x.mp3", "x.mov", "", None, "a.wav/b.srt"], files.file_kind) == ["json", "bin", "bin", "dir", "mp3", "bin", "bin", None, "srt"]
    original = lambda p: files.video_file(p, F.lit("d"), F.lit(3))
    assert _map(spark, ["/a.mp4", "/dub/a.mp4", "/x/output/a", "output/a", "", None], original) == ["/a.mp4", "d/3.mp4", "d/3.mp4", "output/a", "d/3.mp4", "d/3.mp4"]


def test_checksums(spark):
    local = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", ""), ("d", None), ("e", "1")], "key string, sha string")
    remote = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", ""), ("d", None), ("f", "1")], "key string, sha string")
    got = {r.key: r.action for r in formats.sync_actions(local, remote, "key").collect()}
    assert got == {"a": "skip", "b": "upload", "c": "upload", "d": "upload", "e": "upload", "f": "download"}


def test_a_report_comes_back(spark):
    fields = f"episode_id: long, {formats.SEGMENT}, audio_duration_ms: long, segments_dir: string".replace(":", "")
    rows = [(1, 2, 10, 9, 8, 7, 1.5, "failed", "b.wav", "no \"sound\"", 99, "x/"), (1, 1, 10, 9, 8, 7, 1.0, "success", "a.wav", None, 99, "x/")]
    reports = formats.report_json(spark.createDataFrame(rows, fields))
    assert '"error":null' in reports.first()["json"]
    back = [tuple(r) for r in formats.report_rows(reports).orderBy("utt_id").collect()]
    assert back == [(1, 99, "x/", 2, 1, 1, *r[1:10]) for r in sorted(rows)]
    assert formats.report_rows(spark.createDataFrame([(1, "{"), (2, None)], "episode_id long, json string")).count() == 0
