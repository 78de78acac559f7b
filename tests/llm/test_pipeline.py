"""Every stage on awkward rows and against a plain version of its decisions."""

import os
import re
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest

from cuewright.llm import packing, secrets
from cuewright.llm.common import saved, scratch, shared_dir

from test_operators import DOCS, awkward, brute_links, check_packing, near_rows, words


def plain_rules(rows):
    """Rows (doc_id, text, lang, source, n_chars) that the rules keep."""

    def failed(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w) < 50 or 100 * len(again) > 50 * len(w)

    bad = [failed(r[1]) for r in rows]
    hosts = {h: [b for r, b in zip(rows, bad, strict=True) if r[3] == h] for h in {r[3] for r in rows if r[3] is not None}}
    total = sum(map(len, hosts.values()))
    mean, rates = sum(map(sum, hosts.values())) / total, [sum(x) / len(x) for x in hosts.values()]
    spread = sum((x - sum(rates) / len(rates)) ** 2 for x in rates) / len(rates)
    strength = max(1, min(total, mean * (1 - mean) / spread - 1)) if spread > 0 else total
    rejected = {h for h, x in hosts.items() if (sum(x) + mean * strength) / (len(x) + strength) > 0.5}
    return [r for r, b in zip(rows, bad, strict=True) if not b and r[3] not in rejected]


def plain_near(rows):
    """One row of each class, that with the least id (null last); rows without words stay."""
    _, root = brute_links(rows)
    least = {}
    for k, (r, at) in enumerate(zip(rows, root, strict=True)):
        at = at if words(r[1]) else -1 - k
        least[at] = min(least.get(at, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return list(least.values())


def plain_clean(rows, item):
    grams = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    return [r for r in rows if not any(tuple(w[i : i + 10]) in grams for w in [words(r[1])] for i in range(len(w) - 9))]


def plain_masked(spark, rows):
    """Spans by the scan (which has SQL of its own), masked here."""
    found = secrets.scan(spark.createDataFrame(rows, DOCS), keep=("doc_id", "text")).select("doc_id", "text", "spans").collect()
    out = []
    for r in found:
        text, at, to = "", 0, 0
        for s in r.spans:
            if s["start"] >= to:
                text += r.text[to if at else 0 : s["start"]] + "[SECRET]"
                at = 1
            to = max(to, s["end"])
        out.append((r.doc_id, None if r.text is None else text + r.text[to:]))
    return out


def ids(rows):
    return sorted((r[0] is None, r[0] or 0) for r in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    near = [(100 + i, t) for i, t in near_rows() if t]
    rows = awkward() + [(i, t, "en", "s9", len(t)) for i, t in near]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, " ".join(near[0][1].split()[5:30]))], "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    kept = stages["quality rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(plain_rules(rows), key=key)
    assert 0 < kept.count() < len(rows)

    one = stages["n-gram Jaccard join"](spark, docs, folder).collect()
    assert ids(one) == ids(plain_near(rows)) and len(one) < len(rows)

    clean = stages["benchmark decontamination"](spark, docs, folder).collect()
    item = words(spark.read.parquet(f"{folder}/benchmark.parquet").first().text)
    assert sorted(map(tuple, clean), key=key) == sorted(plain_clean(rows, item), key=key) and len(clean) < len(rows)

    masked = stages["secret scans"](spark, docs, folder)
    assert masked.columns == docs.columns
    wanted = plain_masked(spark, rows)
    got = masked.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(wanted, key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert sum("[SECRET]" in (t or "") for _, t in wanted) == 1

    packed = stages["best-fit packing"](spark, docs, folder).collect()
    taken, _ = check_packing(packed, [(r[0], r[1]) for r in rows])
    assert taken <= packing.lower_bound(np.array([r.length for r in packed]), packing.CAPACITY) + 1


def test_run(spark, folder):
    """Stage by stage in plain Python, and nothing left behind but the last stage's tables."""
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    item = words(spark.read.parquet(f"{folder}/benchmark.parquet").first().text)
    left = plain_masked(spark, plain_clean(plain_near(plain_rules(rows)), item))
    at = shared_dir(spark).removeprefix("file:")
    were = set(os.listdir(at)) if os.path.isdir(at) else set()
    out = P.run(spark, folder)
    new = {n.rsplit("-", 1)[0] for n in set(os.listdir(at)) - were}
    assert "secret-scans" in new and new <= {"secret-scans", "pieces", "blocks", "elites", "placed"}
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert len(left) > 3
    check_packing(out.collect(), left)


def test_scratch(spark):
    with scratch(spark):
        path = saved(spark.range(3)).inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    with pytest.raises(ValueError), scratch(spark):
        path = saved(spark.range(3)).inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        raise ValueError
    assert not os.path.exists(path)


def test_empty_documents(spark, folder, tmp_path):
    none = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0
