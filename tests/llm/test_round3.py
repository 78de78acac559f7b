"""Operators 11 to 13 against the library, SQL and plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuewright.llm import divergence, pieces, registry, search

DOCS = "doc_id long, text string, lang string, source string, extra string, ids string"
WILD = ["", " ", "   ", "\n", "a" * 700, " " * 300 + "x", "ab" * 400, "日本語のテキスト" * 60, "▁a ▁▁b", "a\x00b", "<s></s><unk><0x0A>", "😀𝒳‍क्षि", "ﬁ İ ß", "x\ty\r\nz", None]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


@pytest.fixture(scope="module")
def model():
    return pieces.Encoder()


def encoded(model, texts):
    ids, bounds = model.ids([t.encode() for t in texts])
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], model.decoded(ids, bounds)


def test_ids_are_those_of_the_library(library, model):
    rng = random.Random(5)
    letters, words = "  abeéñ▁\n.,()'\t日本\x00😀the  ing", ["the ", "<s>", "    ", "self.", "http://", "kshi क्षि", "́", "\U000e0041"]
    texts = [t for t in WILD if t is not None] + ["".join(rng.choice(letters) if rng.random() < 0.8 else rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(3000)]
    ids, texts_back = encoded(model, texts)
    assert ids == [library.encode(t) for t in texts]
    assert texts_back == [library.decode(i) for i in ids]


def test_text_without_a_place_to_cut_is_walked_whole(library, model):
    rng = random.Random(7)
    for text in ("".join(rng.choice("日本語中文字あいうえお") for _ in range(20_000)), "".join(rng.choice("abcde") for _ in range(50_000))):
        assert encoded(model, [text])[0] == [library.encode(text)]


def test_backtracking_by_itself(model):
    """Each row of pieces is one that merging doesn't cross, and a longest-first walk alone isn't."""
    text = pieces.SPACE + "unbelievablenesses"
    got = model._walk(text)
    assert "".join(model.texts[i] for i in got) == text and all(model._merge(model.texts[a], model.texts[b]) for a, b in zip(got, got[1:], strict=False))
    greedy, at = [], 0
    while at < len(text):
        n = next(n for n in range(16, 0, -1) if text[at : at + n] in model.number)
        greedy.append(model.number[text[at : at + n]])
        at += len(model.texts[greedy[-1]])
    assert got != greedy


def test_the_table_of_words_may_be_overrun(library, model, monkeypatch):
    small = pieces.Encoder()
    monkeypatch.setattr(pieces, "SLOTS", 4)
    monkeypatch.setattr(pieces, "MAX_PAIRS", 8)
    texts = [f"w{k} word{k % 7} and more" for k in range(200)]
    for _ in range(2):
        assert encoded(small, texts)[0] == [library.encode(t) for t in texts]


def test_decoding_of_any_ids(library, model):
    rng = random.Random(3)
    rows = [[], [3 + 0xE6], [3 + 0xE6, 3 + 0x97, 3 + 0xA5], [1, 2, 0], [28705], [28705, 28705, 264]] + [[rng.randrange(259, 32000) for _ in range(rng.randrange(9))] for _ in range(300)]
    bounds = np.cumsum([0, *map(len, rows)])
    got = model.decoded(np.array([i for r in rows for i in r], dtype=np.int32), bounds)
    valid = [k for k, r in enumerate(rows) if r != [3 + 0xE6] and r != [1, 2, 0]]
    assert [got[k] for k in valid] == [library.decode(rows[k]) for k in valid]


def test_encode_and_decode_keep_other_columns(spark, library):
    rows = [(k, t, "en", "s", "e", "clash") for k, t in enumerate([*WILD, "twice", "twice"])]
    df = spark.createDataFrame(rows, DOCS)
    ids = pieces.encode(df)
    assert ids.columns == ["doc_id", "text", "lang", "source", "extra", "ids"]
    got = {r.doc_id: (r.ids, r.extra, r.back) for r in pieces.decode(ids, text_col="back").collect()}
    assert got == {r[0]: (library.encode(r[1] or ""), "e", library.decode(library.encode(r[1] or ""))) for r in rows}
    assert pieces.decode(pieces.encode(df.limit(0))).count() == 0


def test_op11_over_its_table(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = {}
    for k, t in docs.items():
        ids = library.encode(t)
        wanted[k] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.queries()["op11_sentencepiece"](spark, sf_dir).collect()}
    assert got == wanted


def plain_search(docs, items, top=10):
    words = [(d, Counter(search.terms((t or "").encode())), len(search.terms((t or "").encode()))) for d, t in docs]
    words = [w for w in words if w[2]]
    n, total = len(words), sum(w[2] for w in words)
    out = []
    for item, text in items:
        found = []
        for d, c, size in words:
            m = 25 + 75 * size * n // total
            score = 0
            for w in search.terms((text or "").encode()):
                if c[w]:
                    df = sum(1 for x in words if x[1][w])
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d if d is not None else 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


DATA = [(1, "the cat sat"), (2, "The CAT sat on the mat"), (3, None), (4, ""), (5, "dog"), (6, "cat cat cat"), (7, "the cat sat"), (7, "the cat sat"), (None, "the cat sat"), (8, "naïve café 42"), (9, "..."), (10, "the " * 30000 + "mat")]


@pytest.mark.parametrize("block_terms", [1 << 20, 3])
@pytest.mark.parametrize("window", [2048, 8])
def test_search_against_a_plain_version(spark, monkeypatch, block_terms, window):
    items = [(1, "cat CAT dog"), (2, "naïve"), (3, None), (4, "zebra"), (5, "the the mat"), (6, "42 café")]
    docs = spark.createDataFrame([(*r, "x") for r in DATA], "doc_id long, text string, item_id string").repartition(3)
    got = search.search(docs, spark.createDataFrame(items, "item_id long, text string"), top=4, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(DATA, items, 4)


def test_windows_are_closed_and_ids_may_be_texts(spark):
    rng = random.Random(2)
    docs = [(f"d{k:05}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))) for k in range(5000)]
    got = search.search(spark.createDataFrame(docs, "doc_id string, text string").coalesce(1), spark.createDataFrame([("q", "a b b c")], "item_id string, text string"), top=7)
    words = [(d, Counter(t.encode().split()), len(t.split())) for d, t in docs]
    n, total = len(words), sum(w[2] for w in words)
    df = Counter(x for w in words for x in w[1])
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) for x in df}
    score = lambda c, size: sum(weight[x] * (10**9 * c[x] // (1000 * c[x] + 8 * (25 + 75 * size * n // total))) for x in (b"a", b"b", b"b", b"c") if c[x])
    best = sorted((-score(c, s), d) for d, c, s in words)[:7]
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [("q", k + 1, d, -s) for k, (s, d) in enumerate(best)]


def test_shares_in_whole_numbers_of_any_size():
    sizes, place, tf = np.array([10**9, 5]), np.array([0, 1], dtype=np.int32), np.array([7, 3])
    n, total = 10**12, 10**14
    assert search.shares(sizes, place, tf, n, total).tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * s * n // total)) for s, t in ((10**9, 7), (5, 3))]


def test_empty_searches(spark):
    docs, items = spark.createDataFrame(DATA, "doc_id long, text string"), spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.limit(0), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_source_divergence"])
def test_query_equals_its_sql(spark, sf_dir, same, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def plain_audit(rows, min_docs, top):
    docs = defaultdict(lambda: defaultdict(set))
    counts, groups = defaultdict(Counter), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in divergence.terms((text or "").encode()):
            docs[lang][w.decode()].add(k)
            counts[lang, source][w.decode()] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = {w for w, d in docs[lang].items() if len(d) >= min_docs}
        sources = sorted(s for g, s in groups if g == lang)

        def shares(c, kept=kept):
            n, v = sum(c[w] for w in kept), len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * v) for w in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            term = sorted((q[w] - p[s][w], w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, of in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(of)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [divergence.BLOCK_BYTES, 16])
def test_audit_against_a_plain_version(spark, monkeypatch, block_bytes):
    rng = random.Random(11)
    words = ["a", "b", "aa", "ab", "Ça", "été", "ß", "x", "ыы", "rare"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(12))) + rng.choice([".", "!1x", ""]), rng.choice(["en", "fr", None, "xx"]), rng.choice(["s1", "s2", "S", None, "é"])) for _ in range(150)]
    rows += [(None, "en", "s9"), ("", None, None), ("only here", "de", "one"), ("a a a", "en", "s1"), ("a a a", "en", "s1")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "text string, lang string, source string, term string, number int").repartition(4)
    got = divergence.audit(df, min_docs=4, top=3, block_bytes=block_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 4, 3)


def test_audit_in_tiles_of_sources(spark):
    """More sources than a tile holds, most of them without most terms."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(["a", "b", "c"]) for _ in range(3)), "en", f"s{k % 700:03}") for k in range(1400)]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=30, top=3)
    wanted = {r[:5] for r in plain_audit(rows, 30, 3)}
    assert {tuple(r)[:5] for r in got.collect()} == wanted


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
