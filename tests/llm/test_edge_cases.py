"""Empty tables, repeated rows, ties, very long texts, several groups and clashing columns, operator by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.llm import decontaminate, html_extract, licenses, packing, quality, toxicity, va_search

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def long_and_repeated(spark):
    rng = random.Random(9)
    words = ["ok", "fine", "idiot", "moron", "the", "sun"]
    long_ = " ".join(rng.choice(words) for _ in range(120_000))
    rows = [(1, long_), (2, "you idiot"), (2, "you idiot"), (3, "you idiot"), (4, None), (5, "")]
    clash = {c: F.lit("x") for c in ("score", "label", "node", "row", "__text", "n_hits", "f0")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores(spark, long_and_repeated, module, label):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 6)], f"doc_id long, {label} int")
    model = module.train(long_and_repeated, labels)
    got = module.score(long_and_repeated, model).select("doc_id", "score").collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 2, 3, 4, 5] and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[2] | by[3]) == 1 and by[4] == by[5]  # equal texts score alike, null as the empty text
    empty = long_and_repeated.limit(0)
    assert module.score(empty, module.train(empty, labels)).count() == 0


def test_toxicity_of_an_exception_that_is_also_an_entry():
    a = toxicity.Model({"trash can": 3.0, "trash": 2.0}, ("trash can",)).automaton()
    assert toxicity.measure("a trash can", a)[3] == 0 and toxicity.measure("what trash", a)[3] == 1


def test_licenses(spark):
    line = "Licensed under the Apache License, Version 2.0."
    long_ = "nothing to see here. " * 40_000 + "\n" + line
    rows = [(1, line), (1, line), (2, long_), (3, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("licences", "sentence_ids", "s")})
    got = sorted((r.doc_id, r.licences) for r in licenses.report(frame).collect())
    assert got == [(1, "Apache-2.0"), (1, "Apache-2.0"), (2, "Apache-2.0"), (3, "")]
    assert licenses.report(frame.limit(0)).count() == 0


def test_search_over_groups(spark, monkeypatch):
    """Many groups and blocks, a crowd of equal vectors, repeated rows and ties, against every pair."""
    monkeypatch.setattr(va_search, "GROUP", 8)
    monkeypatch.setattr(va_search, "BLOCK", 32)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 5))
    v[100:250] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(20, [float(x) for x in v[20]]), (40, [0.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("g", "block", "n", "a", "at", "score", "rank")})
    x = [(i, np.floor(64 * np.array(e))) for i, e in rows]
    want = sorted((q, k + 1, i, int(s)) for a, (q, e) in enumerate(x) if q % 20 == 0 for k, (s, i) in enumerate(sorted(((float(e @ y), j) for b, (j, y) in enumerate(x) if b != a), key=lambda t: (-t[0], t[1]))[:20]))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in va_search.search(frame.repartition(5), every=20).collect())
    assert got == want


def test_passes_of_a_large_benchmark(spark):
    """Blocks of a benchmark in several passes hit what one pass hits, also items and words shared between blocks."""
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefg") + rng.choice("xyz")
    items = [(str(k), " ".join(word() for _ in range(rng.randint(1, 6)))) for k in range(40)]
    docs = spark.createDataFrame([(k % 25, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(30)] + [(99, None)], SCHEMA).withColumns({c: F.lit("x") for c in ("items", "mask", "spans", "item_id")})
    bench = spark.createDataFrame(items, "item_id string, text string")
    one, many = (sorted((tuple(r.asDict().values()) for r in decontaminate.search(docs, bench, window=3, block_bytes=b).select("doc_id", "n_words", "n_hit", "items", "spans").collect()), key=str) for b in (1 << 20, 60))
    assert one == many and any(r[2] for r in one)


def test_pages_of_a_large_host(spark, monkeypatch):
    """More distinct pages than a group holds, copies, pages without a host, clashing columns, no pages at all."""
    monkeypatch.setattr(html_extract, "GROUP", 8)
    page = lambda k: f"<body><div><span>The same line on every page</span></div><div><p>Story {k} {'word ' * (k % 9 + 3)}</p></div></body>"
    rows = [(k, f"https://one.example/{k}", page(k)) for k in range(60)] + [(7, "https://one.example/again", page(7))] + [(100, None, "<p>alone"), (101, "https://one.example/x", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("h", "g", "p", "host", "salt", "common", "text", "n_chars")})
    got = {}
    for r in html_extract.extract(frame.repartition(3)).collect():
        got.setdefault(r.page_id, set()).add((r.text, r.n_chars))
    for k in range(60):
        text = f"Story {k} {'word ' * (k % 9 + 3)}".strip()
        assert got[k] == {(text, len(text))}
    assert got[100] == {("alone", 5)} and got[101] == {("", 0)}
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_ids_too_large_to_pack(spark):
    tokens = spark.createDataFrame([(1, np.array([1, 70_000], "<u4").tobytes())], "doc_id long, ids binary")
    assert packing.pack(tokens, length=4).count() == 1
    with pytest.raises(Exception, match="do not fit"):
        packing.pack(tokens, length=4, dtype="<u2").collect()


@pytest.mark.parametrize("n", [639, 640, 641, 650, 700, 701, 1279, 1280, 1281])
def test_documents_about_as_long_as_a_block(spark, n):
    """Every id comes once, in order, whatever a block holds beside whole rows."""
    rows = [(1, np.arange(n, dtype="<u4").tobytes()), (2, np.arange(5, dtype="<u4").tobytes())]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1), length=64, block_tokens=700).collect()
    got = {1: [], 2: []}
    for r in packed:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        for a, b, d, o in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_offsets, strict=False):
            got[d].append((o, ids[a:b]))
    for d, m in ((1, n), (2, 5)):
        assert [x for _, part in sorted(got[d]) for x in part] == list(range(m))
    with pytest.raises(ValueError, match="block_tokens"):
        packing.pack(spark.createDataFrame(rows, "doc_id long, ids binary"), length=64, block_tokens=63)
