"""The operators on small frames with nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest

from tercet.llm import bpe, decontaminate, html_extract, licenses, near_duplicates, packing, quality, suffix_dedup, toxicity, va_search
from tercet.llm.components import components
from tercet.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, row string, h string, node string, items string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", None, "y", "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    other = " ".join(f"v{rng.randrange(900)}" for _ in range(400))
    texts = [None, "", " ", "a", "b b b", passage, passage, other + " " + passage + " é", "é " * 300, other, other.replace(" ", "  "), other + " tail", "x" * 120_000]
    return docs(spark, [*texts, other], [*range(len(texts)), 9])


def test_suffix_dedup(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    data = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    want = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = gone.cumsum()[:-1] > 0
        want.append((i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.digests(odd).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.digests(odd.limit(0)).count() == 0


def test_near_duplicates(spark, odd):
    got = {(r.doc_id, r.component_id) for r in near_duplicates.link(odd, n=2).collect()}
    words = {r.doc_id: (r.text or "").lower().split() for r in odd.collect()}
    sets = {i: ({tuple(w)} if len(w) == 1 else {(a, b) for a, b in zip(w, w[1:], strict=False)}) if w else set() for i, w in words.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == set(root.items())
    assert near_duplicates.link(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_duplicates.link(odd, percent=70)


def test_near_duplicates_of_a_family(spark):
    """Copies with growing edits: members that a leader and a nearest node miss are still found."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 12):
            w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:], strict=False)} for t in texts]
    root = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_duplicates.link(docs(spark, texts), n=2).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_encoding_and_packing(spark, odd):
    tokens = bpe.encode(odd, tokenizer_path())
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(tokens, tokenizer_path()).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    want = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in tokens.collect() if len(r.ids))
    packed = packing.pack(tokens, length=64, pad=9, end=50256, block_tokens=700).collect()
    parts: dict = {}
    for r in packed:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 9).all()
        for a, b, d, o in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_offsets, strict=False):
            parts.setdefault(d, []).append((o, ids[a:b].tolist()))
    for d, ids in want:
        pieces = sorted(parts[d])
        if d != 9:  # id 9 repeats
            assert [x for _, p in pieces for x in p] == [*ids, 50256]
            assert [o for o, _ in pieces] == np.cumsum([0, *(len(p) for _, p in pieces)])[:-1].tolist()
    assert bpe.digests(odd.limit(0), tokenizer_path()).count() == 0 and packing.pack(tokens.limit(0)).count() == 0


def test_decontaminate(spark, odd):
    bench = spark.createDataFrame([(1, "B b b"), (2, None), (None, "a"), (3, "a"), (4, "--"), (5, "x" * 120_000), (5, "nothing here")], "item_id long, text string")
    for size in (1 << 20, 50_000):  # one pass, and several
        got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.search(odd, bench, block_bytes=size).collect()}
        assert got[4] == (3, ["1"]) and got[3] == (1, ["3"]) and got[12] == (1, ["5"]) and got[0] == (0, []) and got[5] == (0, [])
    assert decontaminate.digests(odd, bench.limit(0)).where("contaminated").count() == 0


def test_licenses(spark):
    texts = [None, "", "Hi.\nLicensed under the Apache License, Version 2.0.", "released under the MIT license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "xLicensed under CC BY-NC 4.0."]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licenses.report(docs(spark, texts)).collect()}
    assert got == {0: ("", ""), 1: ("", ""), 2: ("apache2_notice", "Apache-2.0"), 3: ("mit_notice", "MIT"), 4: ("bsd_grant", ""), 5: ("", "")}


def test_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (None, [0.0] * 6), (220, [1.0, 2.0]), (40, [0.5] * 6)]
    got = va_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=5).collect()
    ok = [(i, np.floor(64 * np.array(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = sorted((q, k + 1, i, int(s)) for a, (q, x) in enumerate(ok) if q % 20 == 0 for k, (s, i) in enumerate(sorted(((float(x @ y), j) for b, (j, y) in enumerate(ok) if b != a and len(y) == len(x)), key=lambda t: (-t[0], t[1]))[:5]))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert va_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), 20).count() == 0


def test_classifiers_on_odd_texts(spark, odd):
    labels = spark.createDataFrame([(9, 1, 0), (8, 0, 1), (5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for model, module in ((quality.train(odd, labels), quality), (toxicity.train(odd, labels), toxicity), (quality.train(odd, labels.limit(0)), quality), (toxicity.train(odd, labels.limit(0)), toxicity)):
        scores = [r.score for r in module.score(odd, model).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)


def test_pages_frame(spark):
    rows = [(1, "http://a.b/1", "<article><p>x</p></article>"), (1, None, None), (2, "nonsense", "<p>y"), (None, "http://a.b/2", "")]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [("1", "", 0), ("1", "x", 1), ("2", "y", 1), ("None", "", 0)]


def test_held_out_accuracy_and_pipeline(spark):
    import corpus_pipeline
    from tercet.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, label in (("op1_toxicity", "toxic"), ("op6_quality_classifier", "quality")):
        rows = [(r.predicted, labels[r.doc_id][label]) for r in QUERIES[name](spark, sf).collect() if r.held_out and r.doc_id in labels]
        assert len(rows) > 50 and sum(p == y for p, y in rows) / len(rows) > 0.9
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs_, sf)
    assert good.columns == docs_.columns and 0.6 * docs_.count() < good.count() < docs_.count()
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "near duplicates"
