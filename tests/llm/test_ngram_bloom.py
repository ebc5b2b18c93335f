"""The n-gram model against dictionaries of exact counts; both places that a model can be in; the filter by itself."""

import math
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.llm import ngram_bloom
from tercet.llm.common import U64, mix

SCHEMA = "doc_id long, text string, score string, w0 string, `__row` string, n int, bucket int, times int"
CLASH = ("s", "t", "u", 1, 2, 3)


def told(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]  # None: the end


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"Wort{k}é" for k in range(60)] + ["a", "THE", "the", "x" * 300]
    phrase = [rng.choice(vocabulary) for _ in range(25)]
    out = [None, "", " \n ", "a", "A", "the the the the", " ".join(phrase), " ".join(phrase), "\t".join(rng.choice(vocabulary) for _ in range(60_000)), "word" * 300_000 + " a"]
    return out + [" ".join(rng.choice(phrase if rng.random() < 0.6 else [*vocabulary, f"new{rng.randrange(10**6)}"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def test_against_exact_counts(spark, texts):
    """Words exactly; probabilities never below those of exact counts rounded down, and hardly above (false positives)."""
    rows = [*enumerate(texts), (3, "a"), (None, "a the")]
    docs = frame(spark, rows).repartition(3)
    learn = docs.where("doc_id % 3 <> 0")
    model = ngram_bloom.train(learn)
    training = [told(t) for i, t in rows if i is not None and i % 3]
    one, two = Counter(w for x in training for w in x), Counter(g for x in training for g in zip([None, *x[:-1]], x, strict=True))
    total = sum(one.values())
    assert (model.total, model.types) == (total, len(one))
    share = lambda w: (one[w] + 0.1) / (total + 0.1 * (len(one) + 1))
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram_bloom.score(docs, model).collect())
    want = []
    for i, t in rows:
        x, score = told(t), 0.0
        for g in zip([None, *x[:-1]], x, strict=True):
            context = one[g[0]]
            own = float(model.weights[0][context.bit_length()]) if context else 0.0
            down = 2 ** (two[g].bit_length() - 1) if two[g] else 0
            score += math.log10(own * down / max(context, 1) + (1 - own) * share(g[1]))
        want.append((-1 if i is None else i, len(x), sum(w in one for w in x), sum(math.log10(share(w)) for w in x), score))
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-9) and g[4] >= w[4] - 1e-6 * abs(w[4]) for g, w in zip(got, want, strict=True))
    assert sum(g[4] - w[4] for g, w in zip(got, want, strict=True)) < 0.05 * sum(g[1] for g in got)
    unseen = [g for g in got if g[0] >= 10 and g[0] % 3 == 0]
    assert sum(g[4] for g in unseen) > sum(g[3] for g in unseen)  # better than words alone on what was not learned


@pytest.mark.parametrize("order", [1, 2, 3])
def test_both_places_of_a_model(spark, texts, order):
    docs = frame(spark, [*enumerate(texts), (7, None), (None, "a the")]).repartition(4)
    sent = ngram_bloom.train(docs.where("doc_id < 40"), order=order)
    kept = ngram_bloom.train(docs.where("doc_id < 40"), order=order, most_bytes=0)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(sent.weights, kept.weights, strict=True)) and len(sent.weights) == order - 1
    here, apart = (sorted(ngram_bloom.score(docs, m, keep=("doc_id", "score")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).collect()) for m in (sent, kept))
    assert sent.sent and not kept.sent
    assert [r[:4] for r in here] == [r[:4] for r in apart] and np.allclose([r[5] for r in here], [r[5] for r in apart])
    assert all(r[5] <= 0 for r in here) and (order > 1 or np.allclose([r[4] for r in here], [r[5] for r in here]))


def test_a_model_never_passes_through_the_driver(spark, texts, monkeypatch):
    """Tasks read it from the shared folder; where they cannot, it stays in its buckets."""

    def never(*_):
        raise AssertionError("a broadcast goes through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", never)
    docs = frame(spark, list(enumerate(texts)))
    model = ngram_bloom.train(docs)
    assert model.sent and ngram_bloom.score(docs, model).count() == len(texts)
    whole = ngram_bloom.load(model.sent)
    assert [p[0] for p in whole] == [1, 2] and sum(len(p[2]) for p in whole) == model.types and sum(int(p[3].sum()) for p in whole) == model.total
    assert not ngram_bloom.reachable("viewfs://store/none") and not ngram_bloom.reachable("/none/at/all")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_a_model_too_large_to_be_held_is_read_by_buckets(spark, texts, order, monkeypatch):
    """No row is made of a text's n-grams, so that nothing of a size with them is written or shuffled; scores are the same in all three ways."""
    docs = frame(spark, [*enumerate(texts), (7, None), (None, "a the")]).repartition(4)
    by_key = lambda m: sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram_bloom.score(docs, m).collect())
    sent = ngram_bloom.train(docs.where("doc_id < 40"), order=order)
    apart = ngram_bloom.train(docs.where("doc_id < 40"), order=order, most_bytes=0)
    whole, joined = by_key(sent), by_key(replace(apart, folder=""))

    def never(*_):
        raise AssertionError("rows of n-grams")

    monkeypatch.setattr(ngram_bloom, "_apart", never)
    large = ngram_bloom.train(docs.where("doc_id < 40"), order=order, most_bytes=0)
    assert large.folder and not large.sent and all(np.allclose(a, b, atol=1e-9) for a, b in zip(sent.weights, large.weights, strict=True))
    assert by_key(sent) == by_key(replace(sent, sent="", asked=500)) == whole
    assert [r[:3] for r in by_key(large)] == [r[:3] for r in joined] == [r[:3] for r in whole] and np.allclose([r[3:] for r in joined], [r[3:] for r in whole])


def test_buckets_answer_as_a_whole_model_does(spark, texts):
    model = ngram_bloom.train(frame(spark, list(enumerate(texts))))
    whole = ngram_bloom.Loaded(ngram_bloom.load(model.folder), model.buckets)
    words = np.concatenate([p[2] for p in whole.parts if p[0] == 1])
    keys = [np.concatenate([words, mix(np.arange(1000, dtype=U64)), words[:9]]), mix(np.arange(50_000, dtype=U64))]
    counts, levels = ngram_bloom.ask(model.folder, model.buckets, keys)
    assert (counts == whole.count(keys[0])).all() and (counts[: len(words)] > 0).all() and (counts[-9:] == counts[:9]).all()
    assert (levels == whole.level(2, keys[1])).all() and (levels > 0).any()


def test_nothing_learned_and_nothing_scored(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    for most in (1 << 30, 0):
        model = ngram_bloom.train(docs.limit(0), most_bytes=most)
        assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram_bloom.score(docs, model).orderBy("doc_id").collect()] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
        assert ngram_bloom.score(docs.limit(0), ngram_bloom.train(docs, most_bytes=most)).count() == 0


def test_the_filter():
    keys = mix(np.arange(60_000, dtype=U64))
    counts = np.where(np.arange(40_000) % 10 == 0, 1 + np.arange(40_000) % 1000, 1)
    cells = ngram_bloom.build(keys[:40_000], counts)
    level = ngram_bloom.probe(keys, cells, np.array([0, len(cells)]), np.zeros(60_000, int))
    true = ngram_bloom.levels(counts)
    assert (level[:40_000] >= true).all() and (level[:40_000] > true).mean() < 0.05 and (level[40_000:] > 0).mean() < 0.05
    assert ngram_bloom.levels(np.array([0, 1, 2, 3, 4, 7, 8])).tolist() == [0, 1, 2, 2, 3, 3, 4]
    assert len(cells) * 64 <= ngram_bloom.BITS * true.sum() + 64


def test_word_keys_are_of_words_alone():
    """The same word has one key wherever it stands, in long texts and in pieces; other words have others."""
    rng = random.Random(1)
    vocabulary = [f"w{k}" * rng.randint(1, 9) for k in range(5_000)] + ["é" * 700_000, "y" * 600_000]
    said = [rng.choice(vocabulary[:5_000]) for _ in range(150_000)] + vocabulary
    data = np.frombuffer(" ".join(said).encode(), np.uint8)
    keys, first = ngram_bloom.tokens(data, np.array([0, len(data)]))
    by = {}
    for w, k in zip(said, keys[:-1], strict=True):
        by.setdefault(w, set()).add(int(k))
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(set(said)) and first.tolist() == [0, len(said) + 1]
