"""The stages of the corpus pipeline, and all of it, against brute force on a small folder with odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tercet.llm import bpe, near_duplicates, quality, suffix_dedup
from tercet.llm.common import utf8
from tercet.llm.queries import CUT, held_out, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base, bench = prose(60), [word() for _ in range(90)], prose(14)
    near = []
    for k in range(6):
        w = list(base)
        w[5 * k] = "zz"
        near.append(" ".join(w))
    texts = [prose(rng.randint(5, 80)) for _ in range(20)]
    texts += [*near, near[0], prose(30) + " " + passage, passage + " " + prose(40) + " é", prose(20) + " " + bench + " " + prose(9), "é " * 40 + passage, "", None, "one", "one", "one two"]
    ids = list(range(len(texts)))
    ids[21], ids[23], ids[24], ids[5] = None, 3, 28, 4  # a near copy without an id, two with ids of other texts, an id that repeats
    out = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return [*out, out[7], out[7]], bench


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, bench = rows
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(r[0] for r in docs if r[0] is not None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", bench), ("b2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def good(spark, docs, path):
    """Rows by walking every tree for every row."""
    frame = spark.createDataFrame(docs, SCHEMA)
    t = quality.train(frame, spark.read.parquet(f"{path}/labels.parquet").where(~held_out(4, 2)))
    x = quality.statistics(*utf8(pa.array([r[1] for r in docs], pa.string())))

    def walk(row, node):
        c = int(t.column[node])
        return float(t.value[node]) if c < 0 else walk(row, int(t.left[node]) + int(row[c] > t.threshold[node]))

    z = [t.base + sum(walk(r, int(k)) for k in t.roots) for r in x]
    return [r for r, v in zip(docs, z, strict=True) if 1 / (1 + np.exp(-v)) >= CUT]


def one_of_each(docs):
    """Every pair of sets compared; of each group the row of the smallest id, ids that are missing last."""
    words = [re.findall(r"[^ \t-\r]+", (r[1] or "").lower()) for r in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(docs)))
    for _ in docs:
        for a in range(len(docs)):
            for b in range(len(docs)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    kept = []
    for g in set(group):
        own = [docs[k] for k in range(len(docs)) if group[k] == g]
        kept.append(min(own, key=lambda r: (r[0] is None, r[0] or 0)) if sets[g] else own[0])
    return kept


def without_repeats(docs):
    data, seen = [(r[1] or "").encode() for r in docs], {}
    for b in data:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    out = []
    for r, b in zip(docs, data, strict=True):
        gone = {j for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1 for j in range(i, i + 200)}
        text = bytes(x for j, x in enumerate(b) if j not in gone).decode("utf-8", "ignore")
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def clean(docs, bench):
    words = lambda t: re.findall(r"[^\x00-/:-`{-\x7f]+", (t or "").lower())
    item = words(bench)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    return [r for r in docs if not any(tuple(words(r[1])[i : i + 10]) in windows for i in range(len(words(r[1]))))]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, rows, folder):
    docs, bench = rows
    frame = spark.createDataFrame(docs, SCHEMA).withColumn("row", F.lit("x"))
    assert collected(corpus_pipeline.keep_good(spark, frame, folder)) == sorted(good(spark, docs, folder), key=str)
    got = collected(corpus_pipeline.keep_one_of_each(spark, frame, folder))
    want = one_of_each(docs)
    # texts with words: the very rows; of the others each stays
    assert [r for r in got if (r[1] or "").strip()] == sorted((r for r in want if (r[1] or "").strip()), key=str)
    assert sum(not (r[1] or "").strip() for r in got) == sum(not (r[1] or "").strip() for r in docs)
    assert collected(corpus_pipeline.cut_repeats(spark, frame, folder)) == sorted(without_repeats(docs), key=str)
    assert collected(corpus_pipeline.drop_contaminated(spark, frame, folder)) == sorted(clean(docs, bench), key=str)


def tokens(docs):
    import public_tokenizers
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(tokenizer_path()).ranks, special_tokens={})
    ids = [np.array(coder.encode_ordinary(r[1] or ""), "<u4").tobytes() for r in docs]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return sorted((str(r[0]), len(i) // 4, sha(i), sha((r[1] or "").encode())) for r, i in zip(docs, ids, strict=True))


def test_encoding(spark, rows, folder):
    pytest.importorskip("tiktoken")
    got = corpus_pipeline.encode(spark, spark.createDataFrame(rows[0], SCHEMA), folder).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == tokens(rows[0])


def test_run(spark, rows, folder):
    docs, bench = rows
    want = clean(without_repeats(one_of_each(good(spark, docs, folder))), bench)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == tokens(want)


def test_empty_table(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_blocks_of_large_buckets(spark, monkeypatch):
    """Buckets far beyond a block, one lone root among many members, against every pair."""
    monkeypatch.setattr(near_duplicates, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(near_duplicates, "PAIRS", 50)
    monkeypatch.setattr(near_duplicates, "FAN", 4)
    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    docs = []
    for k in range(70):
        w = list(base)
        for j in range(k % 9):
            w[(7 * k + 13 * j) % 120] = f"e{k}x{j}"
        docs.append((k, " ".join(w[: 120 - (k % 5) * 5])))
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t in docs]
    group = list(range(70))
    for _ in range(70):
        for a in range(70):
            for b in range(70):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = near_duplicates.link(spark.createDataFrame(docs, "doc_id long, text string"), n=2).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(group)) and len(set(group)) > 1


def test_grams_with_many_stretches(spark, monkeypatch):
    """The way for grams of very many unequal stretches gives what sorting gives."""
    rng = random.Random(3)
    common = "".join(rng.choice("abc") for _ in range(180))
    docs = [(k, "".join(rng.choice("xyz") for _ in range(90)) + common + str(k % 7) * 40 + "".join(rng.choice("uvw") for _ in range(60))) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = collected(suffix_dedup.digests(frame))
    monkeypatch.setattr(suffix_dedup, "MOST_STRETCHES", 2)
    assert collected(suffix_dedup.digests(frame)) == want and any(r[2] for r in want)
