"""The filter audit against a simulation of every order, on nulls, ties, repeated rows, long texts and clashing columns."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tercet.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, joint string, part string, good string, toxic int, A int, `__id` string"
LABELS = "doc_id long, quality int, toxic int, source string"


def fails(text: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    said = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return {k for k, v in said.items() if v}


def simulated(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    """Every order is applied document by document."""
    rows = [(i, t or "", p or "") for i, t, p in docs]
    first: dict[str, int] = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    told = [(i, p, fails(t) | ({"E"} if i is not None and i > first[t] else set())) for i, t, p in rows]
    out = []
    for part in {p for _, p, _ in told}:
        own = [(i, f) for i, p, f in told if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                removed_by[name] += len(gone)
                redundant = sum(name in f for _, f in own) - len(gone)
                only = sum(f == {name} for _, f in own)
                lines.append([part, "".join(order), step, len(left), len(gone), redundant, only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name])
        out += [(*x[:-1], removed_by[x[-1]]) for x in lines]
    return set(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = [None, "", " \t", "é" * 9, "ABC", "a $ b", "  word word", "w " * 50_000, " ".join(f"W{k}" for k in range(120))]
    texts += [" ".join(rng.choice(("up", "DOWN", "left", "50%", f"n{k}", f"m{rng.random()}")) for _ in range(rng.randint(0, 300))) for k in range(20)]
    docs = [(k, t, rng.choice(("en", "fr", None, ""))) for k, t in enumerate(texts)]
    docs += [(k + 100, t, "en") for k, t in enumerate(texts) if k % 3 == 0] + [docs[5], docs[12], (None, "", "en"), (None, "up up", "fr"), (12, "another text of id 12", "fr")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(0, 110, 2)] + [(4, 1, 1), (None, 1, 1)]
    return docs, labels


def test_audit_against_simulation(spark, corpus):
    docs, labels = corpus
    frame = spark.createDataFrame([(i, t, p, "x", "y", "z", 7, 8, "w") for i, t, p in docs], SCHEMA).repartition(3)
    marks = spark.createDataFrame([(*x, "s") for x in labels], LABELS)
    got = filter_audit.audit(frame, marks)
    assert {tuple(r) for r in got.drop("filter").collect()} == simulated(docs, labels)
    assert got.where(F.substring("filter_order", F.col("step"), F.lit(1)) != F.col("filter")).count() == 0
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    none = filter_audit.audit(frame, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


def test_interactions(spark):
    """Dividends add up to the removed documents, exact counts to all; other numbers of filters and other conditions work too."""
    rows = spark.createDataFrame([("p", k & 1, k >> 1 & 1, k >> 2 & 1, 1, 0) for k in (0, 1, 1, 3, 5, 7, 6)] + [("q", 1, 1, 1, 0, 1)], "part string, x int, y int, z int, good int, toxic int")
    joint = filter_audit.joint_failures(rows, "xyz")
    got = filter_audit.interactions(joint, "xyz").collect()
    p = {r.subset: r for r in got if r.part == "p"}
    assert len(got) == 16 and p[""].n_joint == 7 and p[""].n_exactly == 1 and p["xyz"].n_survivors == 1
    assert p["x"].n_exactly == 2 and p["xy"].n_joint == 2 and p["xy"].dividend == -2 and p["xyz"].dividend == 1
    assert sum(r.dividend for r in p.values()) == 6 and sum(r.n_exactly for r in p.values()) == 7
    last = filter_audit.all_orders(joint, "xyz").where("part = 'p' AND step = 3")
    assert last.agg(F.sum("kept")).first()[0] == 6
    shares = {r["filter"]: r.shapley for r in filter_audit.all_orders(joint, "xyz").where("part = 'p'").select("filter", "shapley").distinct().collect()}
    assert sum(shares.values()) == 6 * 6  # all orders remove the same documents
    with pytest.raises(ValueError, match="filters"):
        filter_audit.joint_failures(rows, "abcdefg")
    own = spark.createDataFrame([(1, "abc", "en"), (2, "abcd", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flags = filter_audit.failures(own, marks, filters={"L": F.length("text") > 3}, repeats="R")
    assert sorted((r.L, r.R) for r in flags.collect()) == [(0, 0), (0, 0), (1, 0)]
