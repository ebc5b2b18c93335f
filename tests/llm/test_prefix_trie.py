"""The prefix trie against sets of Python tuples: nulls, ties, repeated rows, absent leaders, long conversations, no rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tercet.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string, words string, parent string"


def turn_hash(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows: list[tuple]) -> set[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), turn_hash(role, text), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(base, [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = set()
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p]  # noqa: E731, B023
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(path)))
        out.add((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids(path)), sum(not kids(p) for p in below), sum((len(members[p]) - 1) * words(p) for p in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "p") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(2)
    say = lambda: rng.choice(("hi", "hi there", None, "", " \t", "näh ñu", "a b  c"))
    rows = []
    for c in [*range(0, 30), *range(41, 60), 400, 401, 402, -20, -19, -3]:
        for t in range(rng.randint(0, 6) if c % 20 else rng.randint(1, 3)):
            rows.append((c, rng.choice((t, t, t, None, 1)), rng.choice(("user", "bot", None)), say()))
    rows += [(1, 1, "user", "hi")] * 3 + [(7, 0, "user", "long " * 20_000)] + [(None, 0, "user", "hi"), (80, None, None, None)]
    rows += [(c, t, "user", "same") for c in (100, 101, 102, 103, 104, 105) for t in range(5)]
    return rows


def test_against_tuples(spark, talks):
    got = prefix_trie.rebuilt_trie(frame(spark, talks).repartition(4))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(talks)
    assert prefix_trie.rebuilt_trie(frame(spark, talks).limit(0)).count() == 0
    assert prefix_trie.rebuilt_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_long_conversations(spark):
    """Conversations cut into ranges and into chunks of two turns; chains of 40 turns, which share 39, 20 and no turns."""
    rows = [(c, t, "user", f"turn {t}" if t < keep else f"own {c} {t}") for c, keep, n in ((0, 40, 40), (1, 39, 40), (2, 20, 41), (3, 0, 37), (20, 40, 33)) for t in range(n)]
    assert {tuple(r) for r in prefix_trie.rebuilt_trie(frame(spark, rows).repartition(3), chunk=2).collect()} == brute(rows)


def test_places_of_a_conversation_over_all_tasks(spark):
    rows = [(5, (k * 7) % 1000, "user", str(k)) for k in range(1000)] + [(6, 1, "a", "b"), (5, None, "user", "first")]
    got = prefix_trie.numbered(frame(spark, rows).repartition(4)).where("conv_id = 5").orderBy("place").select("place", "turn_hash").collect()
    want = [turn_hash("user", "first")] + [turn_hash("user", str(k)) for k in sorted(range(1000), key=lambda k: (k * 7) % 1000)]
    assert [r.place for r in got] == list(range(1, 1002)) and [bytes(r.turn_hash) for r in got] == want


def test_ends_of_many_batches(spark):
    """The ids of one node run through several Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(100).select(F.when(F.col("id") % 10 == 3, b"rare").otherwise(b"common").alias("key"), (F.lit(1000) - F.col("id") * 10).alias("conv_id"))
        got = {bytes(r.key): r.ends_sha256 for r in prefix_trie.ends_digest(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = lambda rare: ",".join(str(x) for x in sorted(1000 - k * 10 for k in range(100) if (k % 10 == 3) == rare))
    assert got == {b"rare": hashlib.sha256(ids(True).encode()).hexdigest(), b"common": hashlib.sha256(ids(False).encode()).hexdigest()}


def test_subtree_sums_of_a_path_and_a_star(spark):
    rows = [(f"{k}", f"{k - 1}" if k else None, k, 1, k) for k in range(21)] + [(f"leaf {k}", "0", 1, 1, 100) for k in range(50)]
    nodes = spark.createDataFrame(rows, "key string, parent string, depth long, one long, worth long")
    got = {r.key: (r.one, r.worth) for r in prefix_trie.subtree_sums(nodes, ("one", "worth")).collect()}
    assert got["0"] == (71, 210 + 5000) and got["leaf 3"] == (1, 100) and got["20"] == (1, 20)
    assert all(got[f"{k}"] == (21 - k, sum(range(k, 21))) for k in range(1, 21))
