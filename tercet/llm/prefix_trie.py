"""Conversation prefix trie: what conversations share from their first turn on, and what is saved where shared turns count once.

A node is a distinct sequence of first turns, known by a digest; the digest of its parent is known from the same row, so that
nodes and edges come out of one aggregation.  Sums over subtrees are rolled up by pointer jumping: in round k a node has the sum
over its descendants less than 2**k below it and the key of its ancestor 2**k above; the sums are added up at those ancestors,
and the keys jump twice as far.  A trie of depth d takes log2(d) rounds, each over the nodes deeper than 2**k alone.

No conversation is gathered.  Turns are numbered, and digests summed, in pieces of bounded length with offsets from the pieces
before, so a conversation may hold any share of the table.  A turn is its SHA-256; the digest of a sequence is the sum of six
32-bit hashes of place and turn, hashed once more, with the length, to 128 bits.  The conversations that end at a node are
hashed in the order of their ids as they stream by, sorted, through the task that has the node; they are not held.

Defined results: rows without conv_id belong to no conversation; null roles and texts are empty; turns are ordered by turn, null
first, and equal ones by the SHA-256 of role and text; repeated rows are turns of their own; extra columns are not read; an empty
table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.llm.common import gone, stored

#: Turns of one conversation whose digests are summed in one window.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"
PIECES = tuple(f"s{k}" for k in range(6))


def borrowed(c: Column) -> Column:
    """How many first turns conversation `c` takes from the conversation that leads its twenty."""
    return (F.crc32(c.cast("string").cast("binary")) % 4).cast("long")


def leader(c: Column) -> Column:
    return c - c % 20


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_hash, words; turns are dealt by ranges, so that a long conversation is numbered in parts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("turn_hash")]
    dealt = stored(turns.repartitionByRange("conv_id", *order).withColumn("piece", F.spark_partition_id()))
    sizes = dealt.groupBy("conv_id", "piece").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("earlier", before).where("earlier IS NOT NULL").drop("m")  # a row for each cut in a conversation
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy(*order)))
    got = ranked.join(offsets, ["conv_id", "piece"], "left")
    return got.select("conv_id", (F.col("rank") + F.coalesce("earlier", F.lit(0))).alias("place"), "turn_hash", "words")


def rebuilt(turns: DataFrame, take: Callable[[Column], Column] = borrowed, lead: Callable[[Column], Column] = leader, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two frames: conv_id, depth, turn_hash, words of the rebuilt turns; and conv_id, total, a row per conversation.

    Conversation c gets the first take(c) turns (at most `most`) of lead(c), then its own turns after its first take(c).
    """
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.least("n", F.lit(most)).alias("n_base"))
    c = F.col("conv_id")
    info = lengths.select("conv_id", "n", take(c).alias("h"), lead(c).alias("base")).join(bases, "base", "left")
    info = info.withColumn("led", F.least("h", F.coalesce("n_base", F.lit(0))))
    info = stored(info.select("conv_id", "base", "h", "led", (F.col("led") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    short = info.where("led < h").select("conv_id", (F.col("h") - F.col("led")).alias("short"))
    own = turns.withColumn("h", take(c)).where("place > h").join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("short", F.lit(0))).alias("depth"), "turn_hash", "words")
    first = turns.where(F.col("place") <= most).withColumnRenamed("conv_id", "base")
    led = info.join(first, "base").where("place <= led").select("conv_id", F.col("place").alias("depth"), "turn_hash", "words")
    return own.unionByName(led), info.select("conv_id", "total")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary")))


def root_key() -> Column:
    return _key(F.lit(0), [F.lit(0)] * len(PIECES))


def keyed(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth, key, parent, words: the node that each turn of a sequence (conv_id, depth, turn_hash, words) reaches."""
    term = {p: F.xxhash64(F.lit(k), "depth", "turn_hash").bitwiseAND(F.lit(0xFFFFFFFF)) for k, p in enumerate(PIECES)}
    rows = turns.withColumns(term).withColumn("chunk", F.floor((F.col("depth") - 1) / chunk))
    path = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    sums = rows.withColumns({f"t{p}": F.sum(p).over(path) for p in PIECES})
    whole = rows.groupBy("conv_id", "chunk").agg(*(F.sum(p).alias(p) for p in PIECES))
    path = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.select("conv_id", "chunk", *(F.sum(p).over(path).alias(f"e{p}") for p in PIECES)).where("chunk > 0")
    got = sums.join(earlier, ["conv_id", "chunk"], "left")
    upto = [F.col(f"t{p}") + F.coalesce(f"e{p}", F.lit(0)) for p in PIECES]
    above = [s - F.col(p) for s, p in zip(upto, PIECES, strict=True)]
    return got.select("conv_id", "depth", _key(F.col("depth"), upto).alias("key"), _key(F.col("depth") - 1, above).alias("parent"), "words")


def ends_digest(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 from rows (key, conv_id): the ids of each key in ascending order, in decimals, comma-joined, hashed.

    Rows come sorted, and a key's ids run through one hash object: a key may have any number of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, ids, out = batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.string()).to_pylist(), []
            lo = 0
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                text = ",".join(ids[lo:hi]).encode()
                if keys[lo] == key:
                    state.update(b"," + text)
                else:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = keys[lo], hashlib.sha256(text)
                lo = hi
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, measures: tuple[str, ...], key: str = "key", parent: str = "parent", depth: str = "depth") -> DataFrame:
    """key and the sums of each measure over the node's subtree, itself included, by pointer jumping.

    Each round is a table in the shared folder.  Nodes leave the rounds as soon as they have no ancestor so far above; what they
    gain later is added up at the end.
    """
    deepest = nodes.agg(F.max(depth)).first()[0] or 0
    live = nodes.where(f"{depth} >= 1").select(F.col(key).alias("key"), F.col(parent).alias("jump"), F.col(depth).alias("depth"), *measures)
    gains, tables, reach = [], [], 1
    while reach <= deepest:
        gain = stored(live.groupBy(F.col("jump").alias("key")).agg(*(F.sum(m).alias(m) for m in measures)))
        gains.append(gain)
        reach *= 2
        if reach > deepest:
            break
        further = live.select(F.col("key").alias("jump"), F.col("jump").alias("far"))
        more = gain.select("key", *(F.col(m).alias(f"g_{m}") for m in measures))
        deep = live.where(F.col("depth") >= reach).join(further, "jump").join(more, "key", "left")
        live = stored(deep.select("key", F.col("far").alias("jump"), "depth", *((F.col(m) + F.coalesce(f"g_{m}", F.lit(0))).alias(m) for m in measures)))
        tables.append(live)
    total = nodes.select(F.col(key).alias("key"), *measures)
    for gain in gains:
        total = total.unionByName(gain)
    out = stored(total.groupBy("key").agg(*(F.sum(m).alias(m) for m in measures)))
    gone(*gains, *tables)
    return out


def trie(turns: DataFrame, totals: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per node of the sequences in `turns` (conv_id, depth, turn_hash, words); totals: conv_id, total, a row per member.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    steps = stored(keyed(turns, chunk))
    root = totals.select("conv_id", F.lit(0).cast("long").alias("depth"), root_key().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))
    members = steps.select("conv_id", F.col("depth").cast("long").alias("depth"), "key", "parent", "words").unionByName(root)
    nodes = members.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("words").alias("words")
    )
    children = nodes.where("depth >= 1").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = stored(nodes.select("*", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    sums = subtree_sums(nodes, ("n_leaves", "saved_tokens"))
    last = steps.join(totals.withColumnRenamed("total", "depth"), ["conv_id", "depth"]).select("key", "conv_id")
    last = last.unionByName(totals.where("total = 0").select(root_key().alias("key"), "conv_id"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    got = nodes.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends_digest(last), "key", "left").join(above, "parent", "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The trie of the rebuilt conversations of a table conv_id, turn, role, text."""
    turns, totals = rebuilt(stored(numbered(conversations)))
    return trie(turns, totals, chunk)


SQL = r"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, flatten(list_transform(string_split(c::varchar, ''), lambda x: list_transform(range(8), lambda k: (ord(x) >> k::int) & 1))) AS b FROM (SELECT DISTINCT c FROM turns)),
ids AS (SELECT c, c - c % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(b, lambda x: x::bigint)),
        lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384::bigint ELSE 0::bigint END)), 4294967295::bigint) % 4 AS h FROM bits),
own AS (SELECT i.c, 1 AS late, p, role, text FROM ids i JOIN turns t ON t.c = i.c AND t.p > i.h
    UNION ALL SELECT i.c, 0, p, role, text FROM ids i JOIN turns t ON t.c = i.base AND t.p <= i.h),
rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY late, p) AS d, role, text FROM own),
chained AS (SELECT c, d, role, text, sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d)) AS path FROM rebuilt),
steps AS (SELECT c, d, path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, coalesce(lag(path) OVER (PARTITION BY c ORDER BY d), '') AS above FROM chained
    UNION ALL SELECT c, 0, '', 0, NULL FROM ids),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words, min(above) AS above FROM steps GROUP BY 1, 2),
totals AS (SELECT c, max(d) AS total FROM steps GROUP BY 1),
ends AS (SELECT s.path, sha256(string_agg(s.c::varchar, ',' ORDER BY s.c)) AS ends_sha256 FROM steps s JOIN totals t ON t.c = s.c AND t.total = s.d GROUP BY 1),
children AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
valued AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (k.n_children IS NULL)::bigint AS leaf, (n.n_convs - 1) * n.words AS saved FROM nodes n LEFT JOIN children k ON k.path = n.path),
up AS (SELECT a.path AS top, v.leaf, v.saved FROM valued v JOIN steps a ON a.c = v.conv_id AND a.d <= v.d),
sums AS (SELECT top AS path, sum(leaf)::bigint AS n_leaves, sum(saved)::bigint AS saved_tokens FROM up GROUP BY 1)
SELECT v.conv_id, v.d::bigint AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children::bigint AS n_children, s.n_leaves, s.saved_tokens,
    coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM valued v JOIN sums s ON s.path = v.path LEFT JOIN ends e ON e.path = v.path LEFT JOIN nodes p ON p.path = v.above
"""
