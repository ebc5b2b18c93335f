"""Near duplicates: b-bit MinHash signatures joined by Hamming distance, links confirmed on full shingle sets.

A signature has 95 symbols of 16 bits in 19 chunks of 5.  Two signatures that differ in at most 37 symbols have, by
the pigeonhole principle, a chunk with at most one difference; every signature is therefore entered under each chunk
with each one symbol left out, and all pairs within that distance meet in a bucket.  Sets with a Jaccard similarity of
0.8 or more exceed the distance with a probability of about 2e-6.

Texts with equal sets are one class, known by a hash of the set.
Two bits of every symbol make a sketch of 24 bytes: symbols whose bits differ do differ, so that pairs whose sketches differ
in more than 37 symbols are out without a look at their signatures, and most chance meetings go before any text moves.

First every member of a bucket that may be near the bucket's leader is tried with one leader; the links so confirmed give
components.  Of the members of buckets that hold several components, those that may be near a member of another one stay:
next each is tried with its nearest one of another component, and at last all pairs that are still open, within the distance
and with sizes that allow the similarity, are confirmed.  The texts of whoever may have a link are fetched once.  So no link between different components is lost, and no group
is turned into all its pairs.  In a bucket the largest component is compared with the others only: a bucket is dealt out in
cells of a block of all members by a block of those others, so that one lone text in a crowd costs no more copies.

Defined results: null texts and texts without words have empty sets and are linked with nothing; texts with fewer words
than a shingle have one shingle, the whole sequence; repeated rows and equal texts share a component; rows with a null
id share in links but cannot be a component's id (if all are null, the id is null).  Only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import U64, blocks, gone, lower_ascii, map_text, mix, ranges, reachable, release, slice_hashes, stored, words
from tercet.llm.components import components

CHUNKS, CHUNK = 19, 5
SYMBOLS = CHUNKS * CHUNK
#: Symbols in which signatures may differ: with one difference a chunk allowed, more than CHUNKS * 2 - 1 are not covered.
DISTANCE = CHUNKS * 2 - 1
#: Members of a bucket, and shingles of their sets, in one block; pairs confirmed in one piece; pairs compared at once.
BUCKET_BLOCK, BUCKET_SHINGLES, FAN, PAIRS = 2048, 500_000, 512, 1 << 17
#: Bits of a bitmap for each row that is wanted: of the others one in SIFT at most passes.
SIFT = 16

WORDS, EVEN = (SYMBOLS + 31) // 32, U64(0x5555555555555555)
SKETCH = [f"s{k}" for k in range(WORDS)]
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_A = mix(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_B = mix(np.arange(1001, SYMBOLS + 1001, dtype=U64) * U64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, one text after another, and how many each has."""
    low = lower_ascii(data)
    s, length, before = words(low, off, IS_WORD)
    h = mix(slice_hashes(low, s, length))
    count = np.diff(before)
    got = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), got)
    at = ranges(before[:-1], got)
    width = np.minimum(count, n)[doc]
    key = width.astype(U64)
    for k in range(n):
        more = width > k
        key[more] = mix(key[more] * U64(0xD6E8FEB86659FD93) + h[at[more] + k])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[fresh], np.bincount(doc[fresh], minlength=len(count))


def set_ids(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit id of every set; equal sets have equal ids."""
    out = np.zeros(len(size), U64)
    some = size > 0
    first = (np.cumsum(size) - size)[some]
    if len(first):
        out[some] = mix(np.add.reduceat(mix(key), first) + size[some].astype(U64) * U64(0x9E3779B97F4A7C15))
    return out


def signatures(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols of every set that is not empty."""
    first = (np.cumsum(size) - size)[size > 0]
    out = np.zeros((len(first), SYMBOLS), np.uint16)
    if len(first):
        for k in range(SYMBOLS):
            out[:, k] = mix(np.minimum.reduceat((key ^ _B[k]) * _A[k], first)) & U64(0xFFFF)
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words for every signature: two bits of each symbol."""
    out = np.zeros((len(signature), WORDS), U64)
    for k in range(SYMBOLS):
        out[:, k // 32] |= (signature[:, k].astype(U64) & U64(3)) << U64(2 * (k % 32))
    return out


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many symbols sketches differ; never more than their signatures do."""
    x = a ^ b
    return np.bitwise_count((x | (x >> U64(1))) & EVEN).sum(1)


def _sketches_apart(a: str, b: str) -> Column:
    """sketch_distance() of the columns a0, a1, ... and b0, b1, ..."""
    x = [F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")) for k in range(WORDS)]
    return reduce(lambda p, q: p + q, (F.bit_count(y.bitwiseOR(F.shiftrightunsigned(y, 1)).bitwiseAND(F.lit(int(EVEN)))) for y in x))


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """For every signature, a 64-bit key for each chunk and each symbol left out of it."""
    out = np.empty((len(signature), SYMBOLS), U64)
    x = signature.astype(U64).reshape(-1, CHUNKS, CHUNK)
    for v in range(CHUNK):
        kept = [k for k in range(CHUNK) if k != v]
        packed = sum((x[:, :, k] << U64(16 * j) for j, k in enumerate(kept)), np.zeros(x.shape[:2], U64))
        out[:, v::CHUNK] = mix(packed ^ mix(np.arange(CHUNKS, dtype=U64) * U64(CHUNK) + U64(v + 1)))
    return out


def first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of signature pairs: the distance, and the one key number under which a pair is reported."""
    differ = (a != b).reshape(len(a), CHUNKS, CHUNK)
    per = differ.sum(2)
    chunk = (per <= 1).argmax(1)
    return per.sum(1), chunk * CHUNK + differ[np.arange(len(a)), chunk].argmax(1)


def describe(docs: DataFrame, n: int, id: str, text: str) -> DataFrame:
    """id, row (a hash of id and text), node (the set's id, null if empty), n_shingles, signature, sketch words."""
    src = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("row", F.xxhash64("id", "t"))

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        key, size = shingle_sets(data, off, n)
        found = signatures(key, size)
        sig = iter(r.tobytes() for r in found)
        node, words_ = set_ids(key, size).view(np.int64), np.zeros((len(size), WORDS), U64)
        words_[size > 0] = sketches(found)
        return [*batch.columns[:2], pa.array(node, mask=size == 0), pa.array(size), pa.array([next(sig) if k else None for k in size.tolist()], pa.binary()), *(pa.array(w.view(np.int64)) for w in words_.T.copy())]

    return map_text(src, ["id", "row"], "t", "id long, row long, node long, n_shingles long, signature binary, " + ", ".join(f"{c} long" for c in SKETCH), each)


def memberships(classes: DataFrame) -> DataFrame:
    """key, v, node, leader, pair for buckets with two members or more; v is the key's number, leader the least node.

    A bucket of two (if its rows come in one batch) is one row, of the member that does not lead, with pair = true;
    others have a row for every member.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                k = bucket_keys(sig)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int8), len(k))), pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS))], ["key", "v", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last member so far, and its leader; whether its bucket has been opened, whether it was given out
        for batch in batches:
            key, v, node = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            if held is not None:
                key, v, node = np.append(held[0], key), np.append(held[1], v), np.append(held[2], node)
            new = np.append(True, key[1:] != key[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            leader = node[first]
            if held is not None:
                leader[first == 0] = held[3]
            last = np.append(new[1:], False)  # the last bucket may go on in the next batch
            two = new & ~np.append(new[1:], True) & np.append(last[1:], False)
            if held is not None and held[4]:
                two[0] = False
            pair = np.append(False, two[:-1])
            many = (~new | np.append(~new[1:], False)) & ~two
            if held is not None:
                many[0] &= not held[5]
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (key, v, node, leader, pair)], ["key", "v", "node", "leader", "pair"])
            opened = not new[-1] or (held is not None and len(key) == 1 and held[4])
            given = bool(many[-1]) or (held is not None and len(key) == 1 and held[5])
            held = key[-1:], v[-1:], node[-1:], leader[-1], opened or (first[-1] == 0 and held is not None and held[4]), given
            # a member that opened a bucket at a batch's end is given out with the next batch, if that goes on with it

    dealt = classes.select("node", "signature").mapInArrow(keys, "key long, v byte, node long")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(shared, "key long, v byte, node long, leader long, pair boolean")


def _sifted(src: DataFrame, rows: DataFrame) -> DataFrame:
    """`src` without most of those whose `row` is not in `rows`, and with all others, by a bitmap of SIFT bits a row.

    Tasks read the bitmap, a stage table, from the shared folder; where they cannot, `src` stays as it is.
    """
    place = F.pmod(F.xxhash64("row"), F.lit(max(1, SIFT * rows.count()))) + 1  # bitmap functions number places from 1
    bits = stored(rows.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")))
    folder = bits.stored_at
    if not reachable(folder):
        return src

    @F.pandas_udf("boolean")
    def wanted(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        where, path = fs.FileSystem.from_uri(folder)
        found = ds.dataset(path, format="parquet", filesystem=where, schema=pa.schema([("bucket", pa.int64()), ("bits", pa.binary())])).to_table()
        bucket = found.column("bucket").to_numpy()
        whole = np.zeros((int(bucket.max(initial=0)) + 1, 4096), np.uint8)
        for b, x in zip(bucket.tolist(), found.column("bits").to_pylist(), strict=True):
            whole[b - 1] = np.frombuffer(x, np.uint8)
        whole = whole.ravel()
        for p in places:
            at = p.to_numpy() - 1
            there = at >> 3 < len(whole)
            yield pd.Series((whole[np.where(there, at >> 3, 0)] >> (at & 7).astype(np.uint8) & 1).astype(bool) & there)

    return src.where(wanted(place))


def _texts(docs: DataFrame, rows: DataFrame, id: str, text: str) -> DataFrame:
    """node, t: one text of each node (more where rows repeat).  The only step that moves documents.

    The rows wanted grow with the documents, so both sides are shuffled at every size, and neither is ever broadcast; most
    documents that are not wanted are left out before.
    """
    src = docs.select(F.xxhash64(F.col(f"`{id}`").cast("long"), F.col(f"`{text}`").cast("string")).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))
    return _sifted(src, rows).hint("merge").join(rows, "row").select("node", "t")


def _sets(texts: DataFrame, need: DataFrame, keep: list[str], n: int) -> DataFrame:
    """keep columns of `need` and s: the set, as sorted 64-bit hashes, of the text of its `node`."""
    kinds = dict(need.dtypes)

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        key, size = shingle_sets(data, off, n)
        cells = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((np.concatenate([[0], np.cumsum(size)]) * 8).astype(np.int32)), pa.py_buffer(key.tobytes())])
        return [*batch.columns[: len(keep)], cells]

    return map_text(texts.join(need, "node"), keep, "t", ", ".join([*(f"{c} {kinds[c]}" for c in keep), "s binary"]), each, [*keep, "s"])


def confirm(texts: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full sets have 100 * intersection >= percent * union.

    A fan of pairs with one `a` is dealt out in parts of about FAN.
    """
    fans = pairs.groupBy("a").agg(F.count("*").alias("fan"))
    dealt = pairs.join(fans, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.ceil(F.col("fan") / FAN)))
    need = dealt.select("a", "g", F.col("b").alias("node"), F.lit(False).alias("own")).union(dealt.select("a", "g", F.col("a").alias("node"), F.lit(True)).distinct())
    sets = _sets(texts, need, ["a", "g", "node", "own"], n)
    sets = sets.repartition("a", "g").sortWithinPartitions("a", "g", F.desc("own"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, last = None, None, None
        for batch in batches:
            a, b = [], []
            for x, g, node, own, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own:
                    now, mine = (x, g), np.frombuffer(raw, U64)
                    continue
                if (x, g) != now or (x, g, node) == last:  # repeated rows bring a text more than once
                    continue
                last = x, g, node
                s = np.frombuffer(raw, U64)
                common = int((mine[np.minimum(np.searchsorted(mine, s), len(mine) - 1)] == s).sum())
                if 100 * common >= percent * (len(mine) + len(s) - common):
                    a.append(x), b.append(node)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sets.mapInArrow(run, "a long, b long")


def dealt_buckets(members: DataFrame) -> DataFrame:
    """members (key, v, node, root, n_shingles, ...) of buckets with several roots, as cells (key, i, j).

    `i` is a block of all members, `j` one of those outside the bucket's largest root.  role: 1 of the first, 2 of the
    second, 3 of both; `small` are the members outside the largest root.  A bucket of one block each is one cell.
    """
    per = members.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"))
    sizes = per.groupBy("key").agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.max_by(F.struct("root", "n", "held"), F.struct("n", "root")).alias("most"))
    count = lambda n, held: F.greatest(F.lit(1), F.ceil(n / BUCKET_BLOCK), F.ceil(held / BUCKET_SHINGLES)).cast("long")
    sizes = sizes.select("key", F.col("most.root").alias("largest"), count(F.col("n"), F.col("held")).alias("rows"), count(F.col("n") - F.col("most.n"), F.col("held") - F.col("most.held")).alias("others"))
    got = members.join(sizes, "key").withColumn("small", F.col("root") != F.col("largest"))
    i, j = F.pmod(F.xxhash64("node"), "rows"), F.pmod(F.xxhash64("node", F.lit(1)), "others")
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    here = F.transform(up_to("others"), lambda x: cell(i, x, F.lit(1)))
    there = F.when(F.col("small"), F.transform(up_to("rows"), lambda x: cell(x, j, F.lit(2)))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,role:int>>"))
    zero = F.lit(0).cast("long")
    cells = F.when((F.col("rows") == 1) & (F.col("others") == 1), F.array(cell(zero, zero, F.when(F.col("small"), 3).otherwise(1)))).otherwise(F.concat(here, there))
    return got.withColumn("c", F.explode(cells)).select("key", "c.i", "c.j", "c.role", "small", *(c for c in members.columns if c != "key"))


def _by_cell(rows: DataFrame, each: Callable[[pa.RecordBatch], list | None], schema: str) -> DataFrame:
    """each(whole cells, owners after visitors) -> arrays of `schema`, streamed over sorted partitions."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            new = _starts(held)
            if len(new) > 1:
                out = each(held.slice(0, new[-1]))
                if out is not None:
                    yield pa.RecordBatch.from_arrays(out, names)
                held = held.slice(new[-1])
        if held is not None and held.num_rows:
            out = each(held)
            if out is not None:
                yield pa.RecordBatch.from_arrays(out, names)
        release()

    dealt = rows.repartition("key", "i", "j").withColumn("owns", F.col("role") != 2)
    return dealt.sortWithinPartitions("key", "i", "j", "owns", "node").drop("owns").mapInArrow(run, schema)


def _starts(cells: pa.RecordBatch) -> np.ndarray:
    """The first row of every cell."""
    k = [cells.column(c).to_numpy() for c in range(3)]
    return np.flatnonzero(np.append(True, (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1]))[: cells.num_rows])


def open_pairs(cells: pa.RecordBatch, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows x and y of a cell, and their distance, whose roots differ and which may be as similar; each pair once.

    Without a column of signatures the distance is that of sketches.  With one it is exact, and a pair that meets in
    several buckets is open in one of them only.
    """
    col = {c: cells.column(c).to_numpy(zero_copy_only=False) for c in cells.schema.names if c != "signature"}
    exact = "signature" in cells.schema.names
    if exact:
        signature = np.frombuffer(b"".join(cells.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
    sketch = np.stack([col[c] for c in SKETCH], 1).view(U64)
    start = _starts(cells)
    end = np.append(start[1:], cells.num_rows)
    owns = col["role"] != 2
    cell = np.repeat(np.arange(len(start)), end - start)
    first_own = end - np.add.reduceat(owns.astype(np.int64), start)
    x = np.flatnonzero(col["role"] != 1)
    many = (end - first_own)[cell[x]]
    for lo, hi in blocks(np.append(0, np.cumsum(many)), PAIRS):
        mine, k = x[lo:hi], many[lo:hi]
        a, b = np.repeat(mine, k), ranges(first_own[cell[mine]], k)
        ok = (col["root"][a] != col["root"][b]) & (~col["small"][b] | (col["node"][a] < col["node"][b]))
        na, nb = col["n_shingles"][a], col["n_shingles"][b]
        ok &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
        a, b = a[ok], b[ok]
        d = sketch_distance(sketch[a], sketch[b])
        ok = d <= DISTANCE
        a, b, d = a[ok], b[ok], d[ok]
        for at in range(0, len(a), PAIRS // 8):
            x_, y_, d_ = (c[at : at + PAIRS // 8] for c in (a, b, d))
            if exact:
                d_, meet = first_meeting(signature[x_], signature[y_])
                ok = (d_ <= DISTANCE) & (meet == col["v"][x_])
                x_, y_, d_ = x_[ok], y_[ok], d_[ok]
            if len(x_):
                yield x_, y_, d_


def near_members(dealt: DataFrame, percent: int) -> DataFrame:
    """key, v, node of the members that by their sketches may be near one of another root in their bucket."""

    def each(cells: pa.RecordBatch) -> list | None:
        some = np.zeros(cells.num_rows, bool)
        for a, b, _ in open_pairs(cells, percent):
            some[a], some[b] = True, True
        kept = cells.filter(pa.array(some))
        return [kept.column(c) for c in ("key", "v", "node")] if kept.num_rows else None

    return _by_cell(dealt, each, "key long, v byte, node long").distinct()


def nearest_pairs(dealt: DataFrame, percent: int) -> DataFrame:
    """a, b: for each node, the open pair of the least distance; so at most as many rows as nodes."""

    def each(cells: pa.RecordBatch) -> list | None:
        node, best, to = cells.column("node").to_numpy(), np.full(cells.num_rows, SYMBOLS + 1), np.zeros(cells.num_rows, np.int64)
        for a, b, d in open_pairs(cells, percent):
            for x, y in ((a, b), (b, a)):
                order = np.lexsort((node[y], d))[::-1]  # the last write, of the least distance, stays
                x, y, e = x[order], y[order], d[order]
                least = np.full(cells.num_rows, SYMBOLS + 1)
                least[x] = e
                other = np.zeros(cells.num_rows, np.int64)
                other[x] = node[y]
                fresh = least < best
                best[fresh], to[fresh] = least[fresh], other[fresh]
        found = best <= SYMBOLS
        return [pa.array(node[found]), pa.array(to[found]), pa.array(best[found])] if found.any() else None

    found = _by_cell(dealt, each, "a long, b long, d long").groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_members(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows of `dealt` that have an open pair in their cell; pairs themselves are not given out."""

    def each(cells: pa.RecordBatch) -> list | None:
        some = np.zeros(cells.num_rows, bool)
        for a, b, _ in open_pairs(cells, percent):
            some[a], some[b] = True, True
        kept = cells.filter(pa.array(some))
        return kept.columns if kept.num_rows else None

    return _by_cell(dealt, each, ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in dealt.dtypes))


def settle(texts: DataFrame, dealt: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: links that join the different roots of each bucket, by all its open pairs, confirmed on full sets.

    Only members with an open pair bring their sets; pairs of roots that are joined by then are passed over.
    """
    involved = stored(open_members(dealt, percent))
    sets = stored(_sets(texts, involved.select("node").distinct(), ["node"], n).dropDuplicates(["node"]))
    dropped = [c for c in involved.columns if c not in ("node",)]
    cells = involved.join(sets, "node").select(*dropped, "node", "s")

    def each(cells: pa.RecordBatch) -> list | None:
        node, root, size = (cells.column(c).to_numpy() for c in ("node", "root", "n_shingles"))
        sets = [np.frombuffer(r, U64) for r in cells.column("s").to_pylist()]
        joined: dict[int, int] = {}

        def find(r: int) -> int:
            while joined.setdefault(r, r) != r:
                joined[r] = r = joined[joined[r]]
            return r

        out = []
        for a, b, _ in open_pairs(cells.drop_columns(["s"]), percent):
            order = np.argsort(a, kind="stable")
            for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                r, q = find(int(root[x])), find(int(root[y]))
                if r == q:
                    continue
                common = int((sets[x][np.minimum(np.searchsorted(sets[x], sets[y]), len(sets[x]) - 1)] == sets[y]).sum())
                if 100 * common >= percent * (size[x] + size[y] - common):
                    joined[r] = q
                    out.append((node[x], node[y]))
        return [pa.array(c) for c in np.array(out, np.int64).reshape(-1, 2).T] if out else None

    return _by_cell(cells, each, "a long, b long")


def _roots(members: DataFrame, links: DataFrame) -> DataFrame:
    """node, root of all members: the component of those with links, themselves for others."""
    return stored(members.select("node").distinct().join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, v, node, root of the members of buckets in which more than one root meets."""
    placed = members.select("key", "v", "node").join(roots, "node")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return placed.join(mixed, "key")


class Components:
    """What link() and representatives() share: rows (id, row, node, n_shingles) and classes (node, root, first).

    `first` is the least (has no id, id, row) of the rows with a set.
    """

    def __init__(self, docs: DataFrame, n: int, percent: int, id: str, text: str):
        if percent < 80:
            raise ValueError("signatures are laid out for similarities of 0.8 and more")
        all_ = stored(describe(docs, n, id, text))
        some = all_.where("node is not null")
        classes = stored(some.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("first"), F.min("row").alias("row"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), *(F.min(c).alias(c) for c in SKETCH)))
        sketch = lambda node, name: classes.select(F.col("node").alias(node), F.col("n_shingles").alias(f"{name}_n"), *(F.col(c).alias(f"{name}{k}") for k, c in enumerate(SKETCH)))
        met = memberships(classes).join(sketch("node", "a"), "node").join(sketch("leader", "b"), "leader")
        near = (_sketches_apart("a", "b") <= DISTANCE) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
        met = stored(met.select("key", "v", "node", "leader", "pair", near.alias("near")).where("near or not pair"))
        fan = met.where("near and leader != node").groupBy("node", "leader").agg(F.count("*").alias("n"))
        tried = stored(fan.groupBy("node").agg(F.max_by("leader", F.struct("n", "leader")).alias("a")).select("a", F.col("node").alias("b")))
        members = met.select("key", "v", F.explode(F.when(F.col("pair"), F.array("node", "leader")).otherwise(F.array("node"))).alias("node"))
        # Whoever may have a link: is tried, or may be near a member of another crowd, crowds being what tried pairs would join.
        maybe = self._open(members, tried, classes, percent).select("node").union(tried.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
        nodes = stored(classes.drop("first").join(maybe, "node"))
        texts = stored(_texts(docs, nodes.select("node", "row"), id, text))
        links = stored(confirm(texts, tried, n, percent))
        open_ = stored(self._open(members.join(nodes.select("node"), "node", "left_semi"), links, nodes, percent))
        gone(met, tried)
        for last in (False, True):
            roots = _roots(open_, links)
            dealt = dealt_buckets(_mixed(open_, roots).join(nodes.select("node", "n_shingles", *SKETCH, "signature"), "node"))
            more = settle(texts, dealt, n, percent) if last else confirm(texts, stored(nearest_pairs(dealt, percent)), n, percent)
            links = stored(links.union(more))
        gone(texts, open_, nodes)
        self.rows = all_
        self.classes = classes.select("node", "first").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")

    @staticmethod
    def _open(members: DataFrame, links: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
        """near_members() of buckets in which components of `links` meet."""
        placed = _mixed(members, _roots(members, links))
        return near_members(dealt_buckets(placed.join(classes.select("node", "n_shingles", *SKETCH), "node")), percent)


def link(docs: DataFrame, n: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles long, component_id (the smallest id reachable over links, itself included), kept boolean.

    Links: texts whose sets of n-word shingles have 100 * intersection >= percent * union; percent from 80 up.
    """
    c = Components(docs, n, percent, id, text)
    classes = stored(c.classes)
    least = classes.groupBy("root").agg(F.min(F.col("first.id")).alias("component_id"))
    by_class = classes.join(least, "root").select("node", "component_id")
    out = c.rows.select("id", "node", "n_shingles").join(by_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of every component: that of the smallest id, rows without an id coming last.

    Texts without a set stay.  Rows are told apart by id and text; of rows equal in both one stays, whichever.
    """
    c = Components(docs, n, percent, id, text)
    kept = c.classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    kept = stored(kept)
    some = c.rows.where("node is not null").groupBy("row").agg(F.count("*").alias("n"))
    state = stored(some.join(kept.withColumn("kept", F.lit(True)), "row", "left").where("kept is null or n > 1"))
    mine = docs.withColumn("__row", F.xxhash64(F.col(f"`{id}`").cast("long"), F.col(f"`{text}`").cast("string")))
    again = state.where("kept").select(F.col("row").alias("__row"))
    once = mine.join(state.select(F.col("row").alias("__row")), "__row", "left_anti")
    return once.unionByName(mine.join(again, "__row", "left_semi").dropDuplicates(["__row"])).drop("__row")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, hash(t) AS t FROM (SELECT r, CASE WHEN len(w) = 1 THEN w[1] ELSE unnest(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) END AS t FROM d WHERE len(w) > 1 UNION ALL SELECT r, w[1] FROM d WHERE len(w) = 1)),
z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
l AS (SELECT ra, rb FROM i JOIN z a ON a.r = ra JOIN z b ON b.r = rb WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT ra AS x, rb AS y FROM l UNION ALL SELECT rb, ra FROM l),
g(x, y) AS (SELECT r, r FROM d UNION SELECT g.x, e.y FROM g JOIN e ON g.y = e.x),
m AS (SELECT g.x AS r, min(d.doc_id) AS c FROM g JOIN d ON d.r = g.y GROUP BY g.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, coalesce(doc_id = c, false) AS kept FROM d JOIN m USING (r) LEFT JOIN z USING (r)
"""
