"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

The alphabet is words.  Patterns of one length share a shift table over blocks of two words: where a block of the
text is in no pattern, the search jumps by the whole window.  Where the shift is zero, the hash of the window's last
block selects a bucket of patterns, and their words are compared byte by byte.  Texts advance side by side, in lanes.

Benchmarks are taken in blocks of bounded size, one at a time; each block is one pass over the documents.  A benchmark of one
block shuffles nothing; of more, every pass before the last stores what it hits, by the hash of the text, for the last.

Defined results: null and empty texts have no words; items without words, and rows with a null item_id, have no
windows; repeated items count once, under each of their ids; repeated documents give repeated rows; an empty
benchmark hits nothing.  Only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import U64, lower_ascii, map_text, ranges, slice_hashes, stored, words

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_STEP = U64(0x9E3779B97F4A7C15)
_BITS = 18
LANE = 256


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, lengths and hashes of words; words before each text."""
    low = lower_ascii(data)
    s, length, before = words(low, off, IS_WORD)
    return low, s, length, slice_hashes(low, s, length), before


@dataclass
class Patterns:
    """All windows of one length: shift table, buckets by the hash of the last block, and the windows' words."""

    width: int
    shift: np.ndarray
    bucket: np.ndarray
    word: np.ndarray
    length: np.ndarray
    start: np.ndarray
    data: np.ndarray
    item_first: np.ndarray
    item_count: np.ndarray
    items: np.ndarray

    def block(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of the block that ends at each word."""
        return h[at] if self.width == 1 else h[at - 1] * _STEP + h[at]

    def search(self, low: np.ndarray, s: np.ndarray, length: np.ndarray, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows end, as word numbers, and which pattern each is."""
        w = self.width
        first, last = before[:-1] + w - 1, before[1:]
        n = np.maximum(0, -(-(last - first) // LANE))
        lane = np.repeat(np.arange(len(n)), n)
        pos = first[lane] + LANE * (np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(pos + LANE, last[lane])
        ends, found = [], []
        while len(pos):
            key = self.block(h, pos)
            step = self.shift[key >> U64(64 - _BITS)]
            stop = step == 0
            if stop.any():
                at, k = pos[stop], key[stop]
                lo, hi = np.searchsorted(self.bucket, k, "left"), np.searchsorted(self.bucket, k, "right")
                at, p = np.repeat(at, hi - lo), ranges(lo, hi - lo)
                if len(at):
                    at, p = self.confirm(low, s, length, h, at, p)
                    ends.append(at), found.append(p)
            pos = pos + np.maximum(step, 1)
            live = pos < end
            pos, end = pos[live], end[live]
        none = np.zeros(0, np.int64)
        return np.concatenate(ends or [none]), np.concatenate(found or [none])

    def confirm(self, low: np.ndarray, s: np.ndarray, length: np.ndarray, h: np.ndarray, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those (end, pattern) whose words are the same bytes."""
        col = np.arange(1 - self.width, 1)
        alike = (h[at] == self.word[p, -1]) & (h[at - self.width + 1] == self.word[p, 0])
        at, p = at[alike], p[alike]
        i = at[:, None] + col
        alike = (length[i] == self.length[p]).all(1)
        at, p, i = at[alike], p[alike], i[alike]
        if not len(at):
            return at, p
        size = length[i].ravel()
        same = low[ranges(s[i].ravel(), size)] == self.data[ranges(self.start[p].ravel(), size)]
        ok = np.logical_and.reduceat(same, (np.cumsum(size) - size)[:: self.width])
        return at[ok], p[ok]


def compile_patterns(items: list[tuple[str, str]], window: int) -> list[Patterns]:
    """Patterns by length from (item_id, text); windows of `window` words, a shorter item is one window."""
    texts = [t.encode() for _, t in items]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    low, s, length, h, before = tokens(np.frombuffer(b"".join(texts), np.uint8), off)
    raw = low.tobytes()
    word = [raw[a : a + n] for a, n in zip(s.tolist(), length.tolist(), strict=True)]
    by: dict[int, dict[tuple[bytes, ...], tuple[int, set[int]]]] = {}
    for k in range(len(items)):
        a, b = int(before[k]), int(before[k + 1])
        w = min(window, b - a)
        for i in range(a, b - w + 1) if w else ():
            by.setdefault(w, {}).setdefault(tuple(word[i : i + w]), (i, set()))[1].add(k)
    out = []
    for w, found in sorted(by.items()):
        at = np.array([i for i, _ in found.values()])[:, None] + np.arange(w)
        hashes = h[at]
        block = min(w, 2)
        shift = np.full(1 << _BITS, w - block + 1, np.int64)
        for q in range(w - 1, block - 2, -1):  # blocks that end at word q of the window
            key = hashes[:, q] if block == 1 else hashes[:, q - 1] * _STEP + hashes[:, q]
            np.minimum.at(shift, (key >> U64(64 - _BITS)).astype(np.int64), w - 1 - q)
        last = hashes[:, -1] if block == 1 else hashes[:, -2] * _STEP + hashes[:, -1]
        order = np.argsort(last, kind="stable")
        own = [sorted(v[1]) for v in found.values()]
        own = [own[i] for i in order]
        count = np.array([len(x) for x in own])
        out.append(Patterns(w, shift, last[order], hashes[order], length[at][order], s[at][order], low, np.cumsum(count) - count, count, np.array([i for x in own for i in x])))
    return out


def _spans(mask: np.ndarray, s: np.ndarray, length: np.ndarray, before: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges, within their texts, of runs of hit words; and how many each text has."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[before[:-1]] = True
    opens = mask.copy()
    opens[1:] &= ~mask[:-1] | edge[1:-1]
    closes = mask.copy()
    closes[:-1] &= ~mask[1:] | edge[1:-1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    row = np.searchsorted(before, a, "right") - 1
    return np.column_stack([s[a] - off[row], s[b] + length[b] - off[row]]), np.bincount(row, minlength=len(before) - 1)


def search(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """keep columns, n_words long, n_hit long, items array<string> (those with occurring windows, sorted as strings),
    spans array<int> (start and end, in UTF-8 bytes, of each run of hit words).

    block_bytes bounds the benchmark text that the driver and a task hold at once; larger benchmarks take more passes.
    """
    bench = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-max(total, 1) // block_bytes)
    bench = bench.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__t"))
    bench = stored(bench) if n > 1 else bench
    block = lambda b: [(r[0], r[1]) for r in bench.where(F.col("b") == b).orderBy("i", "t").select("i", "t").collect()]
    key, hits = F.sha2(F.col("__t"), 256).alias("__key"), None
    for b in range(n - 1):  # one block at a time; what it hits, by text, goes into a table
        found = _pass(src.select(key, "__t").dropDuplicates(["__key"]), ["__key"], block(b), window).where("n_hit > 0").select("__key", "items", "mask")
        hits = stored(found) if hits is None else hits.union(stored(found))
    if hits is None:
        return _pass(src, list(keep), block(n - 1), window).drop("mask")
    before = hits.groupBy("__key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"), F.collect_list("mask").alias("__masks"))  # at most one of each pass
    both = src.withColumn("__key", key).join(before, "__key", "left").select(*keep, "__items", "__masks", "__t")
    return _pass(both, list(keep), block(n - 1), window, carried=True).drop("mask")


def _pass(src: DataFrame, keep: list[str], block: list[tuple[str, str]], window: int, carried: bool = False) -> DataFrame:
    """keep columns, n_words, n_hit, items, spans and mask (hit words, as bits) of the texts `__t`, for one block of items.

    carried: src has __items and __masks of passes before, which are taken in.
    """
    kinds = dict(src.dtypes)
    k = len(keep)
    ids = np.array([i for i, _ in block], object)
    compiled: list[list[Patterns]] = []

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        if not compiled:
            compiled.append(compile_patterns(block, window))
        low, s, length, h, before = tokens(data, off)
        rows = len(off) - 1
        change = np.zeros(len(s) + 1, np.int64)
        pairs = []
        for p in compiled[0]:
            end, which = p.search(low, s, length, h, before)
            np.add.at(change, end - p.width + 1, 1)
            np.add.at(change, end + 1, -1)
            row = np.searchsorted(before, end, "right") - 1
            c = p.item_count[which]
            pairs.append(np.column_stack([np.repeat(row, c), p.items[ranges(p.item_first[which], c)]]))
        mask = change.cumsum()[:-1] > 0
        found: list[set[str]] = [set(x or ()) for x in batch.column(k).to_pylist()] if carried else [set() for _ in range(rows)]
        for r, i in np.unique(np.concatenate(pairs or [np.zeros((0, 2), np.int64)]), axis=0).tolist():
            found[r].add(ids[i])
        for r, masks in enumerate(batch.column(k + 1).to_pylist() if carried else ()):
            for old in masks or ():
                mask[before[r] : before[r + 1]] |= np.unpackbits(np.frombuffer(old, np.uint8))[: before[r + 1] - before[r]].astype(bool)
        span, count = _spans(mask, s, length, before, off)
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * count)]), pa.int32()), pa.array(span.ravel(), pa.int32()))
        hit = np.diff(np.concatenate([[0], mask.cumsum()])[before])
        bits = [np.packbits(mask[before[r] : before[r + 1]]).tobytes() if hit[r] else None for r in range(rows)]
        return [*batch.columns[:k], pa.array(np.diff(before)), pa.array(hit), pa.array([sorted(x) for x in found], pa.list_(pa.string())), spans, pa.array(bits, pa.binary())]

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long, n_hit long, items array<string>, spans array<int>, mask binary"])
    return map_text(src, [*keep, "__items", "__masks"] if carried else keep, "__t", schema, each, [*keep, "n_words", "n_hit", "items", "spans", "mask"])


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from search()."""
    got = search(docs, benchmark)
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT i, k, array_to_string(w[j:j + k - 1], ' ') AS t FROM (SELECT i, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
q AS (SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
m AS (SELECT r, k, j, i FROM q JOIN p USING (k, t)),
h AS (SELECT r, count(DISTINCT j + o) AS n FROM (SELECT r, j, unnest(range(0, k)) AS o FROM (SELECT DISTINCT r, j, k FROM m)) GROUP BY r),
g AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, i FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(g.n, 0) AS BIGINT) AS n_items, sha256(coalesce(g.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)
"""
