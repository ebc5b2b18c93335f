"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Training counts every n-gram of the texts that are learned from.  A task counts its own first, and sends each bucket of keys (a
range of the 64-bit hashes) one packed row; a bucket's task merges them.  Words keep exact counts.  A longer n-gram with count c
goes into the filter 1 + floor(log2 c) times, with the level as part of the key: each bucket of n-grams is a stretch of the
filter, of BITS bits an entry, whose task makes it.  A count is read by probing levels until one is absent; it is 2**(level - 1),
never above the true one but where an absent entry seems to be there (about 2 % of probes).

The probability of a word in context is interpolated from the longest context down, w * c / c_context + (1 - w) * p_shorter, with
the smoothed share of the word at the end.  w depends on the power of two that the context's count lies between.  It maximises
the likelihood of all that was learned, each token left out of the counts that judge it: what matters of a token is the ratio of
both terms, so one pass leaves a histogram of ratios for each w, of fixed size, on which it is found by expectation maximisation.
Counts of n-grams are rounded down and those of contexts, where they are not exact, up: probabilities of all words sum up to one
at most, but for false positives.

The model (12 bytes a word, about 1.6 an n-gram) is a stage table in the shared folder, which tasks read; it never passes through
the driver.  If it takes `most_bytes` at most, a task holds it whole.  Of a larger one a task holds one bucket at a time: it
collects and sorts the keys of ASKED tokens, and each bucket that it reads answers those that are its own.  Nothing is shuffled for
that, and nothing written.  Where tasks cannot open the folder, the model stays in its buckets: distinct keys go to the buckets, are
answered by the same probes, and are joined back.  All three ways give the same scores.

Defined results: null and empty texts are one token, the end; a text without an id is scored and not learned from; words are
maximal runs of other than white space, A-Z lowered; repeated rows count each time; where nothing is learned from, N = V = 0
and every token has probability 1 (0.1 / 0.1); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import BLOCK_BYTES, U64, blocks, lower_ascii, mix, reachable, release, small_batches, stored, utf8, words

#: Bits of the filter for each entry, and how many of a 64-bit cell an entry sets.
BITS, HASHES = 10, 5
#: Tokens counted in a task before they are sent on, and about as many as a bucket may get in all.
FLUSH, BUCKET = 2_000_000, 4_000_000
#: A model of up to this size is read whole by tasks.
MOST_BYTES = 256 << 20
#: Of such a model, what answers together.
PART_BYTES = 8 << 20
#: Tokens that a task asks a larger one for at once, while it reads it.
ASKED = 4_000_000
#: What a word is counted more than it was seen.
ADD = 0.1
#: Sizes of the histogram that weights come from: powers of two of a context's count; ratios, a quarter of an octave each.
POWERS, RATIOS = 64, 256
END = U64(0x5DEECE66D1234567)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(256, dtype=U64) + U64(0x51ED27))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and of its inverse."""
    p, q = np.full(n, _BASE, U64), np.full(n, pow(_BASE, -1, 1 << 64), U64)
    p[:1] = q[:1] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


_UP, _DOWN = _powers(2 * BLOCK_BYTES)


def _word_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    up, down = (_UP, _DOWN) if len(data) <= len(_UP) else _powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[starts + lengths] - total[starts]) * down[starts] + lengths.astype(U64))


def word_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: differences of running sums of byte terms, shifted to the word's own origin.

    A long text is hashed by stretches of whole words.
    """
    parts, lo = [], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts + lengths, starts[lo] + BLOCK_BYTES, "right")))
        parts.append(_word_keys(data[starts[lo] : starts[hi - 1] + lengths[hi - 1]], starts[lo:hi] - starts[lo], lengths[lo:hi]))
        lo = hi
    return np.concatenate(parts) if parts else np.zeros(0, U64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all tokens, each text's end last, and the text's first place for each text and one more."""
    low = lower_ascii(data)
    s, length, before = words(low, offsets, _IS_WORD)
    first = before + np.arange(len(before))
    keys = np.full(first[-1], END, U64)
    at = np.ones(len(keys), bool)
    at[first[1:] - 1] = False
    keys[at] = word_keys(low, s, length)
    return keys, first


def ngrams(keys: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 2 on: the key of the n-gram that ends at each token, and whether it lies within the text.

    An end stands for the start of a text too, as the word before its first.
    """
    before = np.concatenate([[END], keys[:-1]])
    place = np.arange(len(keys)) - np.repeat(first[:-1], np.diff(first))
    out, longer = [], keys
    for n in range(2, order + 1):
        longer = mix(longer * U64(0xD6E8FEB86659FD93) + mix(before + U64(n)))
        before = np.concatenate([[END], before[:-1]])
        out.append((longer, place >= n - 2))
    return out


def contexts(keys: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length from 2 on, the key of the context: a word, or the n-gram that ends one token before."""
    shifted = [np.concatenate([[END], keys[:-1]])]
    return (shifted + [np.concatenate([[U64(0)], k[:-1]]) for k, _ in ngrams(keys, first, order - 1)])[: order - 1]


def levels(counts: np.ndarray) -> np.ndarray:
    """How many entries a count makes: 1 + floor(log2 count); none for 0."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(float))[1], 0)


def _cells(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for the cell of each entry, and the bits that it sets there."""
    h = mix(keys + U64(0x632BE59BD9B4E019) * np.asarray(level, U64))
    bits, mask = mix(h ^ U64(0xA0761D6478BD642F)), np.zeros(len(h), U64)
    for k in range(HASHES):
        mask |= U64(1) << ((bits >> U64(6 * k)) & U64(63))
    return h >> U64(32), mask


def build(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretch of the filter for one bucket: 64-bit cells."""
    level = levels(counts)
    cells = np.zeros(max(1, -(-int(level.sum()) * BITS // 64)), U64)
    for k in range(1, int(level.max(initial=0)) + 1):
        cell, mask = _cells(keys[level >= k], k)
        np.bitwise_or.at(cells, (cell * U64(len(cells)) >> U64(32)).astype(np.int64), mask)
    return cells


def probe(keys: np.ndarray, filter: np.ndarray, offsets: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The level of each key in the stretch of its bucket: how many levels from 1 on seem to be there, one after another."""
    out, left = np.zeros(len(keys), np.int8), np.arange(len(keys))
    sizes = np.diff(offsets)
    left = left[sizes[bucket] > 0]
    level = 0
    while len(left):
        level += 1
        cell, mask = _cells(keys[left], level)
        b = bucket[left]
        got = filter[offsets[b] + (cell * sizes[b].astype(U64) >> U64(32)).astype(np.int64)]
        left = left[(got & mask) == mask]
        out[left] = level
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def counted(docs: DataFrame, text: str, order: int, buckets: int) -> DataFrame:
    """n, bucket, keys, counts: what tasks have counted, packed; a key comes once from each flush of a task."""

    def merge(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for n, keys in enumerate(parts, 1):
            u, c = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, U64), np.zeros(0, np.int64))
            cut = np.searchsorted(_bucket(u, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(full), n), pa.int32()), pa.array(full, pa.int32()),
                pa.array([u[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()), pa.array([c[cut[b] : cut[b + 1]].astype("<u4").tobytes() for b in full], pa.binary()),
            ], ["n", "bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [[] for _ in range(order)], 0
        for batch in batches:
            data, off = utf8(batch.column(0))
            for lo, hi in blocks(off):
                keys, first = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                parts[0].append(keys)
                for n, (longer, inside) in enumerate(ngrams(keys, first, order), 1):
                    parts[n].append(longer[inside])
                held += len(keys)
                if held >= FLUSH:
                    yield from merge(parts)
                    parts, held = [[] for _ in range(order)], 0
        yield from merge(parts)
        release()

    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{text}`").alias("__text")).mapInArrow(run, "n int, bucket int, keys binary, counts binary")


MODEL = "n int, bucket int, keys binary, counts binary, cells binary, total long, types long"


def _merged(group: pa.Table) -> pa.Table:
    n, b = group.column(0)[0].as_py(), group.column(1)[0].as_py()
    keys = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in group.column(2)])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in group.column(3)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[at], np.add.reduceat(counts, at)
    exact = (keys.tobytes(), counts.astype("<u8").tobytes(), None) if n == 1 else (None, None, build(keys, counts).tobytes())
    row = (n, b, *exact, int(counts.sum()), len(keys))
    names = [x.split()[0] for x in MODEL.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)


@dataclass(frozen=True)
class Model:
    """A trained model: its table (MODEL, a row for each length and bucket), and what is known of all rows.

    weights: for each length from 2 on, the weight of the n-gram's own term by the power of two of its context's count.
    folder: the folder that tasks read the model from, if they can open it, else empty.
    sent: the same for a model that is small enough to be read whole, else empty.
    asked: tokens that a task asks a larger one for at once.
    """

    table: DataFrame
    order: int
    buckets: int
    total: int
    types: int
    n_bytes: int
    weights: tuple[np.ndarray, ...] = ()
    sent: str = ""
    folder: str = ""
    asked: int = ASKED


def train(docs: DataFrame, text: str = "text", order: int = 2, most_bytes: int = MOST_BYTES) -> Model:
    """Counts all rows of `docs`, and weighs the lengths on all of them."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")) + 8)).first()[0] or 0
    buckets = max(8, -(-size // (4 * BUCKET)))  # at least four bytes a token
    rows = counted(docs, text, order, buckets)
    table = stored(rows.groupBy("n", "bucket").applyInArrow(_merged, MODEL), "none")  # keys and cells hardly shrink, and are read often
    size_of = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("keys", "counts", "cells")), F.lit(0))
    found = {r.n: r for r in table.groupBy("n").agg(F.sum("total").alias("total"), F.sum("types").alias("types"), F.sum(size_of).alias("size")).collect()}
    one = found.get(1)
    model = Model(table, order, buckets, one.total if one else 0, one.types if one else 0, sum(r.size for r in found.values()))
    if reachable(table.stored_at):
        model = replace(model, folder=table.stored_at, sent=table.stored_at if model.n_bytes <= most_bytes else "")
    for _ in range(2, order + 1):  # a longer n-gram is weighed against what the shorter ones say
        got = _with_counts(docs.select(F.col(f"`{text}`").alias("__text")), model, [], _ratios, "power int, ratio int, times long")
        seen = np.zeros((POWERS, RATIOS))
        for r in got.groupBy("power", "ratio").agg(F.sum("times").alias("times")).collect():  # POWERS * RATIOS rows at most
            seen[r.power, r.ratio] = r.times
        model = replace(model, weights=(*model.weights, weigh(seen)))
    return model


def weigh(seen: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The weight of each power of two: that of the likeliest mixture, given how often each ratio of its terms was seen."""
    ratio = np.concatenate([[0.0], np.exp2((np.arange(1, RATIOS) + 0.5) / 4 - 24)])
    w, n = np.full(len(seen), 0.5), seen.sum(1)
    for _ in range(rounds):
        own = w[:, None] * ratio
        w = ((seen * own / (own + 1 - w[:, None])).sum(1) + 0.05) / (n + 0.1)
    full = np.flatnonzero(n)
    if not len(full):
        return np.zeros(len(seen))
    nearest = full[np.abs(np.arange(len(seen))[:, None] - full).argmin(1)]  # powers that were not seen take the nearest one's
    return np.minimum(w, 1 - 1e-6)[nearest]


Part = tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray, list[int]]  # n, buckets, keys, counts, cells, cells a bucket


def exact_counts(keys: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each key among sorted `words`, or 0."""
    if not len(words):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
    return np.where(words[at] == keys, counts[at], 0).astype(np.int64)


@dataclass(frozen=True)
class Loaded:
    """A model's parts, as workers hold them: each answers for the keys of its buckets, where it lies."""

    parts: list[Part]
    buckets: int

    def _answers(self, n: int, keys: np.ndarray, answer: Callable) -> np.ndarray:
        out, bucket = np.zeros(len(keys), np.int64), _bucket(keys, self.buckets)
        for p in self.parts:
            if p[0] == n:
                own = np.flatnonzero((bucket >= p[1][0]) & (bucket <= p[1][-1]))
                out[own] = answer(p, keys[own], bucket[own])
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        return self._answers(1, keys, lambda p, k, _: exact_counts(k, p[2], p[3]))

    def level(self, n: int, keys: np.ndarray) -> np.ndarray:
        def answer(p: Part, k: np.ndarray, bucket: np.ndarray) -> np.ndarray:
            sizes = np.zeros(p[1][-1] - p[1][0] + 1, np.int64)
            sizes[np.array(p[1]) - p[1][0]] = p[5]
            return probe(k, p[4], np.concatenate([[0], sizes.cumsum()]), bucket - p[1][0])

        return self._answers(n, keys, answer)


def _rows(folder: str) -> Iterator[dict]:
    """n, bucket, keys, counts, cells of each bucket of the model in `folder`, read one by one."""
    where, path = fs.FileSystem.from_uri(folder)
    for file in ds.dataset(path, format="parquet", filesystem=where).files:
        with where.open_input_file(file) as f, pq.ParquetFile(f) as own:
            for batch in own.iter_batches(1, columns=["n", "bucket", "keys", "counts", "cells"], use_threads=False):
                yield from batch.to_pylist()


def load(folder: str) -> list[Part]:
    """The model in `folder`, in parts of about PART_BYTES: buckets that follow one another."""
    rows = list(_rows(folder))
    rows.sort(key=lambda r: (r["n"], r["bucket"]), reverse=True)
    narrow = lambda c: c.astype("<u4") if c.max(initial=0) < 1 << 32 else c
    out, size_of = [], lambda r: sum(len(r[c] or b"") for c in ("keys", "counts", "cells"))
    while rows:
        here = [rows.pop()]
        held = size_of(here[0])
        while rows and rows[-1]["n"] == here[0]["n"] and held + size_of(rows[-1]) <= PART_BYTES:
            held += size_of(rows[-1])
            here.append(rows.pop())
        join = lambda k, kind: np.concatenate([np.frombuffer(r[k] or b"", kind) for r in here])  # noqa: E731, B023
        out.append((here[0]["n"], [r["bucket"] for r in here], join("keys", U64), narrow(join("counts", "<u8")), join("cells", U64), [len(r["cells"] or b"") // 8 for r in here]))
    return out


def answered(n: int, keys: np.ndarray, row: dict) -> np.ndarray:
    """What a bucket's row of the model says of `keys`: exact counts of words (n = 1), or levels of n-grams."""
    if n == 1:
        return exact_counts(keys, np.frombuffer(row["keys"], U64), np.frombuffer(row["counts"], "<u8"))
    cells = np.frombuffer(row["cells"], U64)
    return probe(keys, cells, np.array([0, len(cells)]), np.zeros(len(keys), np.int64))


def ask(folder: str, buckets: int, keys: list[np.ndarray]) -> list[np.ndarray]:
    """The answers to the `keys` of each length, in any order, of which one bucket of the model in `folder` is held at a time."""
    orders = [np.argsort(k) for k in keys]
    keys = [k[order] for k, order in zip(keys, orders, strict=True)]
    values = [np.zeros(len(k), np.int8 if n else np.int64) for n, k in enumerate(keys)]
    cuts = [np.searchsorted(_bucket(k, buckets), np.arange(buckets + 1)) for k in keys]
    for row in _rows(folder):
        n, b = row["n"], row["bucket"]
        own = slice(cuts[n - 1][b], cuts[n - 1][b + 1])
        values[n - 1][own] = answered(n, keys[n - 1][own], row)
    for order, value in zip(orders, values, strict=True):
        value[order] = value.copy()
    return values


def interpolated(share: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: tuple[np.ndarray, ...]) -> np.ndarray:
    """The probability of each token from its smoothed share and, for each longer length, the n-gram's count, its context's count,
    and whether it lies within the text."""
    p = share
    for (count, context, inside), w in zip(found, weights, strict=False):
        own = w[np.minimum(levels(context), POWERS - 1)] * inside * (context > 0)
        p = own * np.minimum(count, context) / np.maximum(context, 1) + (1 - own) * p
    return p


def _shares(model: Model, count: np.ndarray, less: int = 0) -> np.ndarray:
    return (np.maximum(count - less, 0) + ADD) / (max(model.total - less, 0) + ADD * (model.types + 1))


def _ratios(model: Model, count: np.ndarray, found: list[tuple], times: np.ndarray, starts: np.ndarray | None) -> pd.DataFrame:
    """power, ratio, times of the first length without weights, each token left out of all counts."""
    found = [(np.maximum(c - 1, 0), np.maximum(m - 1, 0), inside) for c, m, inside in found]
    c, m, inside = found[len(model.weights)]
    p = interpolated(_shares(model, count, 1), found, model.weights)
    use = inside & (m > 0)
    c, m, p = c[use], m[use], p[use]
    with np.errstate(divide="ignore"):
        ratio = np.where(c > 0, np.clip(np.floor((np.log2(np.minimum(c, m) / m / p) + 24) * 4), 1, RATIOS - 1), 0).astype(np.int64)
    cell = np.bincount(np.minimum(levels(m), POWERS - 1) * RATIOS + ratio, times[use], POWERS * RATIOS)
    full = np.flatnonzero(cell)
    return pd.DataFrame({"power": full // RATIOS, "ratio": full % RATIOS, "times": cell[full].astype(np.int64)})


def _sums(model: Model, count: np.ndarray, found: list[tuple], times: np.ndarray, starts: np.ndarray | None) -> pd.DataFrame:
    """n_tokens, n_known, base_score, score from each of `starts` to the next, or of each row."""
    share = _shares(model, count)
    cols = (times, times * (count > 0), times * np.log10(share), times * np.log10(interpolated(share, found, model.weights)))
    add = lambda x: x if starts is None else np.add.reduceat(x, starts)
    return pd.DataFrame(dict(zip(("n_tokens", "n_known", "base_score", "score"), map(add, cols), strict=True)))


def read_counts(level: np.ndarray) -> np.ndarray:
    """Counts of n-grams, rounded down."""
    return np.where(level > 0, np.exp2(level - 1.0), 0.0)


def context_counts(level: np.ndarray) -> np.ndarray:
    """Counts of contexts, rounded up."""
    return np.exp2(level.astype(float)) - 1.0


SUMS = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, n_tokens, n_known long, base_score, score double (log10 probabilities of the whole text)."""
    kinds = dict(docs.dtypes)
    held = {f"__k{i}": c for i, c in enumerate(keep)}
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in held.items()), F.col(f"`{text}`").alias("__text"))
    back = [F.col(k).alias(c) for k, c in held.items()]
    if model.folder:
        schema = ", ".join([*(f"{k} {kinds[c]}" for k, c in held.items()), SUMS])
        return _here(rows, model, list(held), _sums, schema).select(*back, *_names(SUMS))
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()))
    sums = _apart(rows, model, ["__row"], _sums, f"__row long, {SUMS}").groupBy("__row").agg(*(F.sum(c).alias(c) for c in _names(SUMS)))
    return rows.drop("__text").join(sums, "__row").select(*back, *_names(SUMS))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _with_counts(rows: DataFrame, model: Model, keep: list[str], each: Callable, schema: str) -> DataFrame:
    return (_here if model.folder else _apart)(rows, model, keep, each, schema)


def _here(rows: DataFrame, model: Model, keep: list[str], each: Callable, schema: str) -> DataFrame:
    """Rows of each(model, count, found, times, starts) over blocks of whole texts, with the model read by every task: once, to be
    held whole, or once for each `asked` tokens, a bucket at a time.

    rows: keep columns and __text; keep columns come back where there are any: then each() gives a row for each text.
    """
    bare, names = replace(model, table=None), _names(schema)

    def told(own: list, first: np.ndarray, inside: list[np.ndarray], end: int, values: list[np.ndarray]) -> pa.RecordBatch:
        count, context, found = values[0], np.concatenate([[end], values[0][:-1]]).astype(float), []
        for level, within in zip(values[1:], inside, strict=True):
            found.append((read_counts(level), context, within))
            context = np.concatenate([[0.0], context_counts(level)[:-1]])
        got = each(bare, count, found, np.ones(len(count), np.int64), first[:-1])
        return pa.RecordBatch.from_arrays([*own, *pa.RecordBatch.from_pandas(got, preserve_index=False).columns], names)

    def of_whole(m: Loaded, keys: np.ndarray, longer: list[np.ndarray]) -> list[np.ndarray]:
        u, back = np.unique(keys, return_inverse=True)
        return [m.count(u)[back], *(m.level(n, k) for n, k in enumerate(longer, 2))]

    def of_buckets(held: list[tuple], asked: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        asked[0].append(np.array([END]))
        joined = [np.concatenate(asked.pop(0)) for _ in range(len(asked))]  # what is joined is not held twice
        values, lo = ask(bare.folder, bare.buckets, joined), 0
        del joined
        for own, first, inside in held:
            yield told(own, first, inside, values[0][-1], [v[lo : lo + first[-1]].astype(np.int64) for v in values])
            lo += first[-1]

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Loaded(load(bare.sent), bare.buckets) if bare.sent else None
        held, asked, n_asked = [], [[] for _ in range(bare.order)], 0
        for batch in batches:
            data, off = utf8(batch.column(len(keep)))
            for lo, hi in blocks(off):
                keys, first = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                longer = ngrams(keys, first, bare.order)
                own, inside = batch.slice(lo, hi - lo).columns[: len(keep)], [within for _, within in longer]
                if whole:
                    yield told(own, first, inside, whole.count(np.array([END]))[0], of_whole(whole, keys, [k for k, _ in longer]))
                    continue
                held.append((own, first, inside))
                for into, k in zip(asked, [keys, *(k for k, _ in longer)], strict=True):
                    into.append(k)
                n_asked += len(keys)
                if n_asked >= bare.asked:
                    yield from of_buckets(held, asked)
                    held, asked, n_asked = [], [[] for _ in range(bare.order)], 0
        if held:
            yield from of_buckets(held, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if keep:
            yield from answers(batches)
        else:
            parts = []
            for got in answers(batches):
                parts.append(got.to_pandas())
                parts = [pd.concat(parts).groupby(names[:-1], as_index=False).sum()] if len(parts) > 50 else parts
            if parts:
                whole = pd.concat(parts).groupby(names[:-1], as_index=False).sum()
                yield pa.RecordBatch.from_arrays([pa.array(whole[c], pa.int64() if c == names[-1] else pa.int32()) for c in names], names)
        release()

    small_batches(rows.sparkSession)
    return rows.select(*keep, "__text").mapInArrow(run, schema)


def _apart(rows: DataFrame, model: Model, keep: list[str], each: Callable, schema: str) -> DataFrame:
    """As _here(), with the model in its buckets, by one key `keep` (or none); each() gives a row for each row that it gets.

    A text's distinct n-grams are rows; the distinct keys of all texts are answered by the buckets, and joined back.
    """
    order, buckets, bare, out_names = model.order, model.buckets, replace(model, table=None), _names(schema)
    ask = ["w0", *(x for n in range(2, order + 1) for x in (f"c{n}", f"w{n}"))]  # word; context and n-gram of each length
    names = [*keep, *ask, "inside", "times"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(len(keep)))
            for lo, hi in blocks(off):
                keys, first = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                longer = ngrams(keys, first, order)
                cols = [keys, *(x for c, (g, _) in zip(contexts(keys, first, order), longer, strict=True) for x in (c, g))]
                frame = pd.DataFrame({k: v.view(np.int64) for k, v in zip(ask, cols, strict=True)})
                for k, name in enumerate(keep):
                    frame.insert(k, name, np.repeat(batch.column(k).slice(lo, hi - lo).to_numpy(zero_copy_only=False), np.diff(first)))
                frame["inside"] = sum(ok.astype(np.int64) << k for k, (_, ok) in enumerate(longer)) if longer else 0
                got = frame.groupby(names[:-1], sort=False).size().rename("times").reset_index()
                yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    small_batches(rows.sparkSession)
    asked = stored(rows.select(*keep, "__text").mapInArrow(split, ", ".join(f"{c} long" for c in names)))

    def answers(n: int, column: str, out: str) -> DataFrame:
        """`column`, `out`: the exact count of each distinct word (n = 1), or the level of each distinct n-gram."""
        at = F.floor(F.pmod(F.shiftrightunsigned(F.col(column), 32), F.lit(1 << 32)) * buckets / float(1 << 32)).cast("int")
        keys = asked.select(column).distinct().withColumn("bucket", at)
        own = model.table.where(F.col("n") == n).select("bucket", "keys", "counts", "cells")

        def reply(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            k = mine.column(column).to_numpy().view(U64)
            value = np.zeros(len(k), np.int64)
            if theirs.num_rows and len(k):
                value = answered(n, k, {c: theirs.column(c)[0].as_py() for c in ("keys", "counts", "cells")}).astype(np.int64)
            return pa.table({column: k.view(np.int64), out: value})

        return keys.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(reply, f"{column} long, {out} long")

    got = asked.join(answers(1, "w0", "n0"), "w0")
    for n in range(2, order + 1):
        got = got.join(answers(max(1, n - 1), f"c{n}", f"m{n}"), f"c{n}").join(answers(n, f"w{n}", f"n{n}"), f"w{n}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pandas()
            inside, found = x["inside"].to_numpy(), []
            for n in range(2, order + 1):
                context = x[f"m{n}"].to_numpy()
                found.append((read_counts(x[f"n{n}"].to_numpy()), context.astype(float) if n == 2 else context_counts(context), (inside >> (n - 2) & 1).astype(bool)))
            told = each(bare, x["n0"].to_numpy(), found, x["times"].to_numpy(), None)
            for k, name in enumerate(keep):
                told.insert(k, name, x[name])
            yield pa.RecordBatch.from_arrays([pa.array(told[c], kind) for c, kind in zip(out_names, kinds, strict=True)], out_names)

    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]
    return got.mapInArrow(run, schema)
