"""Removal of repeated byte strings, with two-stage suffix sorting.

Every byte covered by a string of `width` bytes that starts anywhere else too is removed.  The corpus is cut so that
no machine sorts all of it, without losing a match: of the 64-byte grams in a string of 200 bytes one is designated by
content alone (the least hash, leftmost), so equal strings designate equal grams.  The starts that designate one gram
are a stretch; stretches are brought together by their gram's hash.

* Grams that occur once cannot be in a repeated string: their stretches end there.
* Stretches with equal bytes are collapsed, with their count.  A gram whose stretches are all equal is settled by that.
* The other stretches of a gram are sorted by suffix: suffixes smaller than their successors are sorted directly, the
  others induced by scans over the buckets of first bytes; adjacent common prefixes then give the runs of equal strings,
  and a run that stands for two occurrences or more is repeated.
* Grams with too many unequal stretches for one task are settled string by string, by 128-bit hashes that are counted.

Defined results: null texts are empty; texts shorter than `width` lose nothing; repeated rows, also with equal ids,
count as occurrences of their own; an empty table gives no rows; only the columns asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import U64, map_text, mix, powers, ranges, release, small_batches, stored

GRAM = 64
#: Starts looked at in one piece; longer texts are taken in several.  Bits that number the grams of a piece, which is shorter
#: than 2 ** BITS: the same for pieces of all lengths, so that the gram a string designates does not hang on the piece.
PIECE, BITS = 1 << 19, 20
#: Bytes of stretches sorted at once, and the unequal stretches of one gram up to which it is sorted at all.
SORT_BYTES, MOST_STRETCHES = 1 << 20, 8_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_inverse_powers = np.ones(1, U64)


def _inverses(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        p = np.full(n, _INVERSE, U64)
        p[0] = 1
        _inverse_powers = np.multiply.accumulate(p)
    return _inverse_powers[:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    h, base, span = mix(data.astype(U64) + U64(1)), U64(_BASE), 1
    while span < GRAM:
        h = h[:-span] * base + h[span:]
        base = U64(pow(_BASE, 2 * span, 2**64))
        span *= 2
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def stretches(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after another: text, first start (in the text), further starts, gram hash, bytes' hash."""
    n = np.maximum(0, np.diff(off) - width + 1)
    if len(data) < width or not n.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    h = gram_hashes(data)
    if len(h) >= 1 << BITS:
        raise ValueError(f"pieces must be shorter than {1 << BITS} bytes")
    keyed = h >> U64(BITS) << U64(BITS) | np.arange(len(h), dtype=U64)
    at = (sliding_min(keyed, width - GRAM + 1) & U64((1 << BITS) - 1)).astype(np.int64)
    start = ranges(off[:-1], n)
    gram = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    a, g = start[first], gram[first]
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(mix(data.astype(U64) + U64(0x2545F491)) * powers(len(data)))])
    whole = (prefix[a + size - 1 + width] - prefix[a]) * _inverses(len(data) + 1)[a]
    text = np.searchsorted(off, a, "right") - 1
    return text, a - off[text], size - 1, h[g], mix(whole + size.astype(U64) * U64(_BASE))


class SuffixOrder:
    """A two-stage sort, to a depth of `width` bytes, of the suffixes at given stretches of starts.

    buffer: bytes of all stretches, each followed by more than `width` zero bytes; the whole ends in a byte 255.
    """

    def __init__(self, buffer: np.ndarray, first: np.ndarray, starts: np.ndarray, width: int):
        self.t, self.width = buffer, width
        self.words = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
        n = len(buffer)
        change = np.flatnonzero(buffer[1:] != buffer[:-1]).astype(np.int32)
        run = np.diff(change, prepend=-1, append=n - 1)  # bytes up to each change, and those after the last
        other = np.append(buffer[change + 1], buffer[-1])  # what follows each run of equal bytes
        self.larger = np.repeat(other, run) < buffer  # larger than its successor: to be induced
        self.larger[-1] = False
        small = np.flatnonzero(~self.larger).astype(np.int32)
        last = small[np.searchsorted(small, first + starts - 1)]  # starts go on until one that is sorted directly
        self.inside = np.zeros(n, bool)
        self.inside[ranges(first, last - first + 1)] = True
        self.order = self._induce(self._direct(np.flatnonzero(self.inside & ~self.larger).astype(np.int32)))

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at, len(self.words) - 1)].astype(U64)

    def _direct(self, x: np.ndarray) -> np.ndarray:
        """The directly sorted suffixes: eight bytes at a time, only where a group of equal ones still differs."""
        w = self.word(x)
        o = np.argsort(w)
        x, w = x[o], w[o]
        bound = np.ones(len(x), bool)
        bound[1:] = w[1:] != w[:-1]
        for depth in range(8, self.width, 8):
            tied = ~bound
            tied[:-1] |= tied[1:]
            act = np.flatnonzero(tied)
            if not len(act):
                break
            w = self.word(x[act] + depth)
            split = ~bound[act[1:]] & (w[1:] != w[:-1]) & (act[1:] == act[:-1] + 1)
            if not split.any():
                continue
            group = np.cumsum(bound[act])
            mixed = np.zeros(int(group[-1]) + 1, bool)
            mixed[group[1:][split]] = True
            own = mixed[group]
            act, w, group = act[own], w[own], group[own]
            o = np.lexsort((w, group))
            x[act] = x[act[o]]
            w, group = w[o], group[o]
            bound[act[1:]] |= (w[1:] != w[:-1]) & (group[1:] == group[:-1])
        return x

    def _induce(self, direct: np.ndarray) -> np.ndarray:
        """All suffixes in order: scans over the buckets of first bytes place each larger-than-successor suffix."""
        t = self.t
        larger = np.bincount(t[np.flatnonzero(self.inside & self.larger)], minlength=256)
        smaller = np.bincount(t[direct], minlength=256)
        begin = np.concatenate([[0], np.cumsum(larger + smaller)])
        out = np.zeros(int(begin[-1]), np.int32)
        put, taken = begin[:-1].copy(), 0

        def scan(entries: np.ndarray) -> None:
            before = entries - 1
            before = before[before >= 0]
            before = before[self.inside[before] & self.larger[before]]
            if not len(before):
                return
            byte = t[before]
            o = np.argsort(byte, kind="stable")
            before, byte = before[o], byte[o]
            count = np.bincount(byte, minlength=256)
            out[put[byte] + np.arange(len(byte)) - (np.cumsum(count) - count)[byte]] = before
            np.add(put, count, out=put)

        for c in np.flatnonzero(larger + smaller).tolist():
            at = int(begin[c])
            while at < int(put[c]):  # entries of this bucket may put further ones behind it
                upto = int(put[c])
                scan(out[at:upto])
                at = upto
            own = direct[taken : taken + int(smaller[c])]
            taken += len(own)
            out[int(begin[c]) + int(larger[c]) : int(begin[c + 1])] = own
            scan(own)
        return out

    def same_as_before(self, order: np.ndarray) -> np.ndarray:
        """Whether the common prefix of each entry and the one before reaches `width`."""
        out = np.zeros(len(order), bool)
        live = np.arange(1, len(order))
        for depth in range(0, self.width, 8):
            a, b = self.word(order[live - 1] + depth), self.word(order[live] + depth)
            if self.width - depth < 8:
                keep = U64(64 - 8 * (self.width - depth))
                a, b = a >> keep, b >> keep
            live = live[a == b]
        out[live] = True
        return out


def repeated_starts(parts: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of every stretch (its bytes, and how often it occurs), whether its string occurs twice or more.

    Returns the marks of all stretches one after another, and where each stretch's begin.
    """
    gap = b"\0" * (width + 8)
    buffer = np.frombuffer(b"".join(x for p in parts for x in (p, gap)) + b"\xff" * 8, np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(size + len(gap)) - size - len(gap)
    starts = size - width + 1
    sort = SuffixOrder(buffer, first, starts, width)
    number = np.full(len(buffer), -1, np.int32)
    number[ranges(first, starts)] = np.arange(int(starts.sum()), dtype=np.int32)
    order = sort.order[number[sort.order] >= 0]
    run = np.cumsum(~sort.same_as_before(order)) - 1
    weight = np.repeat(counts, starts)[number[order]]
    total = np.bincount(run, weight)
    out = np.zeros(len(order), bool)
    out[number[order]] = total[run] >= 2
    return out, np.cumsum(starts) - starts


def _runs(mark: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marks that do not cross the given beginnings: which part, first and last place in it."""
    opens, closes = mark.copy(), mark.copy()
    opens[1:] &= ~mark[:-1]
    closes[:-1] &= ~mark[1:]
    inner = begin[1:]
    opens[inner] = mark[inner]
    closes[inner - 1] = mark[inner - 1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    part = np.searchsorted(begin, a, "right") - 1
    return part, a - begin[part], b - begin[part]


def _anchored(docs: DataFrame, text: str, width: int) -> DataFrame:
    """h, f, row, a, more: gram, bytes' hash, text row, first start and further starts of every stretch."""

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array] | None:
        row = batch.column(0).to_numpy()
        got = []
        if len(off) == 2 and len(data) > PIECE + width:
            for lo in range(0, len(data) - width + 1, PIECE):
                part = data[lo : min(len(data), lo + PIECE + width - 1)]
                t, a, more, h, f = stretches(part, np.array([0, len(part)]), width)
                got.append((t, a + lo, more, h, f))
        else:
            got.append(stretches(data, off, width))
        t, a, more, h, f = (np.concatenate(x) for x in zip(*got, strict=True))
        return [pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(row[t]), pa.array(a.astype(np.int32)), pa.array(more.astype(np.int32))]

    return map_text(docs, ["row"], text, "h long, f long, row long, a int, more int", each)


def _sorted_groups(parts: DataFrame, width: int) -> DataFrame:
    """h, f, s, e: the repeated starts, as places s to e of their stretch, by suffix sorting all stretches of a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            mark, begin = repeated_starts([r[3] for r in held], np.array([r[2] for r in held]), width)
            part, s, e = _runs(mark, begin)
            h, f = (np.array([r[c] for r in held], np.int64)[part] for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(f), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["h", "f", "s", "e"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORT_BYTES and held[-1][0] != r[0]:
                    yield out()
                    held, size = [], 0
                held.append(r)
                size += len(r[3]) + width
        if held:
            yield out()
        release()

    dealt = parts.select("h", "f", "n", "bytes").repartition("h").sortWithinPartitions("h", "f")
    return dealt.mapInArrow(run, "h long, f long, s int, e int")


def _counted_strings(parts: DataFrame, width: int) -> DataFrame:
    """h, f, s, e as _sorted_groups() gives them, for grams with very many stretches: strings are hashed and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, f, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - width + 1)
                two = []
                for seed in (0x2545F491, 0x5851F42D):
                    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(mix(data.astype(U64) + U64(seed)) * powers(len(data)))])
                    two.append(mix((prefix[at + width] - prefix[at]) * _inverses(len(data) + 1)[at]).view(np.int64))
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(two[0]), pa.array(two[1]), pa.array(np.full(k, h)), pa.array(np.full(k, f)), pa.array(np.full(k, n)), pa.array(at.astype(np.int32))], ["x", "y", "h", "f", "n", "s"])

    each = parts.select("h", "f", "n", "bytes").mapInArrow(run, "x long, y long, h long, f long, n long, s int")
    twice = each.groupBy("x", "y").agg(F.sum("n").alias("total")).where("total > 1").select("x", "y")
    return each.join(twice, ["x", "y"]).select("h", "f", "s", F.col("s").alias("e"))


def repeats(docs: DataFrame, text: str, width: int) -> DataFrame:
    """row, covers array<int>: starts and ends, in turn, of the byte ranges that repeated strings cover.  docs has `row`."""
    small_batches(docs.sparkSession)
    found = _anchored(docs, text, width)
    grams = found.groupBy("h").agg(F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).where("n > 1")
    grams = stored(grams.select("h", (F.col("lo") != F.col("hi")).alias("mixed")))
    seen = stored(found.join(grams, "h"))
    mixed = seen.where("mixed")
    one = mixed.groupBy("h", "f").agg(F.count("*").alias("n"), F.min(F.struct("row", "a", "more")).alias("one"))
    one = stored(one.select("h", "f", "n", "one.*"))
    fans = one.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    part = F.substring(F.col("__b"), F.col("a") + 1, F.col("more") + width)
    texts = docs.select("row", F.encode(F.col(text), "utf-8").alias("__b")).where(F.octet_length("__b") >= width)
    rest = fans.where("least = 1")  # where every stretch occurs twice, all of it is repeated
    parts = one.join(rest, "h").join(texts, "row").select("h", "f", "n", "k", part.alias("bytes")).dropDuplicates(["h", "f"])
    parts = stored(parts)
    sorted_ = _sorted_groups(parts.where(F.col("k") <= MOST_STRETCHES), width)
    if not parts.where(F.col("k") > MOST_STRETCHES).isEmpty():
        sorted_ = sorted_.union(_counted_strings(parts.where(F.col("k") > MOST_STRETCHES), width))
    # A stretch that occurs once is repeated only in the parts found by sorting; every other one is repeated as a whole.
    single = one.where("n = 1").select("h", "f", "row", "a", "more")
    span = lambda s, e: F.shiftleft(s.cast("long"), 32) + e + width  # noqa: E731  one number, so that sets of spans are hashed
    a, more = F.col("a"), F.col("more")
    own = single.select("row", span(a, a + more).alias("once"))
    found_in = sorted_.join(single, ["h", "f"]).select("row", span(a + F.col("s"), a + F.col("e")).alias("part"))
    all_ = seen.select("row", span(a, a + more).alias("whole"))
    spans = all_.unionByName(own, allowMissingColumns=True).unionByName(found_in, allowMissingColumns=True)
    per = spans.groupBy("row").agg(*(F.collect_set(c).alias(c) for c in ("whole", "once", "part")))
    covers = F.array_union(F.array_except("whole", "once"), F.col("part"))
    ends = lambda x: F.array(F.shiftright(x, 32).cast("int"), x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int"))
    return per.select("row", F.flatten(F.transform(covers, ends)).alias("covers")).where(F.size("covers") > 0)


def remove(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id: str = "doc_id", text: str = "text", width: int = 200) -> DataFrame:
    """keep columns, n_bytes long, kept binary (the bytes left), spans array<int> (start and end of each removed run)."""
    row = F.xxhash64(F.col(f"`{id}`").cast("string"), F.col(f"`{text}`").cast("string"))
    src = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").cast("string").alias("__text"), row.alias("row"))
    covers = stored(repeats(src.select("row", "__text"), "__text", width))
    both = src.join(covers, "row", "left")
    kinds = dict(docs.dtypes)
    k = len(keep)

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        n = len(off) - 1
        lists = batch.column(k).combine_chunks() if isinstance(batch.column(k), pa.ChunkedArray) else batch.column(k)
        lists = lists.fill_null([]) if lists.null_count else lists
        at = np.asarray(lists.offsets).astype(np.int64)
        flat = np.asarray(lists.values)[at[0] : at[-1]].astype(np.int64).reshape(-1, 2)
        doc = np.repeat(np.arange(n), np.diff(at) // 2)
        depth = np.zeros(len(data) + 1, np.int64)
        np.add.at(depth, off[doc] + flat[:, 0], 1)
        np.add.at(depth, off[doc] + flat[:, 1], -1)
        gone = depth.cumsum()[:-1] > 0
        some = off[:-1][np.diff(off) > 0]
        part, s, e = _runs(gone, some) if len(some) else (np.zeros(0, np.int64),) * 3
        part = np.flatnonzero(np.diff(off) > 0)[part]
        count = np.bincount(part, minlength=n)
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * count)]), pa.int32()), pa.array(np.column_stack([s, e + 1]).ravel(), pa.int32()))
        left = np.concatenate([[0], np.cumsum(~gone)])[off]
        kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[~gone].tobytes())])
        return [*batch.columns[:k], pa.array(np.diff(off)), kept, spans]

    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "n_bytes long, kept binary, spans array<int>"])
    out = map_text(both, [f"k{i}" for i in range(k)] + ["covers"], "__text", schema, each, [*(f"k{i}" for i in range(k)), "n_bytes", "kept", "spans"])
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "kept", "spans")


def as_text(removed: DataFrame, keep: list[str], out: str = "text") -> DataFrame:
    """keep columns and `kept` of remove() as a string; bytes of a character that was cut in two are left out."""
    kinds = dict(removed.dtypes)

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        raw = data.tobytes()
        return [*batch.columns[: len(keep)], pa.array([raw[a:b].decode("utf-8", "ignore") for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)], pa.string())]

    return map_text(removed, keep, "kept", ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` string"]), each, [*keep, out])


def digests(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from remove()."""
    got = remove(docs, width=width)
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
