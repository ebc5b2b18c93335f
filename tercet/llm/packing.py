"""Token-id output: best-fit-decreasing packing into fixed-length sequences.

Documents longer than a sequence are split into consecutive chunks, losslessly.  Chunks are taken longest first and
put where they leave the least room; a segment tree over the remaining capacities finds that place in log(length)
steps.  Packing runs within blocks of bounded size inside each task, so nothing is shuffled.

Each packed row holds the ids (padded to the length), the cumulative segment lengths, for every segment its document,
its offset in that document and the position id at which it begins (0 for a document's start).

Defined results: documents without tokens (null or empty) take no place; repeated documents are packed each; an empty
table gives no rows; only the id and ids columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import release, small_batches, utf8

SCHEMA = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Capacities:
    """Bins by remaining capacity, in a segment tree whose nodes count the bins below them."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def put(self, room: int, bin: int) -> None:
        self.bins.setdefault(room, []).append(bin)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of at least `need`, taken out; its room and number."""
        k = need + self.size
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):  # up, until a right sibling has bins
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """The items of every bin, by number; every size is from 1 to `length`."""
    tree, bins = Capacities(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        found = tree.take(n)
        if found is None:
            bins.append([])
            found = length, len(bins) - 1
        room, b = found
        bins[b].append(i)
        if room > n:
            tree.put(room - n, b)
    return bins


def pack(tokens: DataFrame, length: int = 2048, pad: int = 0, end: int | None = None, dtype: str = "<u4", block_tokens: int = 2 << 20, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows of SCHEMA.  ids: little-endian unsigned 32-bit integers; end: an id put after each document with tokens.

    dtype is how packed ids are written; block_tokens, rounded down to whole rows, bounds what a task packs at once.
    """
    small_batches(tokens.sparkSession)
    most_tokens = block_tokens // length * length
    if not most_tokens:
        raise ValueError("block_tokens must hold a row at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 36

        def out(docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            most = max(int(p.max()) for p in parts)
            if most > np.iinfo(dtype).max or not 0 <= pad <= np.iinfo(dtype).max:
                raise ValueError(f"ids up to {most} and the padding {pad} do not fit {dtype}")
            total = np.array([len(p) for p in parts])
            chunks = -(-total // length)
            doc = np.repeat(np.arange(len(parts)), chunks)
            offset = length * (np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
            size = np.minimum(length, total[doc] - offset)
            bins = best_fit_decreasing(size, length)
            grid = np.full((len(bins), length), pad, dtype)
            cum, resets = [], []
            for b, items in enumerate(bins):
                at = 0
                ends = [0]
                for i in items:
                    o = int(offset[i])
                    grid[b, at : at + size[i]] = parts[doc[i]][o : o + int(size[i])]
                    at += int(size[i])
                    ends.append(at)
                cum.append(ends)
                resets.append([int(offset[i]) for i in items])
            first = made
            made += len(bins)
            raw = grid.tobytes()
            step = grid.itemsize * length
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(first, made)), pa.array([c[-1] for c in cum], pa.int32()), pa.array([raw[k * step : (k + 1) * step] for k in range(len(bins))], pa.binary()), pa.array(cum, pa.list_(pa.int32())),
                    pa.array(resets, pa.list_(pa.int32())), pa.array([[docs[doc[i]] for i in b] for b in bins], pa.list_(pa.int64())), pa.array(resets, pa.list_(pa.int64())),
                ],
                _NAMES,
            )

        docs, parts, held = [], [], 0
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw = np.frombuffer(data.tobytes(), "<u4")
            for i, d in enumerate(batch.column(0).to_pylist()):
                own = raw[off[i] // 4 : off[i + 1] // 4]
                if not len(own):
                    continue
                if end is not None:
                    own = np.append(own, np.uint32(end))
                for a in range(0, len(own), most_tokens):  # a document larger than a block goes on in the next
                    if len(own) <= most_tokens:
                        docs.append(d), parts.append(own.copy())
                        held += len(own)
                    else:
                        if parts:
                            yield out(docs, parts)
                            docs, parts, held = [], [], 0
                        yield _shifted(out([d], [own[a : a + most_tokens]]), a)
                if held >= most_tokens:
                    yield out(docs, parts)
                    docs, parts, held = [], [], 0
        if parts:
            yield out(docs, parts)
        docs = parts = None
        release()

    return tokens.select(F.col(f"`{id}`").cast("long"), F.col(f"`{ids}`")).mapInArrow(run, SCHEMA)


def _shifted(batch: pa.RecordBatch, by: int) -> pa.RecordBatch:
    """The rows of a later part of one document, with offsets and positions in the whole of it."""
    if not by:
        return batch
    cols = list(batch.columns)
    cols[4] = pa.array([[x + by for x in r] for r in cols[4].to_pylist()], pa.list_(pa.int32()))
    cols[6] = pa.array([[x + by for x in r] for r in cols[6].to_pylist()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def positions(cu_seqlens: list[int], position_resets: list[int], length: int) -> np.ndarray:
    """The position ids of a packed row; padding counts from 0."""
    out = np.zeros(length, np.int64)
    for a, b, first in zip(cu_seqlens, cu_seqlens[1:], position_resets, strict=False):
        out[a:b] = first + np.arange(b - a)
    out[cu_seqlens[-1] :] = np.arange(length - cu_seqlens[-1])
    return out


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet, one file a task, by Spark's own writer (so a lost task leaves nothing behind)."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)
