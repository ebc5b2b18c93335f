"""Exact top-k inner-product search with vector-approximation files.

Vectors are packed into blocks, twice: the exact file, and the approximation file, which has one byte a component, the number
of its cell among CELLS of equal width between the block's least and greatest value.  A cell bounds a component, so cells
bound a query's score from above and below.

1. A scan of the approximation file finds for every query the k-th best lower bound, ties by the smaller id: its bar.
2. A second scan names the vectors whose upper bound reaches the bar of some query of a group.
3. Those exact vectors alone are read, a query's in the order of their upper bounds, until no bound reaches its k-th result.

Queries come in groups, each of which meets every block once, spread over slots.  A slot hands on one row of results for a
query or one of marks for a block, never pairs, so that crowds of equal or similar vectors cost no more than others.

Defined results: vectors that are null, or hold a null or non-finite component, and rows with a null id, take no
part; only vectors of one length compete; equal scores go to the smaller id, then to the earlier row; repeated rows are
rows of their own (a query is only barred from itself); an empty table gives no rows; scores beyond 64 bits
are held at the range's ends.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tercet.llm.common import ranges, release, small_batches, stored

#: Rows of a block, queries of a group, cells of a component.
BLOCK, GROUP, CELLS = 2048, 1024, 256
_PACKED = "block long, dim int, n int, ids binary, vectors binary"
_FILE = "block long, dim int, n int, ids binary, cells binary, low binary, width binary"


def pack(vectors: DataFrame, scale: float, id: str, vector: str) -> DataFrame:
    """Blocks of at most BLOCK usable vectors of one length, components floor(scale * x) as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int, rows: int) -> pa.RecordBatch:
            nonlocal made
            ids, v = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            if len(ids) > rows:
                held[dim] = [(ids[rows:], v[rows:])]
            made += 1
            block = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([dim], pa.int32()), pa.array([min(rows, len(ids))], pa.int32()), pa.array([ids[:rows].astype("<i8").tobytes()]), pa.array([v[:rows].astype("<f8").tobytes()])], ["block", "dim", "n", "ids", "vectors"])

        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            valid = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
            flat = lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()] if len(lists) else lists.values
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            first = np.cumsum(size) - size
            valid &= bad[first + size] == bad[first]
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(size[valid]).tolist():
                rows = np.flatnonzero(valid & (size == dim))
                v = np.floor(scale * x[ranges(first[rows], size[rows])]).reshape(len(rows), dim)
                held.setdefault(dim, []).append((number[rows], v))
                while sum(len(i) for i, _ in held.get(dim, ())) >= BLOCK:
                    yield out(dim, BLOCK)
        for dim in list(held):
            yield out(dim, BLOCK)

    usable = vectors.select(F.col(f"`{id}`").cast("long"), F.col(f"`{vector}`"))
    return usable.mapInArrow(run, _PACKED)


#: Pairs merged into results at once.
PAIRS = 1 << 20
#: The score of a place that is not taken; true scores are kept above it.
NONE = np.iinfo(np.int64).min + 1


class Results:
    """The k best of every query of a group so far: scores descending, ids ascending."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        touched = np.unique(row)
        if not len(touched):
            return
        row = np.concatenate([row, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        id = np.concatenate([id, self.id[touched].ravel()])
        o = np.lexsort((id, -score, row))
        row = row[o]
        first = np.searchsorted(row, touched)
        best = o[first[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched] = score[best], id[best]

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1]


def approximate(packed: DataFrame) -> DataFrame:
    """The approximation file of packed vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, n, ids, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells, low, width = quantise(np.frombuffer(raw, "<f8").reshape(n, dim))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([dim], pa.int32()), pa.array([n], pa.int32()), *(pa.array([x]) for x in (ids, cells.tobytes(), low.tobytes(), width.tobytes()))], [c.split()[0] for c in _FILE.split(", ")])

    return packed.mapInArrow(run, _FILE)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of whole-numbered components, and each component's least value and width of cells."""
    low = v.min(0, initial=np.inf)
    width = np.floor((v.max(0, initial=-np.inf) - low) / CELLS) + 1
    return np.minimum(np.floor((v - low) / width), CELLS - 1).astype(np.uint8), low, width


class Bounds:
    """Upper and lower bounds of the scores of queries with the vectors of a block, from its cells.

    Doubles may round scores beyond 2 ** 52; bounds are then widened by what rounding can amount to.
    """

    def __init__(self, q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray):
        base = q @ (low + cells * width).T
        slack = width - 1
        most = (np.abs(q) @ (np.abs(low) + width * CELLS))[:, None]
        err = np.where(most < 2.0**52, 0.0, most * 2.0**-50 * (q.shape[1] + 2))
        self.upper = base + (np.maximum(q, 0) @ slack)[:, None] + err
        self.lower = base + (np.minimum(q, 0) @ slack)[:, None] - err


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of pairs of whole-numbered vectors, in 64 bits, held at the ends of their range."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0))
    if most * max(1, q.shape[1]) < 2.0**52:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    top = 2**63 - 1  # doubles would not be exact: whole numbers instead
    return np.array([max(2 - top, min(top, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for a, b in zip(q, v, strict=True)], np.int64).reshape(-1)


def lower_bounds(q: np.ndarray, q_at: np.ndarray, block: tuple, v_at: np.ndarray, v_id: np.ndarray, best: Results) -> None:
    """Brings the lower bounds of a block's vectors into `best`.  q_at, v_at: which row each is, so that none meets itself."""
    low = np.clip(Bounds(q, *block).lower, -(2.0**63) + 4096, 2.0**63 - 4096)
    low[q_at[:, None] == v_at[None, :]] = -np.inf
    bar = best.kth.astype(float)
    n = low.shape[1]
    if n > best.k:
        bar = np.maximum(bar, np.partition(low, n - best.k, 1)[:, n - best.k])
    row, col = np.nonzero((low >= bar[:, None]) & (low > -np.inf))
    for lo in range(0, len(row), PAIRS):
        r, c = row[lo : lo + PAIRS], col[lo : lo + PAIRS]
        best.add(r, np.floor(low[r, c]).astype(np.int64), v_id[c])


def reached(q: np.ndarray, q_at: np.ndarray, block: tuple, v_at: np.ndarray, v_id: np.ndarray, score: np.ndarray, id: np.ndarray) -> np.ndarray:
    """Which vectors of a block may beat or be the bar (score, id) of a query that is not themselves."""
    upper = Bounds(q, *block).upper
    bar = score.astype(float)[:, None]
    return ((upper > bar) | (upper == bar) & (v_id[None, :] <= id[:, None]) & (q_at[:, None] != v_at[None, :])).any(0)


def scan(q: np.ndarray, q_at: np.ndarray, v: np.ndarray, block: tuple, v_at: np.ndarray, v_id: np.ndarray, best: Results) -> None:
    """Brings exact vectors into `best`: every query's in the order of their upper bounds, until it is certain."""
    upper, k = Bounds(q, *block).upper, best.k
    row, col = np.nonzero((upper >= best.kth.astype(float)[:, None]) & (q_at[:, None] != v_at[None, :]))
    o = np.lexsort((-upper[row, col], row))
    row, col = row[o], col[o]
    bound = upper[row, col]
    turn = np.arange(len(row)) - np.searchsorted(row, row)
    step = 0
    while len(row):
        now = turn < (step + 1) * 2 * k
        r, c = row[now], col[now]
        best.add(r, exact_scores(q[r], v[c]), v_id[c])
        left = ~now & (bound >= best.kth[row])
        row, col, bound, turn = row[left], col[left], bound[left], turn[left]
        step += 1


_QUERY, _BAR, _BLOCK = 0, 1, 2


def _meet(rows: DataFrame, parts: int, begin: Callable, each: Callable, end: Callable, schema: str) -> DataFrame:
    """Groups of queries with the blocks of their slot, which are streamed.

    begin(queries, bars) makes a group's state of its first rows; each(state, row) may give a list of columns for a block,
    end(state) one for the group.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, state = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            out = end(state) if state is not None else None
            if out is not None:
                yield pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["dim"], r["g"], r["slot"]) != now:
                    yield from close()
                    now, first, state = (r["dim"], r["g"], r["slot"]), [], None
                if r["kind"] != _BLOCK:
                    first.append(r)
                    continue
                if state is None and first:
                    state = begin(first)
                out = each(state, r) if state is not None else None
                if out is not None:
                    yield pa.RecordBatch.from_arrays(out, names)
        yield from close()
        release()

    return rows.repartition(parts, "dim", "g", "slot").sortWithinPartitions("dim", "g", "slot", "kind", "block").mapInArrow(run, schema)


def _queries(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, places and vectors of a group's queries, in the order of their places."""
    own = [r for r in rows if r["kind"] == _QUERY]
    ids, at = (np.concatenate([np.frombuffer(r[c], "<i8") for r in own]) for c in "ab")
    return ids, at, np.concatenate([np.frombuffer(r["c"], "<f8").reshape(r["n"], r["dim"]) for r in own])


def _cells(r: dict) -> tuple[tuple, np.ndarray, np.ndarray]:
    """A row of the approximation file: its block, its vectors' places and ids."""
    block = np.frombuffer(r["b"], np.uint8).reshape(r["n"], r["dim"]), np.frombuffer(r["c"], "<f8"), np.frombuffer(r["d"], "<f8")
    return block, (r["block"] << 16) + np.arange(r["n"]), np.frombuffer(r["a"], "<i8")


def search(vectors: DataFrame, every: int, k: int = 20, scale: float = 64.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score long: for every row whose id is divisible by `every`, the k best
    other rows by the inner product of components floor(scale * x)."""
    spark = vectors.sparkSession
    small_batches(spark)
    packed = stored(pack(vectors, scale, id, vector))
    file = stored(approximate(packed))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, n, ids, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = np.frombuffer(ids, "<i8")
                own = np.flatnonzero(number % every == 0)
                if len(own):
                    v = np.frombuffer(raw, "<f8").reshape(n, dim)[own]
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([dim], pa.int32()), pa.array([len(own)], pa.int32()), *(pa.array([x]) for x in (number[own].tobytes(), ((block << 16) + own).tobytes(), v.tobytes()))], ["block", "dim", "n", "a", "b", "c"])

    picked = stored(packed.mapInArrow(pick, "block long, dim int, n int, a binary, b binary, c binary"))
    groups = {r[0]: -(-r[1] // GROUP) for r in picked.groupBy("dim").agg(F.sum("n")).collect()}  # one row a length of vectors
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, -(-tasks // sum(groups.values())))
    parts = min(sum(groups.values()) * slots, 100 * tasks)
    n_groups = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))[F.col("dim")]
    none = F.lit(None).cast("binary")
    slot, all_slots = F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    placed = picked.withColumn("g", F.pmod(F.xxhash64("block"), n_groups).cast("long"))
    queries = placed.select("dim", "g", all_slots, F.lit(_QUERY).alias("kind"), "block", "n", "a", "b", "c", none.alias("d"), none.alias("e"))
    wanted = file.where(F.col("dim").isin(list(groups))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), n_groups.cast("long") - 1)))
    blocks = wanted.select("dim", "g", slot, F.lit(_BLOCK).alias("kind"), "block", "n", F.col("ids").alias("a"), F.col("cells").alias("b"), F.col("low").alias("c"), F.col("width").alias("d"), none.alias("e"))

    def start(rows: list[dict]) -> tuple:
        ids, at, q = _queries(rows)
        return ids, at, q, Results(len(q), k)

    def bound(state: tuple, r: dict) -> None:
        block, v_at, v_id = _cells(r)
        lower_bounds(state[2], state[1], block, v_at, v_id, state[3])

    def results(state: tuple) -> list:
        ids, at, _, best = state
        ok = best.score.ravel() > NONE
        return [pa.array(x[ok]) for x in (np.repeat(at, k), np.repeat(ids, k), best.id.ravel(), best.score.ravel())]

    by_at = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
    partial = _meet(queries.unionByName(blocks), parts, start, bound, results, "at long, query_id long, vec_id long, score long")
    kth = partial.withColumn("rank", F.row_number().over(by_at)).where(F.col("rank") == k).select("at", "score", "vec_id")
    at_group = placed.select("dim", "g", "b").mapInArrow(_places, "dim int, g long, at long")
    bars = at_group.join(kth, "at", "left").groupBy("dim", "g").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("score", F.lit(int(NONE))).alias("score"), F.coalesce("vec_id", F.lit(2**63 - 1)).alias("id")))).alias("x"))  # at most a group's queries
    bars = stored(bars.mapInArrow(_bars, "dim int, g long, a binary, b binary"))
    bar_rows = bars.select("dim", "g", all_slots, F.lit(_BAR).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("n"), "a", "b", none.alias("c"), none.alias("d"), none.alias("e"))

    def with_bars(rows: list[dict]) -> tuple:
        _, at, q = _queries(rows)
        bar = next(r for r in rows if r["kind"] == _BAR)
        order = np.argsort(at)
        return at[order], q[order], np.frombuffer(bar["a"], "<i8"), np.frombuffer(bar["b"], "<i8")

    def marks(state: tuple, r: dict) -> list | None:
        block, v_at, v_id = _cells(r)
        need = reached(state[1], state[0], block, v_at, v_id, state[2], state[3])
        return [pa.array([r["dim"]], pa.int32()), pa.array([r["g"]]), pa.array([r["block"]]), pa.array([np.packbits(need).tobytes()])] if need.any() else None

    need = _meet(queries.unionByName(bar_rows).unionByName(blocks), parts, with_bars, marks, lambda state: None, "dim int, g long, block long, need binary")
    exact = need.join(packed.select("block", "n", "ids", "vectors"), "block").join(file.select("block", "cells", "low", "width"), "block").select("dim", "g", "block", "n", "ids", "vectors", "cells", "low", "width", "need").mapInArrow(_needed, "dim int, g long, block long, n int, a binary, b binary, c binary, d binary, e binary")
    exact = exact.select("dim", "g", slot, F.lit(_BLOCK).alias("kind"), "block", "n", "a", "b", "c", "d", "e")

    def read(state: tuple, r: dict) -> None:
        block, _, v_id = _cells(r)
        both = np.frombuffer(r["e"], "<f8").reshape(r["n"], r["dim"] + 1)
        scan(state[2], state[1], both[:, 1:], block, (r["block"] << 16) + both[:, 0].astype(np.int64), v_id, state[3])

    found = _meet(queries.unionByName(exact), parts, start, read, results, "at long, query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(by_at)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, g, at: a row for every query."""
    for batch in batches:
        for dim, g, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = np.frombuffer(raw, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), g)), pa.array(at)], ["dim", "g", "at"])


def _bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, g, scores and ids of the bars of a group's queries, in the order of their places."""
    for batch in batches:
        for r in batch.to_pylist():
            score, id = (np.array([x[c] for x in r["x"]], "<i8").tobytes() for c in ("score", "id"))
            yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([r["g"]]), pa.array([score]), pa.array([id])], ["dim", "g", "a", "b"])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks, the vectors that are needed: ids, cells, low, width, and each one's number in the block and exact components."""
    for batch in batches:
        for i in range(batch.num_rows):
            dim, g, block, n, ids, vectors, cells, low, width, need = (c[i].as_py() for c in batch.columns)
            own = np.flatnonzero(np.unpackbits(np.frombuffer(need, np.uint8))[:n])
            v = np.frombuffer(vectors, "<f8").reshape(n, dim)[own]
            out = np.frombuffer(ids, "<i8")[own].tobytes(), np.frombuffer(cells, np.uint8).reshape(n, dim)[own].tobytes(), low, width, np.column_stack([own.astype("<f8"), v]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([g]), pa.array([block]), pa.array([len(own)], pa.int32()), *(pa.array([x]) for x in out)], ["dim", "g", "block", "n", "a", "b", "c", "d", "e"])


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM t WHERE k <= 20
"""
