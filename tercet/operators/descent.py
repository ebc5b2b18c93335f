"""Logistic regression by full-batch gradient descent, over any number of rows.

Rows are dealt to a fixed number of blocks by a hash of their id.  Where the cluster can run all tasks at once, the descent is
one barrier stage: every task keeps its blocks as arrays; each step the first task gets the gradient sums of all blocks, over
connections between the tasks, and sends back the total (the context's own allGather() takes a second a step, and only tells
the tasks where to connect).  Where executors come and go (dynamic allocation), each step is a job over the stored rows.  Sums are added in the order of
blocks, so weights do not depend on the number of tasks.  A lost executor makes Spark run the stage, or the step, again.
"""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.sources.stages import stored

#: Blocks of rows: the most tasks that a descent can use.
BLOCKS = 256
Sums = dict[int, np.ndarray]


def _arrays(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features and labels of each block; columns are block, label, features."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
        for b in np.unique(block).tolist():
            parts.setdefault(b, []).append(rows[block == b])
    return {b: (x[:, 1:], x[:, 0]) for b, x in ((b, np.concatenate(p)) for b, p in parts.items())}


def _totals(sums: list[Sums]) -> np.ndarray | None:
    """All blocks' sums, added in the order of blocks."""
    merged: Sums = {}
    for s in sums:
        for b, v in s.items():
            merged[b] = merged[b] + v if b in merged else v
    return np.sum([merged[b] for b in sorted(merged)], axis=0) if merged else None


def _packed(sums: Sums) -> bytes:
    return b"".join(np.float64(b).tobytes() + v.tobytes() for b, v in sums.items())


def _unpacked(data: bytes, width: int) -> Sums:
    rows = np.frombuffer(data).reshape(-1, width + 1)
    return {int(r[0]): r[1:] for r in rows}


def _first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(y)], x.sum(0)])


def _spread(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return ((x - mean) ** 2).sum(0)


def _step(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of losses, and the gradient's sums."""
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -700, 700))), 1e-12, 1 - 1e-12)
    return np.concatenate([[-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()], z.T @ (p - y)])


def _scaled(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), (x - mean) / std])


def _descend(total: Callable[[Callable, int, tuple], np.ndarray | None], k: int, config) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]] | None:
    """Weights (intercept first), means, deviations, and the loss before every step.

    total(f, width, arguments) is the sum over all rows of f of each block's arrays; None without rows.
    """
    got = total("first", k + 1, ())
    if got is None:
        return None
    n, mean = got[0], got[1:] / got[0]
    std = np.sqrt(total("spread", k, (mean,)) / n)
    std[std == 0] = 1.0
    w, history = np.zeros(k + 1), []
    decay = np.r_[0.0, np.full(k, config.l2 / n)]
    for _ in range(config.max_iter):
        sums = total("step", k + 2, (mean, std, w))
        history.append(float(sums[0] / n + 0.5 * (decay * w * w).sum()))
        w = w - config.learning_rate * (sums[1:] / n + decay * w)
        if len(history) > 1 and abs(history[-1] - history[-2]) < config.tolerance:
            break
    return w, mean, std, history


def _block_sums(blocks: dict[int, tuple[np.ndarray, np.ndarray]], what: str, args: tuple, kept: dict) -> Sums:
    if what == "first":
        return {b: _first(x, y) for b, (x, y) in blocks.items()}
    if what == "spread":
        return {b: _spread(x, args[0]) for b, (x, _) in blocks.items()}
    if "z" not in kept:
        kept["z"] = {b: _scaled(x, *args[:2]) for b, (x, _) in blocks.items()}
    return {b: _step(kept["z"][b], y, args[2]) for b, (_, y) in blocks.items()}


def fit(rows: DataFrame, columns: list[str], config, barrier: bool | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]] | None:
    """The descent over `rows` (event_id, label, columns without nulls); None where there are none.

    barrier: None decides by the cluster's settings.
    """
    spark, k = rows.sparkSession, len(columns)
    if barrier is None:
        barrier = str(spark.conf.get("spark.dynamicAllocation.enabled", "false")).lower() != "true"
    block = F.pmod(F.xxhash64("event_id"), F.lit(BLOCKS)).cast("int")
    ready = rows.select(block.alias("block"), F.col("label").cast("double").alias("label"), *(F.col(c).cast("double").alias(c) for c in columns), "event_id")
    ready = ready.repartition(min(BLOCKS, max(1, spark.sparkContext.defaultParallelism)), "block").sortWithinPartitions("block", "event_id", "label").drop("event_id")
    if barrier:
        return _in_one_stage(ready, k, config)
    kept = stored(ready)

    def total(what: str, width: int, args: tuple) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(_block_sums(_arrays(batches), what, args, {}))])], ["sums"])

        return _totals([_unpacked(bytes(r.sums), width) for r in kept.mapInArrow(run, "sums binary").collect()])  # BLOCKS short rows

    return _descend(total, k, config)


def _send(to: socket.socket, data: bytes) -> None:
    to.sendall(len(data).to_bytes(8, "little") + data)


def _receive(of: socket.socket) -> bytes:
    def exactly(n: int) -> bytes:
        parts = []
        while n:
            got = of.recv(min(n, 1 << 20))
            if not got:
                raise ConnectionError("a task of the descent has gone")
            parts.append(got)
            n -= len(got)
        return b"".join(parts)

    return exactly(int.from_bytes(exactly(8), "little"))


class _Meeting:
    """Connections from all tasks of a barrier stage to the first; total() is the sum of what all tasks bring.

    A task that is lost breaks its connection, which ends the others, and Spark runs the stage again.
    """

    def __init__(self, context: BarrierTaskContext, wait: float = 600.0):
        others = len(context.getTaskInfos()) - 1
        if context.partitionId() == 0:
            host = context.getTaskInfos()[0].address.rsplit(":", 1)[0]
            with socket.create_server(("", 0), backlog=others + 1) as server:
                context.allGather(f"{host}:{server.getsockname()[1]}")
                server.settimeout(wait)
                self.others = [server.accept()[0] for _ in range(others)]
            self.first = None
        else:
            host, port = context.allGather("")[0].rsplit(":", 1)
            self.others, self.first = [], socket.create_connection((host, int(port)), wait)
        for c in [*self.others, *([self.first] if self.first else [])]:
            c.settimeout(wait)
            c.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def total(self, own: Sums, width: int) -> np.ndarray | None:
        if self.first:
            _send(self.first, _packed(own))
            got = np.frombuffer(_receive(self.first))
        else:
            sums = _totals([own, *(_unpacked(_receive(c), width) for c in self.others)])
            got = np.zeros(0) if sums is None else sums
            for c in self.others:
                _send(c, got.tobytes())
        return got if len(got) else None

    def close(self) -> None:
        for c in [*self.others, *([self.first] if self.first else [])]:
            c.close()


def _in_one_stage(ready: DataFrame, k: int, config) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]] | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, blocks, kept = BarrierTaskContext.get(), _arrays(batches), {}
        meeting = _Meeting(context)
        got = _descend(lambda what, width, args: meeting.total(_block_sums(blocks, what, args, kept), width), k, config)
        meeting.close()
        if got is not None and context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist() if isinstance(v, np.ndarray) else v], pa.list_(pa.float64())) for v in got], ["w", "mean", "std", "losses"])

    found = ready.mapInArrow(run, "w array<double>, mean array<double>, std array<double>, losses array<double>", barrier=True).collect()  # one row
    return (*(np.array(v) for v in found[0][:3]), list(found[0][3])) if found else None
