"""Residuals as a stream: running z-scores and crossings, with state for each triplet and method.

State is the last `window` residuals and the last |z|; late rows beyond the watermark are dropped by Spark.  Without waiting
rows are given out at once, in the order of time within a micro-batch: the results are those of the batch operators where no
row comes after a later one's micro-batch.  With wait=True rows are held until the watermark has passed them, and then taken in
the order of time, so that results are those of the batch operators in any order of arrival within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tercet.guards import require, require_columns

OUT = "triplet_id string, method string, ts timestamp, residual double, z_score double, crossed boolean"
STATE = "held array<double>, last double, waiting_us array<bigint>, waiting array<double>"


def crossings(stream: DataFrame, window: int = 60, min_periods: int = 20, entry: float = 2.0, delay: str = "7 days", wait: bool = False) -> DataFrame:
    """triplet_id, method, ts, residual, z_score, crossed for every row of a stream with triplet_id, method, ts, residual."""
    require(1 < min_periods <= window, "min_periods must be within (1, window]")
    require_columns(stream, ["triplet_id", "method", "ts", "residual"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, us, values = state.get if state.exists else ([], None, [], [])
        held = list(held)
        new = [pdf[["us", "residual"]] for pdf in batches]
        rows = pd.concat([pd.DataFrame({"us": np.array(us, np.int64), "residual": np.array(values, float)}), *new]).sort_values("us", kind="stable", ignore_index=True)
        if wait:
            passed = state.getCurrentWatermarkMs() * 1000
            rows, later = rows[rows["us"] < passed], rows[rows["us"] >= passed]
        else:
            later = rows[:0]
        zs, hits = [], []
        for r in rows["residual"]:
            z = None
            if len(held) >= min_periods:
                s = float(np.std(held, ddof=1))
                z = (r - float(np.mean(held))) / s if s > 0 else None
            zs.append(z)
            hits.append(z is not None and last is not None and abs(z) >= entry and last < entry)
            last = abs(z) if z is not None else None
            held = [*held, float(r)][-window:]
        state.update((held, last, [int(x) for x in later["us"]], [float(x) for x in later["residual"]]))
        if len(later):
            state.setTimeoutTimestamp(max(int(later["us"].min()) // 1000, state.getCurrentWatermarkMs()) + 1)
        if len(rows):
            yield pd.DataFrame({"triplet_id": key[0], "method": key[1], "ts": pd.to_datetime(rows["us"], unit="us", utc=True), "residual": rows["residual"], "z_score": zs, "crossed": hits})

    rows = stream.select("triplet_id", "method", "ts", "residual").withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    timeout = GroupStateTimeout.EventTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return rows.groupBy("triplet_id", "method").applyInPandasWithState(step, OUT, STATE, "append", timeout)
