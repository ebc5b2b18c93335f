"""Decision trees grown level by level, over any number of rows.

For a level, the rows of its open nodes are counted by node, feature and value; running counts over the values, made in ranges,
place every value, and only those beside a candidate cut come to the driver: as many as nodes times features times three times
`max_thresholds` at most, whatever the rows.  Rows are never moved between nodes: a row's node is an expression of its features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators.ordered import running
from tercet.sources.stages import stored


def impurity(positive: np.ndarray, n: np.ndarray, criterion: str) -> np.ndarray:
    p = positive / np.maximum(n, 1)
    if criterion == "gini":
        return 2 * p * (1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(-p * np.log2(p)) + np.nan_to_num(-(1 - p) * np.log2(1 - p))


def _between(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """a + (b - a) * t, from the nearer end."""
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


def cuts(rank: np.ndarray, value: np.ndarray, distinct: int, shares: np.ndarray) -> np.ndarray:
    """Candidate cuts of a column: midpoints of its distinct values, or where there are more than `shares`, these quantiles of them.

    rank, value: the distinct values that are at hand, by place from 0: all, or those around the quantiles.
    """
    if distinct - 1 <= len(shares):
        return np.unique((value[:-1] + value[1:]) / 2)
    place = (distinct - 2) * shares
    low = np.floor(place)
    at = np.searchsorted(rank, low)
    first = (value[at] + value[at + 1]) / 2
    last = np.minimum(at + 2, len(value) - 1)
    second = np.where(low + 2 <= distinct - 1, (value[at + 1] + value[last]) / 2, first)
    return np.unique(_between(first, second, place - low))


def best_cut(cells: dict[int, np.ndarray], n: int, positive: int, config) -> tuple[float, int, float, int, int] | None:
    """gain, feature, cut, and the rows and positive ones at or below it, of the best cut of a node; the first of equal ones.

    cells: for each feature its distinct values at hand: place, value, rows and positive rows up to it, number of distinct values.
    """
    shares = np.linspace(0, 1, config.max_thresholds + 2)[1:-1]
    own, best = float(impurity(np.array(float(positive)), np.array(n), config.criterion)), None
    for feature in sorted(cells):
        rank, value, upto, hits, distinct = cells[feature]
        if distinct[0] < 2:
            continue
        at = cuts(rank, value, int(distinct[0]), shares)
        below = np.searchsorted(value, at, "right") - 1
        left, pos = upto[below], hits[below]
        ok = (left >= config.min_samples_leaf) & (n - left >= config.min_samples_leaf)
        if not ok.any():
            continue
        child = (left * impurity(pos, left, config.criterion) + (n - left) * impurity(positive - pos, n - left, config.criterion)) / n
        gain = np.where(ok, own - child, -np.inf)
        j = int(gain.argmax())
        if best is None or gain[j] > best[0]:
            best = (float(gain[j]), feature, float(at[j]), int(left[j]), int(pos[j]))
    return best if best and best[0] >= config.min_impurity_decrease else None


def _node(tree: dict[int, dict], columns: list[str]) -> Column:
    """The number of a row's node: 1 is the root, 2k and 2k + 1 are the children of k."""

    def case(k: int) -> Column:
        if tree[k]["feature"] is None:
            return F.lit(k)
        return F.when(F.col(columns[tree[k]["feature"]]) <= F.lit(tree[k]["threshold"]), case(2 * k)).otherwise(case(2 * k + 1))

    return case(1)


def _cells(rows: DataFrame, node: Column, open_: list[int], columns: list[str], config) -> dict[int, dict[int, np.ndarray]]:
    """For each open node and feature, what best_cut() needs."""
    shares = np.linspace(0, 1, config.max_thresholds + 2)[1:-1].tolist()
    each = rows.withColumn("node", node).where(F.col("node").isin(open_))
    each = each.select("node", "label", F.posexplode(F.array(*(F.col(c) for c in columns))).alias("f", "value")).where("value IS NOT NULL AND NOT isnan(value)")
    per = each.groupBy("node", "f", "value").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    placed = running(per, ["node", "f"], ["value"], {"rank": F.lit(1), "upto": F.col("n"), "hits": F.col("s")}, {"distinct": "rank"})
    place = F.col("rank") - 1
    low = F.transform(F.array(*map(F.lit, shares)), lambda q: F.floor((F.col("distinct") - 2) * q))
    asked = F.exists(low, lambda x: (place >= x) & (place <= x + 2))
    got = placed.where((F.col("distinct") - 1 <= len(shares)) | asked).select("node", "f", place.alias("place"), "value", "upto", "hits", "distinct")
    out: dict[int, dict[int, np.ndarray]] = {k: {} for k in open_}
    table = got.toPandas().sort_values(["node", "f", "place"])
    for (k, f), part in table.groupby(["node", "f"], sort=True):
        out[int(k)][int(f)] = part[["place", "value", "upto", "hits", "distinct"]].to_numpy(float).T
    return out


def grow(train: DataFrame, columns: list[str], config) -> list[dict]:
    """The nodes in preorder, over all rows of `train` (label, columns); none where it has no rows."""
    rows = stored(train.select(F.col("label").cast("long").alias("label"), *(F.col(c).cast("double").alias(c) for c in columns)))
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return []

    def node(depth: int, n: int, positive: int) -> dict:
        i = float(impurity(np.array(float(positive)), np.array(n), config.criterion))
        return {"depth": depth, "n_samples": n, "positive_count": positive, "probability": positive / n, "impurity": i, "feature": None, "threshold": None, "information_gain": None}

    tree, open_ = {1: node(0, n, positive)}, [1]
    for depth in range(config.max_depth):
        open_ = [k for k in open_ if tree[k]["n_samples"] >= config.min_samples_split and tree[k]["impurity"] > 0]
        if not open_:
            break
        cells, below = _cells(rows, _node(tree, columns), open_, columns, config), []
        for k in open_:
            own = tree[k]
            if best := best_cut(cells[k], own["n_samples"], own["positive_count"], config):
                own.update(information_gain=best[0], feature=best[1], threshold=best[2])
                tree[2 * k] = node(depth + 1, best[3], best[4])
                tree[2 * k + 1] = node(depth + 1, own["n_samples"] - best[3], own["positive_count"] - best[4])
                below += [2 * k, 2 * k + 1]
        open_ = below
    out: list[dict] = []

    def number(k: int) -> int:
        own = {"node_id": len(out), **tree[k], "left_node_id": None, "right_node_id": None}
        out.append(own)
        if own["feature"] is not None:
            own["left_node_id"], own["right_node_id"] = number(2 * k), number(2 * k + 1)
        return own["node_id"]

    number(1)
    return out
