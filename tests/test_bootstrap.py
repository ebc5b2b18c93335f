"""Bootstraps against resamples laid out in NumPy from the same draws."""

import datetime as dt
import hashlib

import numpy as np
import pytest

from tercet.operators import portfolio

DAY = dt.date(2024, 1, 1)


def drawn(seed, resample, count, size):
    digests = [hashlib.md5(f"{seed}|{resample}|{q}".encode()).hexdigest() for q in range(-(-count // 4))]
    bits = [int(d[8 * k : 8 * k + 8], 16) for d in digests for k in range(4)][:count]
    return np.array([int(b / 2**32 * size) for b in bits])


@pytest.fixture(scope="module")
def trades(spark):
    rng = np.random.default_rng(8)
    pnl = {"many": rng.normal(0.1, 1, 97).round(4), "two": np.array([1.0, -2.0]), "one": np.array([0.5])}
    rows = [(s, DAY + dt.timedelta(k // 3), f"e{k:03d}", float(v)) for s, x in pnl.items() for k, v in enumerate(x)] + [("many", DAY, "e0000", None), ("none", DAY, "e1", None)]
    return pnl, spark.createDataFrame(rows, "strategy string, pnl_date date, event_id string, net_pnl double").repartition(3)


@pytest.mark.parametrize("metric", ["mean_pnl", "win_rate"])
def test_trades_one_by_one(trades, metric):
    pnl, frame = trades
    got = {r.strategy: r for r in portfolio.bootstrap_interval(frame, metric, resamples=40, confidence=0.8, seed=5).collect()}
    assert set(got) == set(pnl)
    for s, x in pnl.items():
        x = (x > 0).astype(float) if metric == "win_rate" else x
        assert got[s].n == len(x) and np.isclose(got[s].estimate, x.mean())
        if len(x) < 2:
            assert got[s].ci_low is None
            continue
        means = [x[drawn(5, q, len(x), len(x))].mean() for q in range(40)]
        assert np.allclose([got[s].ci_low, got[s].ci_high], np.quantile(means, [0.1, 0.9]))
    with pytest.raises(ValueError):
        portfolio.bootstrap_interval(frame, "other")


def test_draws_are_never_broadcast(trades):
    """Draws come from one row a group, so that Spark takes them for few; the side they are joined to may be sent, not they."""
    plan = portfolio.bootstrap_interval(trades[1], resamples=40)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line.split("Join ")[1] for line in plan.splitlines() if "Join " in line and "__piece" not in line]
    assert len(joins) == 2 and all(line.startswith("LeftOuter") for line in joins)


def test_draws_stay_in_the_tasks_that_make_them(trades):
    """Draws come from one row a group, but not in one task; where trades are few, draws are not shuffled to them, nor sorted."""
    rows = portfolio.draws(trades[1].groupBy("strategy").count(), ["strategy"], 40, 0, portfolio.F.col("count"), portfolio.F.col("count"))
    assert rows.select(portfolio.F.spark_partition_id()).distinct().count() > 1
    got = portfolio.bootstrap_interval(trades[1], resamples=40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and got.count() == 3


def fall(path):
    equity = path.cumsum()
    return (equity - np.maximum.accumulate(equity)).min()


def sharpe(path):
    return np.sqrt(252) * path.mean() / path.std(ddof=1)


@pytest.mark.parametrize(("metric", "measure"), [("max_drawdown", fall), ("sharpe", sharpe)])
@pytest.mark.parametrize("block", [1, 7, 20])
def test_moving_blocks(spark, metric, measure, block):
    rng = np.random.default_rng(block)
    daily = {"long": rng.normal(0.05, 1, 45), "even": rng.normal(size=40), "short": rng.normal(size=9), "single": np.array([1.0])}
    rows = [(s, DAY + dt.timedelta(t), float(v)) for s, x in daily.items() for t, v in enumerate(x)] + [("long", DAY + dt.timedelta(99), None)]
    frame = spark.createDataFrame(rows, "strategy string, date date, daily_pnl double").repartition(3)
    got = {r.strategy: r for r in portfolio.block_bootstrap_interval(frame, metric, block, resamples=30, confidence=0.9, seed=2).collect()}
    assert set(got) == set(daily) and got["single"].estimate is None
    for s, x in daily.items():
        assert got[s].n == len(x)
        if len(x) > 1:
            assert np.isclose(got[s].estimate, measure(x))
        if len(x) < max(10, block):
            assert got[s].ci_low is None and got[s].ci_high is None
            continue
        paths = [np.concatenate([x[a : a + block] for a in drawn(2, q, -(-len(x) // block), len(x) - block + 1)])[: len(x)] for q in range(30)]
        assert np.allclose([got[s].ci_low, got[s].ci_high], np.quantile([measure(p) for p in paths], [0.05, 0.95]))


def test_no_trades_and_flat_paths(spark, trades):
    _, frame = trades
    assert portfolio.bootstrap_interval(frame.limit(0)).count() == 0
    flat = spark.createDataFrame([("s", DAY + dt.timedelta(t), 0.1) for t in range(30)], "strategy string, date date, daily_pnl double")
    r = portfolio.block_bootstrap_interval(flat, "sharpe", resamples=5).first()
    assert (r.estimate, r.ci_low, r.n) == (None, None, 30) and portfolio.block_bootstrap_interval(flat, resamples=5).first().estimate == 0.0


def test_components_of_chains_and_stars(spark):
    """A long chain in mixed order, a ring, a star, a node alone; then clusters that hang together through such chains."""
    order = np.random.default_rng(3).permutation(70)
    chain = [(f"n{order[k]:02d}", f"n{order[k + 1]:02d}") for k in range(69)]
    edges = [*chain, *((f"r{k}", f"r{(k + 1) % 9}") for k in range(9)), *(("s5", f"s{k}") for k in range(10)), ("z", "z")]
    got = {r.node: r.root for r in portfolio.components(spark.createDataFrame(edges, "a string, b string").repartition(3), most=12).collect()}
    want = {n: r for names, r in (([f"n{k:02d}" for k in range(70)], "n00"), ([f"r{k}" for k in range(9)], "r0"), ([f"s{k}" for k in range(10)], "s0"), (["z"], "z")) for n in names}
    assert got == want
    ids = [(f"T{k}_L{k:02d}_L{k + 1:02d}",) for k in range(30)] + [("A_P_P",), ("B_P_Q",), ("C_X_Y",), ("D_Y_X",)]
    rows = portfolio.shared_leg_clusters(spark.createDataFrame(ids, "triplet_id string")).orderBy("cluster_id").collect()
    assert [(r.cluster_id, len(r.triplets), r.shared_legs if r.cluster_size < 30 else len(r.shared_legs)) for r in rows] == [(0, 2, ["P"]), (1, 2, ["X", "Y"]), (2, 30, 31)]
    with pytest.raises(RuntimeError):
        portfolio.components(spark.createDataFrame(edges, "a string, b string"), most=1)
    assert portfolio.shared_leg_clusters(spark.createDataFrame([], "triplet_id string")).count() == 0
