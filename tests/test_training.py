"""Running sums, exact quantiles, descent and trees that no task holds whole, against plain NumPy on the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.operators import metrics, models, ordered, stationarity, trees


@pytest.fixture(scope="module")
def events(spark):
    """Ids, a date, labels, and columns that are continuous, coarse, constant, and useless."""
    rng = np.random.default_rng(11)
    n = 900
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), np.full(n, 3.0), rng.normal(size=n).round(1), rng.choice([0.1, 0.1 + 2**-54 * 8, 7.0], n)])
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) > 1).astype(int)
    rows = [(f"e{k}", f"2024-01-{1 + k % 28:02d}", int(y[k]), *map(float, x[k])) for k in range(n)]
    return x, y, spark.createDataFrame(rows, "event_id string, event_date string, label int, a double, b double, c double, d double, e double").repartition(5)


COLUMNS = list("abcde")


def plain_descent(x, y, config):
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    w, losses, n = np.zeros(z.shape[1]), [], len(y)
    free = np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(config.max_iter):
        p = 1 / (1 + np.exp(-(z @ w)))
        losses.append(float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + config.l2 / 2 / n * (free * w**2).sum()))
        w = w - config.learning_rate * (z.T @ (p - y) / n + config.l2 / n * free * w)
        if len(losses) > 1 and abs(losses[-1] - losses[-2]) < config.tolerance:
            break
    return w, losses


@pytest.mark.parametrize("config", [models.LogisticConfig(max_iter=120), models.LogisticConfig(max_iter=60, l2=40.0, learning_rate=0.3), models.LogisticConfig(max_iter=500, tolerance=1e-4, learning_rate=0.5)])
def test_descent(events, config):
    x, y, frame = events
    w, losses = plain_descent(x, y, config)
    got = models.fit_logistic(frame, COLUMNS, config).first()
    assert len(got.losses) == len(losses) and np.allclose(got.losses, losses, atol=1e-12)
    assert np.allclose([got.intercept, *got.coefficients], w, atol=1e-10) and got.coefficients[2] == 0
    assert np.allclose(got.means, x.mean(0)) and np.allclose(got.deviations, np.where(x.std(0) > 1e-12, x.std(0), 1), atol=1e-12)


def test_descent_does_not_depend_on_where_it_runs(spark, events):
    """One barrier stage, and a job a step; other numbers of tasks; the same bits."""
    _, _, frame = events
    config = models.LogisticConfig(max_iter=12)
    fits = [models.fit_logistic(f, COLUMNS, config, barrier=b).first() for f, b in ((frame, True), (frame.repartition(1), True), (frame, False))]
    assert fits[0] == fits[1] == fits[2]
    assert models.fit_logistic(frame.limit(0), COLUMNS, config).count() == 0
    one_class = models.fit_logistic(frame.where("label = 1"), COLUMNS, config).first()
    assert one_class.losses == sorted(one_class.losses, reverse=True) and one_class.intercept > 0


def plain_tree(x, y, config, depth=0):
    """A node as (n, positive, feature, cut, left, right), by trying every cut of every column."""
    def impure(v):
        p = v.mean() if len(v) else 0.0
        if config.criterion == "gini":
            return 2 * p * (1 - p)
        return -sum(q * math.log2(q) for q in (p, 1 - p) if q > 0)

    best = None
    if depth < config.max_depth and len(y) >= config.min_samples_split and 0 < y.sum() < len(y):
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            mids = (v[:-1] + v[1:]) / 2
            if len(mids) > config.max_thresholds:
                mids = np.unique(np.quantile(mids, np.linspace(0, 1, config.max_thresholds + 2)[1:-1]))
            for cut in mids:
                go = x[:, f] <= cut
                if min(go.sum(), (~go).sum()) < config.min_samples_leaf:
                    continue
                gain = impure(y) - (go.sum() * impure(y[go]) + (~go).sum() * impure(y[~go])) / len(y)
                if best is None or gain > best[0] + 1e-15:
                    best = (gain, f, cut)
    if best is None or best[0] < config.min_impurity_decrease:
        return [(depth, len(y), int(y.sum()), None, None)]
    go = x[:, best[1]] <= best[2]
    return [(depth, len(y), int(y.sum()), COLUMNS[best[1]], best[2])] + plain_tree(x[go], y[go], config, depth + 1) + plain_tree(x[~go], y[~go], config, depth + 1)


@pytest.mark.parametrize("config", [models.TreeConfig(), models.TreeConfig(max_depth=4, max_thresholds=7, criterion="entropy", min_samples_leaf=3), models.TreeConfig(max_depth=2, max_thresholds=2000), models.TreeConfig(max_depth=0), models.TreeConfig(min_impurity_decrease=0.9)])
def test_tree(events, config):
    x, y, frame = events
    got = models.fit_tree(frame, COLUMNS, config).orderBy("node_id").collect()
    want = plain_tree(x, y, config)
    assert [(r.depth, r.n_samples, r.positive_count, r.feature) for r in got] == [t[:4] for t in want]
    assert all((r.threshold is None) == (t[4] is None) and (t[4] is None or math.isclose(r.threshold, t[4], rel_tol=1e-14)) for r, t in zip(got, want, strict=True))
    for r in got:
        if r.feature:
            left, right = (next(c for c in got if c.node_id == k) for k in (r.left_node_id, r.right_node_id))
            assert r.left_node_id == r.node_id + 1 and left.n_samples + right.n_samples == r.n_samples


def test_tree_of_little(spark, events):
    _, _, frame = events
    assert models.fit_tree(frame.limit(0), COLUMNS).count() == 0
    pure = models.fit_tree(frame.where("label = 1"), COLUMNS).collect()
    assert len(pure) == 1 and pure[0].probability == 1.0 and pure[0].impurity == 0.0
    with pytest.raises(ValueError):
        models.fit_tree(frame, COLUMNS, models.TreeConfig(criterion="other"))


def test_cuts_from_the_neighbours_of_quantiles():
    rng = np.random.default_rng(0)
    for m in (2, 3, 8, 9, 10, 11, 50, 333):
        v = np.sort(rng.choice(10_000, m, replace=False)) / 7
        shares = np.linspace(0, 1, 10)[1:-1]
        mids = (v[:-1] + v[1:]) / 2
        want = mids if m - 1 <= 8 else np.unique(np.quantile(mids, shares))
        near = np.arange(m) if m - 1 <= 8 else np.unique(np.clip(np.floor((m - 2) * shares)[:, None] + np.arange(3), 0, m - 1)).astype(int)
        assert np.array_equal(trees.cuts(near.astype(float), v[near], m, shares), want)


def test_running_sums(spark):
    """A group with most rows, nulls as a group and in sums, both directions; ranges of a few rows."""
    rng = np.random.default_rng(1)
    rows = [(("hot", "hot", "hot", "b", None)[rng.integers(5)], k, float(rng.integers(-50, 50)), int(rng.integers(9)) if k % 7 else None) for k in range(600)]
    frame = spark.createDataFrame(rows, "g string, id long, v double, n long").repartition(3)
    got = ordered.running(frame, ["g"], [F.desc("v"), "id"], {"upto": F.col("n"), "rank": F.lit(1)}, {"whole": "upto"}).collect()
    assert len(got) == 600
    for g in ("hot", "b", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: (-r.v, r.id))
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and [r.upto for r in own] == np.cumsum([r.n or 0 for r in own]).tolist()
        assert {r.whole for r in own} == {own[-1].upto}
    assert ordered.running(frame, [], ["v", "id"], {"rank": F.lit(1)}).agg(F.max("rank"), F.sum("rank")).first() == (600, 600 * 601 // 2)
    assert ordered.running(frame.limit(0), ["g"], ["v"], {"rank": F.lit(1)}).count() == 0


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=301), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "tied": np.array([5.0] * 90 + [6.0] * 3), "none": np.array([])}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("none", None), ("a", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = {"low": 0.0, "q": 0.25, "m": 0.5, "x": 0.975, "top": 1.0}
    got = {r.g: [r[k] for k in shares] for r in ordered.quantiles(frame, ["g"], "v", shares).collect()}
    for g, x in values.items():
        assert got[g] == [None] * 5 if not len(x) else np.allclose(got[g], np.quantile(x, list(shares.values())))
    assert math.isclose(ordered.quantiles(frame, [], "v", {"m": 0.5}).first().m, np.median(np.concatenate(list(values.values()))))
    assert ordered.quantiles(frame.where("v IS NULL"), [], "v", {"m": 0.5}).first().m is None


def test_curves_over_many_probabilities(spark):
    """Ranks, the curve and the discoveries of a group whose probabilities fill many ranges."""
    rng = np.random.default_rng(3)
    p, y = rng.random(2000).round(3), rng.integers(0, 2, 2000)
    frame = spark.createDataFrame([(float(a), int(b), "s" if k % 50 else "few") for k, (a, b) in enumerate(zip(p, y, strict=True))], f"{metrics.P} double, {metrics.Y} int, split string").repartition(4)
    wins = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    assert math.isclose(metrics.rank_auc(frame).first().roc_auc, wins) and math.isclose(metrics.trapezoid_auc(frame).first().roc_auc, wins)
    both = {r.split: r.roc_auc for r in metrics.rank_auc(frame, "split").collect()}
    assert all(math.isclose(r.roc_auc, both[r.split]) for r in metrics.trapezoid_auc(frame, "split").collect())
    curve = metrics.roc_curve(frame).orderBy("threshold").collect()
    assert (curve[0].threshold, curve[0].true_positive_rate, curve[-1].threshold, curve[-1].false_positive_rate) == (-1.0, 1.0, 2.0, 0.0)
    at = next(r for r in curve if r.threshold == 0.5)
    assert math.isclose(at.true_positive_rate, (p[y == 1] >= 0.5).mean()) and math.isclose(at.false_positive_rate, (p[y == 0] >= 0.5).mean())
    q = np.sort(np.r_[rng.random(500) ** 6, [0.01] * 30])
    found = stationarity.benjamini_hochberg(spark.createDataFrame([(float(v),) for v in q] + [(None,)], "q double").repartition(4), "q", 0.1)
    want = q[: np.flatnonzero(q <= np.arange(1, len(q) + 1) * 0.1 / len(q)).max(initial=-1) + 1]
    assert sorted(r.q for r in found.where("fdr_reject").collect()) == want.tolist() and found.count() == len(q) + 1
