"""Regressions on any number of columns, and unit-root tests, against NumPy's least squares on the rows."""

import math

import numpy as np
import pytest

from tercet.operators import linear, stationarity


def least_squares(x, y, alpha=0.0, fit_intercept=True, penalize_intercept=False):
    design = np.column_stack([np.ones(len(x)), x]) if fit_intercept else x
    penalty = alpha * np.eye(design.shape[1])
    if fit_intercept and not penalize_intercept:
        penalty[0, 0] = 0
    b = np.linalg.lstsq(design.T @ design + penalty, design.T @ y, rcond=1e-12)[0] if alpha else np.linalg.lstsq(design, y, rcond=None)[0]
    rest, whole = ((y - design @ b) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    return (b[0], b[1:], 1 - rest / whole if whole else 0.0) if fit_intercept else (0.0, b, 1 - rest / whole if whole else 0.0)


def frame(spark, groups):
    k = groups["a"][0].shape[1]
    names = [f"x{i}" for i in range(k)]
    rows = [(g, t, float(y[t]), *map(float, x[t])) for g, (x, y) in groups.items() for t in range(len(y))]
    bad = [("a", 10_000, None, *[1.0] * k), ("a", 10_001, 1.0, *[float("nan")] * k), ("none", 0, None, *[1.0] * k)]
    return names, spark.createDataFrame(rows + bad, ", ".join(["g string", "t int", "y double", *(f"{n} double" for n in names)])).repartition(3)


def groups(k, seed):
    rng = np.random.default_rng(seed)
    out = {}
    for g, n in (("a", 50), ("b", 9)):
        x = 4 + rng.normal(0, 0.3, (n, k)).cumsum(0)
        out[g] = (x, 0.5 + x @ np.arange(1, k + 1) + rng.normal(0, 0.1, n))
    out["flat"] = (out["b"][0], np.full(9, 2.0))
    return out


SETTINGS = [{}, {"alpha": 1.5}, {"alpha": 0.7, "penalize_intercept": True}, {"fit_intercept": False}, {"fit_intercept": False, "alpha": 2.0}]


@pytest.mark.parametrize("k", [1, 3, 5])
@pytest.mark.parametrize("settings", SETTINGS)
def test_fit(spark, k, settings):
    data = groups(k, k)
    names, rows = frame(spark, data)
    got = {r.g: r for r in linear.fit(rows, ["g"], names, **settings).collect()}
    assert set(got) == set(data)
    for g, (x, y) in data.items():
        intercept, slopes, r2 = least_squares(x, y, **settings)
        r = got[g]
        assert r.n == len(y) and np.allclose(r.coefficients, slopes, atol=1e-6) and math.isclose(r.intercept, intercept, abs_tol=1e-6)
        assert math.isclose(r.r_squared, r2, abs_tol=1e-6) or g == "flat"


@pytest.mark.parametrize("fit_intercept", [True, False])
def test_collinear_columns(spark, fit_intercept):
    """The least-norm solution, with columns that repeat, add up, and do not vary; or nulls, where that is asked for."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 30))
    x = np.column_stack([a, 2 * a, b, a + b, np.full(30, 3.0)])
    data = {"a": (x, a - b + 0.5), "fine": (rng.normal(size=(30, 5)), b)}
    names, rows = frame(spark, data)
    got = {r.g: r for r in linear.fit(rows, ["g"], names, fit_intercept=fit_intercept).collect()}
    for g, (cols, y) in data.items():
        intercept, slopes, r2 = least_squares(cols, y, fit_intercept=fit_intercept)
        assert np.allclose(got[g].coefficients, slopes, atol=1e-6) and math.isclose(got[g].intercept, intercept, abs_tol=1e-6) and math.isclose(got[g].r_squared, r2, abs_tol=1e-6)
    bare = {r.g: r for r in linear.fit(rows, ["g"], names, fit_intercept=fit_intercept, least_norm=False).collect()}
    assert bare["a"].coefficients is None and bare["a"].intercept is None and np.allclose(bare["fine"].coefficients, got["fine"].coefficients)


@pytest.mark.parametrize("settings", SETTINGS[:4])
def test_rolling_fit(spark, settings):
    data = groups(3, 9)
    names, rows = frame(spark, data)
    got = {(r.g, r.t): r for r in linear.rolling_fit(rows, ["g"], "t", names, "y", 8, **settings).collect()}
    assert set(got) == {(g, t) for g, (_, y) in data.items() for t in range(8, len(y))} | {("a", 10_000)}
    for (g, t), r in got.items():
        if t < 10_000:
            x, y = data[g]
            intercept, slopes, _ = least_squares(x[t - 8 : t], y[t - 8 : t], **settings)
            assert np.allclose(r.coefficients, slopes, atol=1e-5) and math.isclose(r.residual, y[t] - intercept - x[t] @ slopes, abs_tol=1e-5)
    with pytest.raises(ValueError):
        linear.rolling_fit(rows, ["g"], "t", names, "y", 3)
    with pytest.raises(ValueError):
        linear.fit(rows, ["g"], names, alpha=-1.0)


def plain_adf(v, max_lag=None):
    """tau, lag and rows, by a least-squares fit for every lag."""
    d, level = np.diff(v), v[:-1]
    top = int(12 * (len(v) / 100) ** 0.25) if max_lag is None else max_lag
    top = max(0, min(top, len(d) - 3))
    design = lambda k: np.column_stack([np.ones(len(d) - top), level[top:]] + [d[top - i : len(d) - i] for i in range(1, k + 1)])
    fit = lambda k: np.linalg.lstsq(design(k), d[top:], rcond=None)[0]
    rss = lambda k: float(((d[top:] - design(k) @ fit(k)) ** 2).sum())
    n = len(d) - top
    score = [n * math.log(rss(k) / n) + 2 * (k + 2) if n > k + 2 and rss(k) > 0 else math.inf for k in range(top + 1)]
    lag = int(np.argmin(score)) if top else 0
    se = math.sqrt(rss(lag) / (n - lag - 2) * np.linalg.pinv(design(lag).T @ design(lag))[1, 1])
    return fit(lag)[1] / se, lag, n


@pytest.mark.parametrize("max_lag", [None, 0, 3])
def test_adf(spark, max_lag):
    rng = np.random.default_rng(12)
    series = {"short": rng.normal(size=20).cumsum(), "walk": rng.normal(size=260).cumsum() + 50, "noise": rng.normal(size=80)}
    ar = np.zeros(400)
    for t in range(3, 400):
        ar[t] = 0.6 * ar[t - 1] - 0.3 * ar[t - 3] + rng.normal()
    series["ar"] = ar
    rows = [(g, "m", t, float(v)) for g, x in series.items() for t, v in enumerate(x)] + [("few", "m", t, float(t % 3)) for t in range(19)] + [("walk", "m", 999, None), ("noise", "m", -1, float("inf")), ("flat", "m", 0, 1.0)]
    rows += [("flat", "m", t, 1.0) for t in range(1, 40)]
    got = {r.triplet_id: r for r in stationarity.adf_by_group(spark.createDataFrame(rows, "triplet_id string, method string, t int, v double").repartition(3), "v", order="t", max_lag=max_lag).collect()}
    assert set(got) == {*series, "flat"}
    for g, x in series.items():
        tau, lag, n = plain_adf(x, max_lag)
        assert (got[g].lag_used, got[g].n_obs) == (lag, n) and math.isclose(got[g].adf_statistic, tau, rel_tol=1e-6, abs_tol=1e-8)
    assert got["flat"].adf_statistic is None and got["flat"].adf_p_value == 1.0
