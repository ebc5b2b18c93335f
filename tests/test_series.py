"""Fractional differences in blocks against sums over windows, and as-of joins against a scan of all earlier rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.operators import ordered, stationarity

DAY = dt.date(2024, 1, 1)


def windows(x, w):
    """By definition."""
    out = [None] * len(x)
    for t in range(len(w) - 1, len(x)):
        part = x[t - len(w) + 1 : t + 1]
        if all(v is not None and np.isfinite(v) for v in part):
            out[t] = float(np.dot(w[::-1], part))
    return out


@pytest.mark.parametrize(("d", "threshold", "block"), [(0.4, 1e-2, 16), (0.4, 1e-3, 100), (0.3, 1e-3, 4096), (1.0, 1e-5, 7), (0.0, 1e-5, 1), (0.7, 1e-4, 1)])
def test_fractional_diff_in_blocks(spark, d, threshold, block):
    rng = np.random.default_rng(3)
    groups = {"long": (4 + rng.normal(0, 0.02, 330).cumsum()).tolist(), "short": [1.0, 2.0, 4.0], None: rng.normal(0, 1, 150).tolist()}
    groups["long"][20], groups["long"][21], groups["long"][200] = None, float("nan"), float("inf")
    rows = [(g, DAY + dt.timedelta(t), v, {"t": t}, None if t % 2 else t) for g, x in groups.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, date date, log_price double, extra struct<t: long>, `__x y` long").repartition(3)
    got = stationarity.fractional_diff(df, d, threshold=threshold, block=block)
    assert got.columns == [*df.columns, "fractional_diff"] and got.schema["__x y"] == df.schema["__x y"]
    w = stationarity.fractional_weights(d, threshold)
    own = {(r.symbol, r.date): r for r in got.collect()}
    assert len(own) == len(rows)
    for g, x in groups.items():
        for t, want in enumerate(windows(x, w)):
            r = own[g, DAY + dt.timedelta(t)]
            assert r.extra.t == t and r["__x y"] == (None if t % 2 else t)
            assert r.fractional_diff is None if want is None else abs(r.fractional_diff - want) < 1e-10


def test_filter_by_transform():
    rng = np.random.default_rng(4)
    x, w = rng.normal(4, 1, 3000), np.array(stationarity.fractional_weights(0.4))
    assert len(w) > 1000 and np.allclose(stationarity.filtered(x, w)[len(w) - 1 :], np.convolve(x, w, "valid"), atol=1e-10)
    assert np.isnan(stationarity.filtered(x[:1000], w)).all() and len(stationarity.filtered(x[:0], w)) == 0
    assert stationarity.fractional_weights(2.0) == [1.0, -2.0, 1.0]


@pytest.mark.parametrize("within", [None, "2 days"])
def test_as_of(spark, within):
    rng = np.random.default_rng(5)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(k))
    key = lambda: ["hot", "hot", "hot", "cold", None][rng.integers(5)]
    quotes = [(key(), (DAY + dt.timedelta(int(rng.integers(40)))) if rng.random() > 0.05 else None, float(rng.integers(9)) if rng.random() > 0.2 else None) for _ in range(300)]
    asks = [(k, key(), at(rng.integers(-50, 1100)) if rng.random() > 0.05 else None, {"deep": k}) for k in range(400)] + [(900, "unseen", at(500), {"deep": 900})]
    left = spark.createDataFrame(asks, "id int, symbol string, moment timestamp, extra struct<deep: int>").repartition(5)
    right = spark.createDataFrame(quotes, "symbol string, date date, price double").repartition(4)
    got = {r.id: r for r in ordered.as_of(left, right, ["symbol"], "moment", "date", ["price"], within).collect()}
    assert len(got) == len(asks)
    midnight = lambda d: dt.datetime(d.year, d.month, d.day)
    for k, symbol, moment, _ in asks:
        seen = [(d, p) for s, d, p in quotes if s == symbol and d is not None and moment is not None and midnight(d) <= moment]
        d, p = max(seen, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=(None, None))
        if within and d is not None and midnight(d) < moment - dt.timedelta(days=2):
            d, p = None, None
        assert (got[k].as_of, got[k].price, got[k].extra.deep) == (d, p, k)


def test_as_of_without_keys_and_rows(spark):
    grid = spark.createDataFrame([(DAY + dt.timedelta(7 * k),) for k in range(5)], "date date")
    days = spark.createDataFrame([(DAY + dt.timedelta(k),) for k in (-1, 0, 6, 7, 90)], "event_date date")
    got = {(r.event_date - DAY).days: r.as_of for r in ordered.as_of(days, grid, [], "event_date", "date", []).collect()}
    assert got == {-1: None, 0: DAY, 6: DAY, 7: DAY + dt.timedelta(7), 90: DAY + dt.timedelta(28)}
    assert ordered.as_of(days.limit(0), grid, [], "event_date", "date", []).count() == 0
    assert ordered.as_of(days, grid.limit(0), [], "event_date", "date", []).where(F.col("as_of").isNull()).count() == 5
