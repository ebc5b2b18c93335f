"""The filter in blocks against the recursion over whole series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.operators import kalman

DAY = dt.date(2024, 1, 1)
SCHEMA = "triplet_id string, target_symbol string, hedge_symbol_1 string, hedge_symbol_2 string, date date, y double, x1 double, x2 double"


def series(n, seed):
    rng = np.random.default_rng(seed)
    x = 4 + rng.normal(0, 0.1, (n, 2)).cumsum(0)
    return 0.3 + (x * (1 + rng.normal(0, 0.01, (n, 2)).cumsum(0))).sum(1) + rng.normal(0, 0.02, n), x


@pytest.fixture(scope="module")
def data(spark):
    groups = {"long": series(103, 1), "two": series(14, 2), "one": series(1, 3), "short": series(6, 4)}
    rows = [(g, "Y", "A", "B", DAY + dt.timedelta(t), float(y[t]), float(x[t, 0]), float(x[t, 1])) for g, (y, x) in groups.items() for t in range(len(y))]
    rows += [("long", "Y", "A", "B", DAY + dt.timedelta(200 + k), v, 1.0, 1.0) for k, v in enumerate((None, float("nan"), float("inf")))] + [("none", "Y", "A", "B", DAY, None, None, None)]
    return groups, spark.createDataFrame(rows, SCHEMA).repartition(3)


def whole(y, x, config, initial_state=None):
    """The first filtered row and the numbers of it and all later ones, in one go."""
    first, state = 0, np.array([y[0], 0.0, 0.0])
    if initial_state is not None:
        state = np.array(initial_state)
    elif config.initial_window and len(y) > config.initial_window:
        first = config.initial_window
        state = np.linalg.lstsq(np.column_stack([np.ones(first), x[:first]]), y[:first], rcond=None)[0]
    return first, kalman.run_filter(y[first:], x[first:], config, state, np.eye(3) * config.initial_covariance)


@pytest.mark.parametrize("block", [1, 7, 4096])
@pytest.mark.parametrize(
    ("config", "initial_state"),
    [(kalman.KalmanConfig(), None), (kalman.KalmanConfig(process_noise=(1e-6, 1e-4, 2e-4), initial_window=12), None), (kalman.KalmanConfig(process_noise=0.0, measurement_noise=0.01, initial_covariance=100.0), (0.5, 1.0, 1.0))],
)
def test_blocks_of_a_series(data, block, config, initial_state):
    groups, frame = data
    got = {}
    for r in kalman.kalman_regression(frame, config, initial_state, block).collect():
        got.setdefault(r.triplet_id, []).append((r.date, [r[c] for c in kalman.NUMBERS]))
    assert set(got) == set(groups)
    for g, (y, x) in groups.items():
        first, want = whole(y, x, config, initial_state)
        own = sorted(got[g])
        assert [d for d, _ in own] == [DAY + dt.timedelta(t) for t in range(first, len(y))]
        assert np.allclose([v for _, v in own], want, rtol=1e-7, atol=1e-9)


def test_elements_are_associative():
    y, x = series(9, 5)
    config = kalman.KalmanConfig(process_noise=1e-3, measurement_noise=0.02)
    parts = [kalman.element(y[a:b], x[a:b], config) for a, b in ((0, 2), (2, 7), (7, 9))]
    left, right = parts[0].then(parts[1]).then(parts[2]), parts[0].then(parts[1].then(parts[2]))
    assert np.allclose(left.numbers(), right.numbers()) and np.allclose(left.numbers(), kalman.element(y, x, config).numbers())
    assert np.allclose(kalman.Element.read(left.numbers()).numbers(), left.numbers())
    state, covariance = np.array([0.1, 1.0, 0.9]), np.diag([1.0, 2.0, 0.5])
    end = left.after(state, covariance)
    numbers = kalman.run_filter(y, x, config, state, covariance)
    assert np.allclose(end[0], numbers[-1, :3]) and np.isclose(np.trace(end[1]), numbers[-1, -1])


def test_no_rows(data):
    _, frame = data
    assert kalman.kalman_regression(frame.limit(0)).count() == 0 and kalman.kalman_regression(frame.where(F.col("triplet_id") == "none")).count() == 0
