"""Hidden Markov models in blocks against the recursions over whole series and against all paths."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.operators import regimes

DAY = dt.date(2024, 1, 1)
MODEL = regimes.HMM(np.array([0.6, 0.3, 0.1]), np.array([[0.8, 0.15, 0.05], [0.1, 0.85, 0.05], [0.2, 0.1, 0.7]]), np.array([0.0, 1.5, -0.2]), np.array([0.3, 0.5, 6.0]))
SCHEMA = "triplet_id string, method string, date date, z_score double"


def series(n, seed):
    rng = np.random.default_rng(seed)
    state = (np.arange(n) // 13) % 3
    return np.where(state == 0, rng.normal(0, 0.4, n), np.where(state == 1, rng.normal(1.6, 0.5, n), rng.normal(0, 2.5, n)))


@pytest.fixture(scope="module")
def data(spark):
    groups = {("long", "m"): series(101, 1), ("two", "m"): series(24, 2), ("least", "m"): series(9, 3), (None, "m"): series(30, 4), ("flat", "m"): np.ones(21)}
    rows = [(a, b, DAY + dt.timedelta(t), float(v)) for (a, b), x in groups.items() for t, v in enumerate(x)]
    rows += [("long", "m", DAY + dt.timedelta(300 + t), v) for t, v in enumerate((None, float("nan"), float("inf")))] + [("few", "m", DAY + dt.timedelta(t), 0.5) for t in range(8)]
    return groups, spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("not read")).repartition(3)


def by_series(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.triplet_id, r.method), []).append(r)
    return {k: sorted(v, key=lambda r: (r.asDict().get("date"), r.asDict().get("state"))) for k, v in out.items()}


def agrees(rows, x, m):
    e = regimes.emissions(x, m.mean, m.variance)
    g, _, _, ll = regimes.posterior(e, m)
    names = regimes.regime_labels(m.mean, m.variance)
    assert [r.date for r in rows] == [DAY + dt.timedelta(t) for t in range(len(x))] and [r.feature_value for r in rows] == x.tolist()
    assert np.allclose([[r[f"state_{i}_probability"] for i in range(3)] for r in rows], g, atol=1e-8)
    assert [r.viterbi_state for r in rows] == regimes.viterbi(e, m).tolist() and np.allclose([r.log_likelihood for r in rows], ll)
    assert all(r.viterbi_regime == names[r.viterbi_state] and r.most_likely_regime == names[r.most_likely_state] for r in rows)
    assert np.allclose([[r[f"{n}_probability"] for n in regimes.REGIMES] for r in rows], g[:, [names.index(n) for n in regimes.REGIMES]], atol=1e-8)


@pytest.mark.parametrize("block", [1, 10, 1024])
def test_given_model_in_blocks(data, block):
    groups, frame = data
    got = by_series(regimes.regime_probabilities(frame, model=MODEL, block=block))
    assert set(got) == set(groups)
    for key, x in groups.items():
        agrees(got[key], x, MODEL)


def test_fits_in_blocks(data):
    groups, frame = data
    config = regimes.HMMConfig(max_iter=6)
    some = frame.where("triplet_id in ('long', 'two') or triplet_id is null")
    got = by_series(regimes.regime_parameters(some, config=config, block=25))
    assert set(got) == {("long", "m"), ("two", "m"), (None, "m")}
    for key, rows in got.items():
        m = regimes.fit(groups[key], config)
        assert np.allclose([[r.mean, r.variance, r.start_probability, *(r[f"transition_to_state_{i}"] for i in range(3))] for r in rows], np.column_stack([m.mean, m.variance, m.start, m.transition]), atol=1e-7)
        assert np.allclose([r.log_likelihood for r in rows], m.log_likelihood) and [r.regime_label for r in rows] == regimes.regime_labels(m.mean, m.variance)
    own = by_series(regimes.regime_probabilities(some.where("triplet_id = 'long'"), config=config, block=25))
    agrees(own["long", "m"], groups["long", "m"], regimes.fit(groups["long", "m"], config))


def test_settled_series_stay(data):
    groups, frame = data
    config = regimes.HMMConfig(max_iter=4, tolerance=0.5)
    got = by_series(regimes.regime_parameters(frame.where("triplet_id in ('two', 'flat')"), config=config, block=8))
    for key, rows in got.items():
        m = regimes.fit(groups[key], config)
        assert np.allclose([r.mean for r in rows], m.mean) and np.allclose([r.variance for r in rows], m.variance)


def test_all_paths():
    """Sums and maxima over every sequence of states of a short series."""
    x = series(7, 9)
    e = regimes.emissions(x, MODEL.mean, MODEL.variance)
    paths = list(itertools.product(range(3), repeat=7))
    weights = np.array([MODEL.start[p[0]] * e[0, p[0]] * np.prod([MODEL.transition[p[t - 1], p[t]] * e[t, p[t]] for t in range(1, 7)]) for p in paths])
    g, _, _, ll = regimes.posterior(e, MODEL)
    assert np.isclose(ll, np.log(weights.sum()))
    assert np.allclose(g, [[weights[[p[t] == s for p in paths]].sum() / weights.sum() for s in range(3)] for t in range(7)])
    assert tuple(regimes.viterbi(e, MODEL)) == paths[int(weights.argmax())]
    cuts = [(0, 2), (2, 3), (3, 7)]
    parts, best = ([regimes.element(e[a:b], MODEL, a == 0, total) for a, b in cuts] for total in (np.logaddexp.reduce, np.max))
    assert np.isclose(regimes.chained(MODEL.start, parts, best)[3], ll)
    assert np.isclose((np.log(MODEL.start) + regimes.element(e, MODEL, True, np.max).T).max(), np.log(weights.max()))


def test_impossible_states():
    """A model that never goes back: probabilities that vanish in a block do not lose the series."""
    one_way = regimes.HMM(np.array([1.0, 0.0]), np.array([[0.9, 0.1], [0.0, 1.0]]), np.array([0.0, 40.0]), np.array([1.0, 1.0]))
    x = np.concatenate([np.zeros(50), np.full(50, 40.0)])
    e = regimes.emissions(x, one_way.mean, one_way.variance)
    whole = regimes.posterior(e, one_way)
    cuts = [(a, a + 20) for a in range(0, 100, 20)]
    parts, best = ([regimes.element(e[a:b], one_way, a == 0, total) for a, b in cuts] for total in (np.logaddexp.reduce, np.max))
    enter, leave, _, ll = regimes.chained(one_way.start, parts, best)
    got = np.vstack([regimes.posterior(e[a:b], one_way, enter[i] if i else None, leave[i])[0] for i, (a, b) in enumerate(cuts)])
    assert np.allclose(got, whole[0]) and np.isclose(ll, whole[3]) and (got.argmax(1) == (x > 20)).all()


def test_no_rows_and_other_states(data):
    _, frame = data
    assert regimes.regime_probabilities(frame.limit(0)).count() == 0 and regimes.regime_parameters(frame.where("triplet_id = 'few'")).count() == 0
    two = regimes.regime_probabilities(frame.where("triplet_id = 'two'"), config=regimes.HMMConfig(n_states=2, max_iter=3), block=10)
    first = two.first()
    assert first.mean_reverting_probability is None and first.viterbi_regime in ("state_0", "state_1") and two.count() == 24
