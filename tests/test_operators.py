"""Hand-computed values and differential checks of the reference operators on small frames."""

import datetime as dt
import math
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.functions.expressions import adf_p_value, wilson
from tercet.guards import MissingColumns
from tercet.operators import backtest, cleaning, events, hedges, kalman, metrics, models, portfolio, regimes, reports, residuals, stationarity
from tercet.sources import catalog

DAY = dt.date(2024, 1, 1)


def scored(spark, zs):
    rows = [("T_A_B", "m", DAY + dt.timedelta(k), None if z is None else z / 10, z) for k, z in enumerate(zs)]
    return spark.createDataFrame(rows, "triplet_id string, method string, date date, residual double, z_score double")


@pytest.mark.parametrize(
    ("zs", "hold", "want"),
    [
        ([-0.5, 1.9, 2.6, 2.0, 0.9, 0.7, 0.45], 9, [(1, "reversion", 4)]),  # back within 0.5 four rows on
        ([1.0, -2.5, -2.9, -2.2, -3.3], 9, [(0, "stop_loss", 3)]),  # a long spread that falls on
        ([0.2, 2.05, 1.5, 1.6, 1.7], 2, [(0, "max_holding_period", 2)]),  # neither within two rows
        ([0.2, 1.0, 2.05], 5, [(0, "no_forward_observations", 0)]),  # the last row
        ([0.3, 2.4, 0.1, 0.0, -2.1, -3.0, 0.0], 6, [(1, "reversion", 1), (0, "stop_loss", 1)]),
        ([0.3, 2.4, None, 2.2, 0.2], 6, [(1, "reversion", 3)]),  # a row without a score is passed over
    ],
)
def test_first_passage(spark, zs, hold, want):
    config = events.LabelingConfig(max_holding_period=hold)
    s = scored(spark, zs)
    got = events.label_events(s, events.candidate_events(s, config), config).orderBy("event_date").collect()
    assert [(r.label, r.exit_reason, r.holding_period) for r in got] == want
    both = events.labelled_crossings(s, config)
    assert both.select(*events.LABELS).orderBy("event_date").collect() == got
    assert sorted(map(tuple, both.select(*events.event_columns(both)).collect())) == sorted(map(tuple, events.candidate_events(s, config).collect()))


def test_labelling_guards(spark):
    with pytest.raises(ValueError):
        events.LabelingConfig(exit_z=2.5)
    with pytest.raises(MissingColumns):
        events.candidate_events(spark.range(1))


def test_cleaning(spark):
    raw = spark.createDataFrame([("A", DAY, 10.0, 1), ("A", DAY, 10.5, 2), ("A", DAY + dt.timedelta(1), None, 3), ("A", DAY + dt.timedelta(2), -1.0, 4), ("A", DAY + dt.timedelta(3), 21.0, 5)], "symbol string, date date, adj_close double, ingest_seq int")
    clean = cleaning.clean_prices(raw)
    assert [(r.adj_close, r.quality_flag) for r in clean.orderBy("date").collect()] == [(10.5, "clean"), (None, "invalid_price"), (-1.0, "invalid_price"), (21.0, "clean")]
    tied = spark.createDataFrame([("A", DAY, p, 7, v) for p, v in ((3.0, 1.0), (5.0, 1.0), (None, 9.0), (5.0, 2.0))], "symbol string, date date, adj_close double, ingest_seq int, volume double")
    assert [(r.adj_close, r.volume) for r in cleaning.clean_prices(tied.repartition(3)).collect()] == [(5.0, 2.0)]  # one result, whatever the order
    assert [r.simple_return for r in cleaning.daily_returns(clean).orderBy("date").collect()] == [None, 1.0]
    cover = {r.symbol: (r.row_count, r.clean_rows, r.coverage_ratio) for r in cleaning.coverage_report(clean, spark.createDataFrame([("A",), ("Z",)], "symbol string")).collect()}
    assert cover == {"A": (4, 2, 0.5), "Z": (0, 0, None)}


def observations(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = 4 + rng.normal(0, 0.1, (n, 2)).cumsum(0)
    y = -0.3 + 0.8 * x[:, 0] + 1.2 * x[:, 1] + rng.normal(0, 0.05, n)
    rows = [("Y_A_B", "Y", "A", "B", DAY + dt.timedelta(k), float(y[k]), float(x[k, 0]), float(x[k, 1])) for k in range(n)]
    return x, y, spark.createDataFrame(rows, "triplet_id string, target_symbol string, hedge_symbol_1 string, hedge_symbol_2 string, date date, y double, x1 double, x2 double")


def test_rolling_regression_looks_back_only(spark):
    x, y, obs = observations(spark, 40)
    got = hedges.rolling_ols(obs, 12).orderBy("date").collect()
    assert len(got) == 28 and got[0].train_end == DAY + dt.timedelta(11)
    for k, r in enumerate(got):
        b = np.linalg.lstsq(np.column_stack([np.ones(12), x[k : k + 12]]), y[k : k + 12], rcond=None)[0]
        assert np.allclose([r.alpha, r.beta_1, r.beta_2], b, atol=1e-7)
    later = obs.withColumn("y", F.when(F.col("date") > DAY + dt.timedelta(30), F.col("y") + 9).otherwise(F.col("y")))
    again = hedges.rolling_ols(later, 12).orderBy("date").collect()
    assert [r.beta_1 for r in again[:19]] == [r.beta_1 for r in got[:19]]
    agree = hedges.compare_backends(hedges.kernel_rolling(obs, 12), hedges.kernel_rolling(obs, 12, "pandas")).collect()
    assert all(r.max_abs_diff < 1e-7 and r.n_compared == 28 for r in agree)


def test_kalman_starts_from_the_fit(spark):
    x, y, obs = observations(spark, 90)
    got = kalman.kalman_regression(obs, kalman.KalmanConfig(process_noise=0.0, initial_window=20)).orderBy("date").collect()
    b = np.linalg.lstsq(np.column_stack([np.ones(20), x[:20]]), y[:20], rcond=None)[0]
    assert len(got) == 70 and math.isclose(got[0].residual, y[20] - b @ [1, *x[20]], abs_tol=1e-9)


def test_z_scores_and_autocorrelation(spark):
    s = scored(spark, [1.0, 2.0, 4.0, 3.0, 9.0])
    z = [r.z_score for r in residuals.z_score(s.drop("z_score"), 3).orderBy("date").collect()]
    assert z[:3] == [None] * 3 and math.isclose(z[3], (0.3 - 0.7 / 3) / np.std([0.1, 0.2, 0.4], ddof=1))
    assert residuals.autocorrelation(scored(spark, [1.0] * 5)).first().autocorrelation is None
    r = residuals.summary(scored(spark, [2.0])).first()
    assert r.residual_std == 0.0 and r.autocorr_1 is None


def test_stationarity(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=1000)
    ar = np.zeros(1000)
    for t in range(1, 1000):
        ar[t] = 0.5 * ar[t - 1] + noise[t]
    walk = np.random.default_rng(1).normal(size=1000).cumsum()
    both = spark.createDataFrame([(g, k, float(v)) for g, x in (("ar", ar), ("walk", walk)) for k, v in enumerate(x)], "g string, k int, v double")
    tau = {r.g: r.adf_statistic for r in stationarity.adf_by_group(both, "v", ["g"], "k").collect()}
    assert tau["ar"] < -3.43 and tau["walk"] > -2.86
    taus = [-6.0, -3.43, -2.86, -2.57, -1.0, 0.0, 2.0]
    p = [r.p for r in spark.createDataFrame([(t,) for t in taus], "t double").select(adf_p_value("t").alias("p")).collect()]
    assert p == sorted(p) and math.isclose(p[1], 0.01) and math.isclose(p[3], 0.10)
    bh = stationarity.benjamini_hochberg(spark.createDataFrame([(x,) for x in (0.001, 0.02, 0.03, 0.04, 0.9)], "p double"), "p", 0.05)
    assert sorted(r.p for r in bh.where("fdr_reject").collect()) == [0.001, 0.02, 0.03, 0.04]
    assert stationarity.fractional_weights(1.0) == [1.0, -1.0] and stationarity.fractional_weights(0.0) == [1.0]


def events_frame(spark):
    rows = [("e1", "short_spread", 2.5, 0.25, 1, 0.9), ("e2", "long_spread", -2.0, -0.5, 1, 0.64), ("e3", "short_spread", 2.25, 3.5, 0, 0.6), ("e4", "long_spread", -3.0, -2.5, 0, 0.1)]
    rows = [(i, "T_A_B", "m", DAY, DAY + dt.timedelta(k), s, y, "o", "r", 3, a, b, p) for k, (i, s, a, b, y, p) in enumerate(rows)]
    both = spark.createDataFrame(rows, "event_id string, triplet_id string, method string, event_date date, exit_date date, side string, label int, outcome string, exit_reason string, holding_period int, entry_z_score double, exit_z_score double, predicted_reversion_probability double")
    return both.drop("predicted_reversion_probability"), both.select("event_id", "predicted_reversion_probability")


def test_backtest(spark):
    labels, predictions = events_frame(spark)
    e = backtest.prepare_events(labels, predictions)
    trades = backtest.strategy_trades(e, 0.6, 0.05)
    by = {s: {r.event_id: r for r in trades.where(F.col("strategy") == s).collect()} for s in backtest.STRATEGIES}
    assert {k: round(r.spread_pnl_units, 6) for k, r in by["baseline_rule_based"].items()} == {"e1": 2.25, "e2": 1.5, "e3": -1.25, "e4": 0.5}
    assert set(by["ml_filtered"]) == {"e1", "e2"} and by["ml_probability_sized"]["e2"].position_size == 0.64
    a = backtest.avoided_trades(e, 0.6).first()
    assert (a.avoided_trade_count, a.avoided_failure_count) == (2, 2)
    dear = backtest.cost_sensitivity(e, (backtest.Cost("a"), backtest.Cost("b", 0.1))).collect()
    net = {(r.cost_scenario, r.strategy): r.net_pnl for r in dear}
    assert all(net["b", s] < net["a", s] for s in backtest.STRATEGIES)
    with pytest.raises(Exception, match="one to one"):
        backtest.prepare_events(labels, predictions.union(predictions)).collect()
    with pytest.raises(ValueError):
        backtest.Grid(entry_thresholds=(3.0,), stop_loss_levels=(2.5,))


def test_portfolio(spark):
    low, high = (spark.range(1).select(c.alias("x")).first().x for c in wilson(F.lit(20), F.lit(20)))
    assert low < 1 and high == 1.0
    with pytest.raises(ValueError):
        wilson(F.lit(1), F.lit(2), 0.5)
    days = [(DAY + dt.timedelta(k), p) for k, p in ((0, 2.0), (100, 2.1), (200, 1.9), (364, 2.0), (5, 9.0))]  # the last is a Saturday
    t = spark.createDataFrame([("s", d, p, p, 2.0) for d, p in days], "strategy string, pnl_date date, net_pnl double, gross_pnl double, turnover double")
    calendar = [DAY + dt.timedelta(k) for k in range(365)]
    daily = np.array([{d: p for d, p in days[:4]}.get(d, 0.0) for d in calendar if d.weekday() < 5])
    r = portfolio.performance(t).first()
    assert math.isclose(r.sharpe, np.sqrt(252) * daily.mean() / daily.std(ddof=1), rel_tol=1e-9) and r.net_pnl == 17.0
    c = portfolio.shared_leg_clusters(spark.createDataFrame([(x,) for x in ("A_P_Q", "B_Q_R", "C_X_Y", "bad")], "triplet_id string")).orderBy("cluster_id").collect()
    assert [(x.triplets, x.shared_legs, x.independent_bet) for x in c] == [(["A_P_Q", "B_Q_R"], ["Q"], False), (["C_X_Y"], [], True)]
    sized = spark.createDataFrame([(0.01,), (0.02,), (0.05,), (0.0,)], "v double").select(portfolio.volatility_target("v").alias("s")).collect()
    assert [round(x.s, 6) for x in sized] == [2.0, 1.0, 0.4, 3.0]


def test_metrics(spark):
    p = spark.createDataFrame([(0, 0.1), (0, 0.7), (1, 0.8), (1, 0.2)], "label int, predicted_reversion_probability double")
    r = metrics.classification_summary(p).first()
    assert (r.true_positive, r.false_positive, r.true_negative, r.false_negative) == (1, 1, 1, 1) and r.roc_auc == 0.75
    assert metrics.trapezoid_auc(p).first().roc_auc == 0.75 and metrics.confusion_matrix(p).count() == 4
    assert metrics.probability_buckets(p, 3).agg(F.sum("n_events")).first()[0] == 4


def test_models(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 2))
    rows = spark.createDataFrame([(f"e{k}", int(x[k, 0] > 0), float(x[k, 0]), float(x[k, 1])) for k in range(160)], "event_id string, label int, a double, b double")
    plain, strong = (models.fit_logistic(rows, ["a", "b"], models.LogisticConfig(max_iter=500, l2=l2)).first() for l2 in (0.0, 50.0))
    assert plain.losses[-1] < plain.losses[0] and np.abs(strong.coefficients).sum() < np.abs(plain.coefficients).sum()
    root = models.fit_tree(rows, ["a", "b"]).where("node_id = 0").first()
    assert root.feature == "a" and abs(root.threshold) < 0.2


def test_regimes():
    rng = np.random.default_rng(42)
    m = regimes.fit(np.concatenate([rng.normal(0, 0.3, 40), rng.normal(2, 0.3, 40), rng.normal(0, 3, 40)]))
    assert np.allclose(m.transition.sum(1), 1) and set(regimes.regime_labels(m.mean, m.variance)) == set(regimes.REGIMES)


def test_named_sql(spark):
    text = "-- name: a\nSELECT x FROM t;\n-- name: b\n\n-- name: c\nSELECT count(*) AS n FROM a_view"
    assert list(catalog.parse_named_queries(text)) == ["a", "c"]
    got = catalog.run_named(spark, text, {"t": spark.range(3).select(F.col("id").alias("x"))}, "-- name: a_view\nSELECT x FROM t WHERE x > 0")
    assert got["c"].first().n == 2 and catalog.check_results(got).where("status = 'fail'").count() == 2


def test_checks(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "b")], "k int, name string")
    parent = spark.createDataFrame([(1,), (3,)], "id int")
    lost = reports.missing_references(child, parent, {"k": "id"}, ("name",), counted=True).collect()
    assert sorted(map(tuple, lost)) == [("b", 2), ("c", 1)]  # a null refers to nothing
    assert [tuple(r) for r in reports.repeated_keys(child, ("k", "name")).collect()] == [(2, "b", 2)]
    p = spark.createDataFrame([("a", -0.1), ("b", 1.0), ("c", None), ("d", float("nan"))], "id string, p double")
    assert sorted(r.id for r in reports.outside(p, "p", 0.0, 1.0, ("id",)).collect()) == ["a", "c", "d"]
    assert [r.id for r in reports.missing_values(p, ("id", "p")).collect()] == ["c"]
    t = {"model_predictions": spark.createDataFrame([(x, 1) for x in (0.0, 0.2, 0.79, 1.0, None)], "predicted_reversion_probability double, label int")}
    assert {r.probability_bucket: r.n_predictions for r in reports.bucket_report(t).collect()} == {"0.00-0.20": 1, "0.20-0.40": 1, "0.60-0.80": 1, "0.80-1.00": 2}
    assert set(reports.VIEWS) >= {"v_hmm_latest_regime", "v_kalman_state_summary", "v_required_table_row_counts"} and len(reports.CHECKS) == 15 and len(reports.REPORTS) == 10


def test_catalog(spark):
    c = catalog.Catalog(spark, f"catalog_test_{os.getpid()}")
    c.initialize({"assets": "symbol string, sector string", "empty": "x int"})
    assert c.exists("assets") and c.table("empty").count() == 0
    assert c.append(spark.createDataFrame([(7, "A")], "other int, symbol string"), "assets") == 1 and c.append(spark.createDataFrame([], "symbol string"), "assets") == 0
    c.initialize({"assets": "symbol string, sector string"}, {"assets_seen": lambda t: t["assets"].select("symbol")})
    assert [tuple(r) for r in spark.table("assets_seen").collect()] == [("A",)] and c.run("-- name: q\nSELECT sector FROM assets")["q"].collect()[0].sector is None
    with pytest.raises(MissingColumns):
        c.store(spark.range(1), "triplets")
    assert c.tables() == ["assets", "empty"]
    spark.sql(f"DROP DATABASE {c.database} CASCADE")


def test_places_by_time(spark):
    rows = [(f"e{k:02d}", DAY + dt.timedelta(k // 3)) for k in range(20)]
    df = spark.createDataFrame(rows, "event_id string, event_date date").repartition(5)
    split = {r.event_id: r.split for r in models.time_split(df).collect()}
    assert [split[i] for i, _ in rows] == ["train"] * 12 + ["validation"] * 4 + ["test"] * 4
    folds: dict = {}
    for r in models.walk_forward(df, 8, 4, 4).collect():
        folds.setdefault((r.fold, r.role), []).append(r.event_id)
    ids = [i for i, _ in rows]
    assert {k: sorted(v) for k, v in folds.items()} == {(f, role): (ids[: 8 + 4 * f] if role == "train" else ids[8 + 4 * f : 12 + 4 * f]) for f in range(3) for role in ("train", "validation")}


def test_collinear_hedges(spark):
    """Expressions give null where hedges are collinear or constant; the fallback gives the least-norm solution."""
    x, y, obs = observations(spark, 40)
    same = obs.withColumn("x2", 2 * F.col("x1"))
    flat = obs.withColumn("x1", F.lit(0.1))
    assert all(r.beta_1 is None for df in (same, flat) for r in hedges.rolling_ols(df, 12).collect())
    got = hedges.kernel_rolling_with_fallback(same, 12).where("alpha is not null").collect()
    assert len(got) == 28 and all(math.isclose(r.beta_2, 2 * r.beta_1, rel_tol=1e-6) for r in got)
    assert {r.backend for r in hedges.benchmark_kernels(obs, 12, 1).collect()} == {"expr", "pandas"}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_points_without_the_llm_folders(tmp_path):
    """The driver deletes the subpackage, its tests and the pipeline; what is left must work, with or without the last."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name, gone in (("a", ("llm",)), ("b", ("llm", "corpus_pipeline.py"))):
        shutil.copytree(root, tmp_path / name, ignore=shutil.ignore_patterns(".git", "spark-warehouse", "__pycache__", *gone))
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline']"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / name, check=True, env={**os.environ, "PYTHONPATH": ""})
