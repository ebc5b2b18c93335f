"""Overviews, reports and checks as queries over tables with planted faults, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.operators import cleaning, features, hedges, kalman, metrics, models, portfolio, regimes, reports, residuals
from tercet.plans.frames import Frames, rounded
from tercet.plans.model_queries import _ALL_BUCKETS, _EVALUATION, _M, _NOISE, MODEL_COLUMNS
from tercet.plans.oracle import REGIME, SUMMARY, part, query, r
from tercet.sources import catalog
from tercet.sources.stages import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}

# The same tables in SQL: assets lack a symbol, prices have repeated days, returns a stray day, and so on.
_TABLES = {
    "assets": "SELECT symbol, 'equity' AS asset_type FROM c_symbols WHERE symbol <> 'ECONOMY'",
    "prices_raw": "SELECT * FROM c_raw",
    "prices_clean": "SELECT symbol, date, adj_close FROM c_clean UNION ALL SELECT symbol, date, adj_close FROM c_clean WHERE date < DATE '1995-01-20'",
    "returns_daily": "SELECT symbol, date FROM c_returns UNION ALL SELECT 'NONE', DATE '1999-01-01'",
    "triplets": "SELECT * FROM c_triplets WHERE triplet_id <> 'SMALL_ECONOMY_LARGE'",
    "regression_results": "SELECT triplet_id FROM c_full",
    "residuals": "SELECT triplet_id, method, date FROM c_scored WHERE triplet_id <> 'LARGE_ECONOMY_MEDIUM'",
    "residual_diagnostics": "SELECT s.*, autocorr_1 AS residual_autocorr_1, h.half_life_estimate FROM c_summary s JOIN (SELECT triplet_id, method, arg_max_null(half_life_estimate, date) AS half_life_estimate FROM c_resid_panel GROUP BY triplet_id, method) h USING (triplet_id, method)",
    "residual_method_summary": "SELECT s.*, s.residual_std / nullif(b.residual_std, 0) AS std_ratio_vs_static, s.residual_abs_mean / nullif(b.residual_abs_mean, 0) AS abs_mean_ratio_vs_static FROM c_summary s LEFT JOIN c_summary b ON b.triplet_id = s.triplet_id AND b.method = 'static_ols_initial_window'",
    "hedge_ratios": "SELECT triplet_id, method, date, beta_1, beta_2 FROM c_coef",
    "kalman_states": f"SELECT triplet_id, method, date, {_NOISE}, alpha, beta_1, beta_2, state_cov_trace FROM c_filtered",
    "kalman_residuals": f"SELECT triplet_id, method, date, {_NOISE}, residual_variance FROM c_filtered WHERE triplet_id <> 'LARGE_ECONOMY_MEDIUM'",
    "regime_probabilities": "SELECT triplet_id, date, mean_reverting_probability, volatile_breakdown_probability FROM c_regimes",
    "tree_splits": f"SELECT [{', '.join(repr(c) for c in _M)}][f] AS feature, gain AS information_gain FROM c_tree_nodes WHERE f IS NOT NULL",
    "candidate_events": "SELECT event_id, triplet_id, method, event_date FROM c_events WHERE entry_abs_z < 3.2",
    "event_features": "SELECT event_id, triplet_id, event_date, method, label FROM c_matrix",
    "event_labels": "SELECT * FROM c_labels",
    "model_runs": "SELECT 'run_validation' AS model_run_id, 'fixed' AS model_type UNION ALL SELECT 'run_test', 'fixed'",
    "model_predictions": "SELECT event_id || '_' || split AS prediction_id, 'run_' || split AS model_run_id, event_id, split, CASE WHEN predicted_reversion_probability > 0.72 THEN NULL ELSE predicted_reversion_probability END AS predicted_reversion_probability, predicted_label, label FROM c_preds UNION ALL SELECT event_id || '_again', 'run_' || split, event_id, split, 0.5, 1, label FROM c_preds WHERE split = 'test' AND label = 1",
    "model_evaluation": _EVALUATION,
    "probability_buckets": _ALL_BUCKETS,
    "trades": "SELECT event_id || '_' || strategy AS trade_id, event_id, strategy, event_date AS entry_date, exit_date, side, predicted_reversion_probability, position_size, gross_pnl, transaction_cost, net_pnl, exit_reason FROM c_trades",
    "positions": "SELECT event_id || '_' || strategy || '_p' AS position_id, event_id || '_' || strategy || CASE WHEN holding_period = 1 THEN '_lost' ELSE '' END AS trade_id FROM c_trades",
    "pnl_daily": "SELECT e.date, e.strategy, g.gross_pnl, g.transaction_cost, g.turnover, CASE WHEN drawdown < -20 THEN NULL ELSE daily_pnl END AS net_pnl, equity, drawdown FROM c_equity e JOIN (SELECT strategy, pnl_date AS date, sum(gross_pnl) AS gross_pnl, sum(transaction_cost) AS transaction_cost, sum(turnover) AS turnover FROM c_trades GROUP BY ALL) g USING (strategy, date)",
    "performance_summary": "SELECT p.*, net_pnl AS total_net_pnl, 'run_test' AS model_run_id, period_start, period_end FROM c_perf p JOIN (SELECT strategy, min(pnl_date) AS period_start, max(pnl_date) AS period_end FROM c_trades GROUP BY strategy) USING (strategy)",
    "backtest_summary": "SELECT * FROM c_perf",
}
for _name, _sql in _TABLES.items():
    part(f"d_{_name}", _sql)


class CanonicalTables(Mapping):
    """The canonical tables, with the same faults; each is made when it is asked for."""

    def __init__(self, f: Frames):
        self.f = f

    def __iter__(self):
        return iter(_TABLES)

    def __len__(self) -> int:
        return len(_TABLES)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)()

    @cached_property
    def filtered(self) -> DataFrame:
        return stored(kalman.kalman_regression(self.f.obs))

    def assets(self) -> DataFrame:
        return cleaning.assets_table(self.f.triplets).where("symbol <> 'ECONOMY'").select("symbol", "asset_type")

    def prices_raw(self) -> DataFrame:
        return self.f.raw

    def prices_clean(self) -> DataFrame:
        prices = self.f.clean.select("symbol", "date", "adj_close")
        return prices.union(prices.where("date < DATE '1995-01-20'"))

    def returns_daily(self) -> DataFrame:
        return cleaning.daily_returns(self.f.clean).select("symbol", "date").union(self.f.spark.sql("SELECT 'NONE', DATE '1999-01-01'"))

    def triplets(self) -> DataFrame:
        return self.f.triplets.where("triplet_id <> 'SMALL_ECONOMY_LARGE'")

    def regression_results(self) -> DataFrame:
        return hedges.static_fit(self.f.obs)[0]

    def residuals(self) -> DataFrame:
        return self.f.scored_table.where("triplet_id <> 'LARGE_ECONOMY_MEDIUM'").select("triplet_id", "method", "date")

    def residual_diagnostics(self) -> DataFrame:
        last = features.residual_panel(self.f.scored_table).groupBy("triplet_id", "method").agg(F.max_by("half_life_estimate", "date").alias("half_life_estimate"))
        return residuals.summary(self.f.scored_table).withColumnRenamed("autocorr_1", "residual_autocorr_1").join(last, ["triplet_id", "method"])

    def residual_method_summary(self) -> DataFrame:
        return residuals.compare_stability(self.f.scored_table)

    def hedge_ratios(self) -> DataFrame:
        return self.f.coefficients.select("triplet_id", "method", "date", "beta_1", "beta_2")

    def kalman_states(self) -> DataFrame:
        return self.filtered.select("triplet_id", "method", "date", "process_noise", "measurement_noise", "alpha", "beta_1", "beta_2", "state_cov_trace")

    def kalman_residuals(self) -> DataFrame:
        return self.filtered.where("triplet_id <> 'LARGE_ECONOMY_MEDIUM'").select("triplet_id", "method", "date", "process_noise", "measurement_noise", "residual_variance")

    def regime_probabilities(self) -> DataFrame:
        return regimes.regime_probabilities(self.f.scored_table, model=REGIME).select("triplet_id", "date", "mean_reverting_probability", "volatile_breakdown_probability")

    def tree_splits(self) -> DataFrame:
        return models.train_tree(self.f.matrix, MODEL_COLUMNS)["splits"].select("feature", "information_gain")

    def candidate_events(self) -> DataFrame:
        return self.f.events.where("entry_abs_z < 3.2").select("event_id", "triplet_id", "method", "event_date")

    def event_features(self) -> DataFrame:
        return self.f.matrix.select("event_id", "triplet_id", "event_date", "method", "label")

    def event_labels(self) -> DataFrame:
        return self.f.labels

    def model_runs(self) -> DataFrame:
        return self.f.spark.createDataFrame([("run_validation", "fixed"), ("run_test", "fixed")], "model_run_id string, model_type string")

    def model_predictions(self) -> DataFrame:
        p, run = F.col(models.P), F.concat(F.lit("run_"), "split").alias("model_run_id")
        first = self.f.predictions.select(F.concat_ws("_", "event_id", "split").alias("prediction_id"), run, "event_id", "split", F.when(p <= 0.72, p).alias(models.P), "predicted_label", "label")
        again = self.f.predictions.where("split = 'test' and label = 1").select(F.concat("event_id", F.lit("_again")), run, "event_id", "split", F.lit(0.5), F.lit(1), "label")
        return first.union(again)

    def model_evaluation(self) -> DataFrame:
        return metrics.classification_summary(self.f.predictions, 0.5, "split")

    def probability_buckets(self) -> DataFrame:
        return metrics.probability_buckets(self.f.predictions, 5, "split")

    def trades(self) -> DataFrame:
        return self.f.trades.select(F.concat_ws("_", "event_id", "strategy").alias("trade_id"), "event_id", "strategy", F.col("event_date").alias("entry_date"), "exit_date", "side", models.P, "position_size", "gross_pnl", "transaction_cost", "net_pnl", "exit_reason")

    def positions(self) -> DataFrame:
        trade = F.concat_ws("_", "event_id", "strategy")
        return self.f.trades.select(F.concat(trade, F.lit("_p")).alias("position_id"), F.concat(trade, F.when(F.col("holding_period") == 1, "_lost").otherwise("")).alias("trade_id"))

    def pnl_daily(self) -> DataFrame:
        return portfolio.daily_table(self.f.trades).withColumn("net_pnl", F.when(F.col("drawdown") >= -20, F.col("net_pnl")))

    def performance_summary(self) -> DataFrame:
        return portfolio.performance_table(self.f.trades, "run_test")

    def backtest_summary(self) -> DataFrame:
        return portfolio.performance(self.f.trades)


def _sql(select: str, doubles: tuple[str, ...] = ()) -> str:
    return query(f"SELECT * {'REPLACE (' + r(*doubles, digits=5) + ')' if doubles else ''} FROM ({select}) q")


_RATES = "count(*) AS {n}, avg(predicted_reversion_probability) AS {p}, avg(label) AS {y}"
_COVERAGE = {
    "residual_days": "SELECT triplet_id, date AS k FROM d_residuals", "candidate_events": "SELECT triplet_id, event_id AS k FROM d_candidate_events", "labeled_events": "SELECT triplet_id, event_id AS k FROM d_event_labels",
    "model_predictions": "SELECT triplet_id, prediction_id AS k FROM d_model_predictions JOIN d_candidate_events USING (event_id)", "trades": "SELECT triplet_id, trade_id AS k FROM d_trades JOIN d_candidate_events USING (event_id)",
}
_COVERAGE_SQL = _sql("SELECT triplet_id, target_symbol, hedge_symbol_1, hedge_symbol_2, " + ", ".join(f"(SELECT count(DISTINCT k) FROM ({s}) b WHERE b.triplet_id = t.triplet_id) AS {n}" for n, s in _COVERAGE.items()) + " FROM d_triplets t")
_COUNTS_SQL = query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM d_{t}" for t in catalog.KEYS))
_SUCCESS = "SELECT triplet_id, method, count(*) AS {n}, count(*) FILTER (label = 1) AS success_count, {f} avg(label) AS success_rate FROM d_event_labels GROUP BY ALL"
_BACKTEST = ("gross_pnl", "net_pnl", "win_rate", "turnover", "max_drawdown", "sharpe")
_VIEW_SQL = {
    "v_required_table_row_counts": _COUNTS_SQL,
    "v_pipeline_coverage": _COVERAGE_SQL,
    "v_latest_residual_method_summary": _sql(f"SELECT triplet_id, method, n_obs, {', '.join(SUMMARY[:3])}, autocorr_1, std_ratio_vs_static, abs_mean_ratio_vs_static FROM d_residual_method_summary", (*SUMMARY[:3], "autocorr_1", "std_ratio_vs_static", "abs_mean_ratio_vs_static")),
    "v_kalman_state_summary": _sql("SELECT s.triplet_id, s.method, count(*) AS n_obs, avg(alpha) AS avg_alpha, avg(beta_1) AS avg_beta_1, avg(beta_2) AS avg_beta_2, avg(state_cov_trace) AS avg_state_cov_trace, avg(residual_variance) AS avg_residual_variance FROM d_kalman_states s LEFT JOIN d_kalman_residuals k USING (triplet_id, method, date, process_noise, measurement_noise) GROUP BY ALL", tuple(f"avg_{c}" for c in ("alpha", "beta_1", "beta_2", "state_cov_trace", "residual_variance"))),
    "v_event_label_distribution": _sql("SELECT method, outcome, exit_reason, count(*) AS n_events FROM d_event_labels GROUP BY ALL"),
    "v_success_rate_by_triplet": _sql(_SUCCESS.format(n="n_events", f="count(*) FILTER (label = 0) AS failure_count,"), ("success_rate",)),
    "v_feature_label_summary": _sql("SELECT method, count(label) AS n_events, count(*) FILTER (label = 1) AS success_count, count(*) FILTER (label = 0) AS failure_count, avg(label) AS success_rate FROM d_event_features GROUP BY ALL HAVING count(label) > 0", ("success_rate",)),
    "v_logistic_prediction_summary": _sql(f"SELECT split, {_RATES.format(n='n_events', p='mean_predicted_reversion_probability', y='observed_success_rate')}, avg(predicted_label) AS predicted_positive_rate FROM d_model_predictions GROUP BY ALL", ("mean_predicted_reversion_probability", "observed_success_rate", "predicted_positive_rate")),
    "v_model_evaluation_latest": _sql("SELECT split, n_obs, positive_rate, threshold, accuracy, precision, recall, brier_score, roc_auc, true_positive, false_positive, true_negative, false_negative FROM d_model_evaluation", ("positive_rate", "accuracy", "precision", "recall", "brier_score", "roc_auc")),
    "v_probability_bucket_success": _sql("SELECT split, probability_bucket, n_events, mean_predicted_probability, realized_success_rate, precision FROM d_probability_buckets", ("mean_predicted_probability", "realized_success_rate", "precision")),
    "v_ml_backtest_strategy_comparison": _sql(f"SELECT strategy, trade_count, {', '.join(_BACKTEST)} FROM d_backtest_summary", _BACKTEST),
    "v_decision_tree_split_importance": _sql("SELECT feature, count(*) AS split_count, sum(information_gain) AS total_information_gain, avg(information_gain) AS average_information_gain FROM d_tree_splits GROUP BY ALL", ("total_information_gain", "average_information_gain")),
    "v_hmm_latest_regime": _sql("SELECT triplet_id, CAST(max(date) AS VARCHAR) AS latest_date, avg(mean_reverting_probability) AS average_mean_reverting_probability, avg(volatile_breakdown_probability) AS average_volatile_breakdown_probability FROM d_regime_probabilities GROUP BY ALL", ("average_mean_reverting_probability", "average_volatile_breakdown_probability")),
}
_REPORT_SQL = {
    "pipeline_row_counts": _COUNTS_SQL,
    "asset_price_coverage": _sql("SELECT a.symbol, a.asset_type, CAST(lo AS VARCHAR) AS first_clean_date, CAST(hi AS VARCHAR) AS last_clean_date, coalesce(n, 0) AS clean_price_rows FROM d_assets a LEFT JOIN (SELECT symbol, min(date) AS lo, max(date) AS hi, count(*) AS n FROM d_prices_clean GROUP BY ALL) p USING (symbol)"),
    "triplet_pipeline_coverage": _COVERAGE_SQL,
    "residual_diagnostics_report": _sql("SELECT triplet_id, method, n_obs, residual_mean, residual_std, residual_autocorr_1, half_life_estimate FROM d_residual_diagnostics", ("residual_mean", "residual_std", "residual_autocorr_1", "half_life_estimate")),
    "event_success_by_triplet": _sql(_SUCCESS.format(n="labeled_events", f=""), ("success_rate",)),
    "model_prediction_summary": _sql(f"SELECT model_run_id, model_type, split, {_RATES.format(n='n_predictions', p='average_predicted_probability', y='realized_success_rate')} FROM d_model_predictions JOIN d_model_runs USING (model_run_id) GROUP BY ALL", ("average_predicted_probability", "realized_success_rate")),
    "probability_bucket_report": _sql(f"SELECT format('{{:.2f}}-{{:.2f}}', b / 5, (b + 1) / 5) AS probability_bucket, {_RATES.format(n='n_predictions', p='average_predicted_probability', y='realized_success_rate')} FROM (SELECT *, coalesce(least(4, floor(predicted_reversion_probability * 5)), 4) AS b FROM d_model_predictions) GROUP BY ALL", ("average_predicted_probability", "realized_success_rate")),
    "strategy_performance_report": _sql("SELECT strategy, model_run_id, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, trade_count, win_rate, total_net_pnl, max_drawdown, sharpe, turnover FROM d_performance_summary", ("win_rate", "total_net_pnl", "max_drawdown", "sharpe", "turnover")),
    "daily_pnl_report": _sql("SELECT CAST(date AS VARCHAR) AS date, strategy, gross_pnl, transaction_cost, net_pnl, equity, drawdown, turnover FROM d_pnl_daily", ("gross_pnl", "transaction_cost", "net_pnl", "equity", "drawdown", "turnover")),
    "trade_audit_report": _sql("SELECT * REPLACE (CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date) FROM d_trades", ("predicted_reversion_probability", "position_size", "gross_pnl", "transaction_cost", "net_pnl")),
}


def _reference_sql(x: reports.Reference) -> str:
    on = " AND ".join(f"a.{c} = b.{p}" for c, p in x.keys.items())
    show = ", ".join(f"CAST(a.{c} AS VARCHAR) AS {c}" if "date" in c else f"a.{c}" for c in x.show)
    return f"SELECT {show}{', count(*) AS row_count' if x.counted else ''} FROM d_{x.child} a ANTI JOIN d_{x.parent} b ON {on}{' GROUP BY ALL' if x.counted else ''}"


_CHECKS = {
    "triplet_symbols_missing_from_assets": "SELECT triplet_id, target_symbol, hedge_symbol_1, hedge_symbol_2 FROM d_triplets WHERE NOT list_has_all((SELECT list(symbol) FROM d_assets), [target_symbol, hedge_symbol_1, hedge_symbol_2])",
    **{name: _reference_sql(x) for name, x in reports.REFERENCES.items()},
    "model_prediction_probability_bounds": "SELECT prediction_id, round(predicted_reversion_probability, 5) + 0.0 AS predicted_reversion_probability FROM d_model_predictions WHERE coalesce(predicted_reversion_probability, -1) NOT BETWEEN 0 AND 1",
    "pnl_missing_required_values": "SELECT CAST(date AS VARCHAR) AS date, strategy, round(net_pnl, 5) + 0.0 AS net_pnl, round(equity, 5) + 0.0 AS equity FROM d_pnl_daily WHERE date IS NULL OR net_pnl + equity IS NULL OR strategy IS NULL",
    **{name: f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' if c == 'date' else c for c in keys)}, count(*) AS row_count FROM d_{t} GROUP BY ALL HAVING row_count > 1" for name, (t, keys) in reports.REPEATS.items()},
}


def _register(kind: str, builders: dict[str, Callable], sql: dict[str, str]) -> None:
    for name, build in builders.items():
        QUERIES[f"{kind}_{name}"] = lambda spark, sf_dir, build=build: rounded(build(CanonicalTables(Frames(spark, sf_dir))), 5)
        SQL[f"{kind}_{name}"] = sql[name]


_register("view", reports.VIEWS, _VIEW_SQL)
_register("report", reports.REPORTS, _REPORT_SQL)
_register("check", reports.CHECKS, {name: query(s) for name, s in _CHECKS.items()} | {})
QUERIES["check_required_table_row_counts"] = QUERIES["view_v_required_table_row_counts"]
SQL["check_required_table_row_counts"] = _COUNTS_SQL


def _validation(f: Frames) -> DataFrame:
    return catalog.check_results(reports.run(reports.CHECKS, CanonicalTables(f)))


QUERIES["io11_row_counts"] = lambda spark, sf_dir: catalog.row_counts(spark, dict(CanonicalTables(Frames(spark, sf_dir))) | {"missing": None}).fillna(-1)
SQL["io11_row_counts"] = query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, true AS \"exists\" FROM d_{t}" for t in _TABLES) + " UNION ALL SELECT 'missing', -1, false")
QUERIES["io14_validation_results"] = lambda spark, sf_dir: _validation(Frames(spark, sf_dir))
SQL["io14_validation_results"] = query(" UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) AS issue_count, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({s}) q" for n, s in _CHECKS.items()))
KEYED = ("assets", "prices_clean", "triplets", "model_predictions")
QUERIES["io14_key_checks"] = lambda spark, sf_dir: catalog.key_checks({t: CanonicalTables(Frames(spark, sf_dir))[t] for t in KEYED})
SQL["io14_key_checks"] = query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(CASE WHEN n > 1 THEN 1 END) AS repeated_keys, 0::BIGINT AS null_keys FROM (SELECT count(*) AS n FROM d_{t} GROUP BY {', '.join(catalog.KEYS[t])})" for t in KEYED))
NAMED = "-- name: long_spreads\nSELECT method, count(*) AS n FROM event_labels WHERE side = 'long_spread' GROUP BY method;\n-- name: exits\nSELECT exit_reason, count(*) AS n FROM event_labels JOIN candidate_events USING (event_id) GROUP BY exit_reason;"
QUERIES["io13_named_queries"] = lambda spark, sf_dir: _named(Frames(spark, sf_dir))
SQL["io13_named_queries"] = query("SELECT 'long_spreads' AS query_name, method AS grp, count(*) AS n FROM d_event_labels WHERE side = 'long_spread' GROUP BY ALL UNION ALL SELECT 'exits', exit_reason, count(*) FROM d_event_labels SEMI JOIN d_candidate_events USING (event_id) GROUP BY ALL")


def _named(f: Frames) -> DataFrame:
    got = catalog.run_named(f.spark, NAMED, CanonicalTables(f))
    return got["long_spreads"].select(F.lit("long_spreads").alias("query_name"), F.col("method").alias("grp"), "n").union(got["exits"].select(F.lit("exits"), "exit_reason", "n"))
