"""Overviews of the canonical tables, reports on them, and checks of their references, keys, ranges and required values.

Everything is a function from tables by name to a frame.  A check gives the rows at fault; one that gives none passes.
The names of overviews, reports and checks and their output columns are fixed values, which users of the tables rely on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.functions.expressions import over
from tercet.sources.catalog import KEYS, row_counts

Tables = Mapping[str, DataFrame]
Report = Callable[[Tables], DataFrame]


def table_counts(tables: Tables) -> DataFrame:
    """table_name, row_count of the canonical tables."""
    some = next(iter(tables.values()))
    return row_counts(some.sparkSession, {t: tables[t] for t in KEYS}).select("table_name", "row_count")


def _mean(column: str, name: str) -> Column:
    return F.avg(F.col(column).cast("double")).alias(name)


def pipeline_coverage(tables: Tables) -> DataFrame:
    """Each triplet's days, events, labels, predictions and trades; every branch is counted before it is joined."""
    owner = tables["candidate_events"].select("event_id", "triplet_id")
    branches = {
        "residual_days": tables["residuals"].select("triplet_id", F.col("date").alias("k")), "candidate_events": owner.select("triplet_id", F.col("event_id").alias("k")),
        "labeled_events": tables["event_labels"].select("triplet_id", F.col("event_id").alias("k")), "model_predictions": tables["model_predictions"].join(owner, "event_id").select("triplet_id", F.col("prediction_id").alias("k")),
        "trades": tables["trades"].join(owner, "event_id").select("triplet_id", F.col("trade_id").alias("k")),
    }
    got = tables["triplets"].select("triplet_id", "target_symbol", "hedge_symbol_1", "hedge_symbol_2")
    for name, rows in branches.items():
        got = got.join(rows.distinct().groupBy("triplet_id").agg(F.count("k").alias(name)), "triplet_id", "left")
    return got.fillna(0, list(branches))


def success_rates(labels: DataFrame, n: str = "n_events", failures: bool = True) -> DataFrame:
    """Counts and the share of successes by triplet and method."""
    hits, all_ = F.sum(F.col("label").cast("long")), F.count("*")
    more = [(all_ - hits).alias("failure_count")] if failures else []
    return labels.groupBy("triplet_id", "method").agg(all_.alias(n), hits.alias("success_count"), *more, over(hits, all_).alias("success_rate"))


def kalman_summary(tables: Tables) -> DataFrame:
    """Mean state and innovation variance of each filter."""
    on = ["date", "triplet_id", "method", "process_noise", "measurement_noise"]
    both = tables["kalman_states"].join(tables["kalman_residuals"].select(*on, "residual_variance"), on, "left")
    return both.groupBy("triplet_id", "method").agg(F.count("*").alias("n_obs"), *(_mean(c, f"avg_{c}") for c in ("alpha", "beta_1", "beta_2", "state_cov_trace", "residual_variance")))


def feature_labels(tables: Tables) -> DataFrame:
    """Labelled feature rows by method."""
    rows, y = tables["event_features"].where("label is not null"), F.col("label")
    return rows.groupBy("method").agg(F.count("*").alias("n_events"), F.count_if(y == 1).alias("success_count"), F.count_if(y == 0).alias("failure_count"), _mean("label", "success_rate"))


def split_importance(tables: Tables) -> DataFrame:
    """How often a tree splits on a feature, and what it gains."""
    gain = F.col("information_gain")
    return tables["tree_splits"].groupBy("feature").agg(F.count("*").alias("split_count"), F.sum(gain).alias("total_information_gain"), F.avg(gain).alias("average_information_gain"))


def latest_regimes(tables: Tables) -> DataFrame:
    """Each triplet's last date with regimes, and mean probabilities over all its dates."""
    p = ("mean_reverting_probability", "volatile_breakdown_probability")
    return tables["regime_probabilities"].groupBy("triplet_id").agg(F.max("date").alias("latest_date"), *(_mean(c, f"average_{c}") for c in p))


def prediction_splits(tables: Tables) -> DataFrame:
    """Mean probability, observed rate and predicted rate by split."""
    p = {"predicted_reversion_probability": "mean_predicted_reversion_probability", "label": "observed_success_rate", "predicted_label": "predicted_positive_rate"}
    return tables["model_predictions"].groupBy("split").agg(F.count("*").alias("n_events"), *(_mean(c, n) for c, n in p.items()))


def _columns(table: str, *columns: str) -> Report:
    return lambda tables: tables[table].select(*columns)


VIEWS: dict[str, Report] = {
    "v_required_table_row_counts": table_counts,
    "v_pipeline_coverage": pipeline_coverage,
    "v_latest_residual_method_summary": _columns("residual_method_summary", "triplet_id", "method", "n_obs", "residual_mean", "residual_std", "residual_abs_mean", "autocorr_1", "std_ratio_vs_static", "abs_mean_ratio_vs_static"),
    "v_kalman_state_summary": kalman_summary,
    "v_event_label_distribution": lambda t: t["event_labels"].groupBy("method", "outcome", "exit_reason").agg(F.count("*").alias("n_events")),
    "v_success_rate_by_triplet": lambda t: success_rates(t["event_labels"]),
    "v_feature_label_summary": feature_labels,
    "v_logistic_prediction_summary": prediction_splits,
    "v_model_evaluation_latest": _columns("model_evaluation", "split", "n_obs", "positive_rate", "threshold", "accuracy", "precision", "recall", "brier_score", "roc_auc", "true_positive", "false_positive", "true_negative", "false_negative"),
    "v_probability_bucket_success": _columns("probability_buckets", "split", "probability_bucket", "n_events", "mean_predicted_probability", "realized_success_rate", "precision"),
    "v_ml_backtest_strategy_comparison": _columns("backtest_summary", "strategy", "trade_count", "gross_pnl", "net_pnl", "win_rate", "turnover", "max_drawdown", "sharpe"),
    "v_decision_tree_split_importance": split_importance,
    "v_hmm_latest_regime": latest_regimes,
}


def price_coverage(tables: Tables) -> DataFrame:
    """First, last and number of clean prices of every asset, also of those without any."""
    per = tables["prices_clean"].groupBy("symbol").agg(F.min("date").alias("first_clean_date"), F.max("date").alias("last_clean_date"), F.count("date").alias("clean_price_rows"))
    return tables["assets"].select("symbol", "asset_type").join(per, "symbol", "left").fillna(0, ["clean_price_rows"])


def run_summary(tables: Tables) -> DataFrame:
    """Predictions of known runs by run and split."""
    known = tables["model_predictions"].join(tables["model_runs"].select("model_run_id", "model_type"), "model_run_id")
    return known.groupBy("model_run_id", "model_type", "split").agg(F.count("*").alias("n_predictions"), _mean("predicted_reversion_probability", "average_predicted_probability"), _mean("label", "realized_success_rate"))


def bucket_report(tables: Tables, n: int = 5) -> DataFrame:
    """Predictions in `n` left-closed buckets of probability; the last also holds 1 and rows without a probability."""
    k = F.coalesce(F.least(F.floor(F.col("predicted_reversion_probability") * n), F.lit(n - 1)), F.lit(n - 1))
    name = F.format_string("%.2f-%.2f", k / n, (k + 1) / n).alias("probability_bucket")
    return tables["model_predictions"].groupBy(name).agg(F.count("*").alias("n_predictions"), _mean("predicted_reversion_probability", "average_predicted_probability"), _mean("label", "realized_success_rate"))


REPORTS: dict[str, Report] = {
    "pipeline_row_counts": table_counts,
    "asset_price_coverage": price_coverage,
    "triplet_pipeline_coverage": pipeline_coverage,
    "residual_diagnostics_report": _columns("residual_diagnostics", "triplet_id", "method", "n_obs", "residual_mean", "residual_std", "residual_autocorr_1", "half_life_estimate"),
    "event_success_by_triplet": lambda t: success_rates(t["event_labels"], "labeled_events", failures=False),
    "model_prediction_summary": run_summary,
    "probability_bucket_report": bucket_report,
    "strategy_performance_report": _columns("performance_summary", "strategy", "model_run_id", "period_start", "period_end", "trade_count", "win_rate", "total_net_pnl", "max_drawdown", "sharpe", "turnover"),
    "daily_pnl_report": _columns("pnl_daily", "date", "strategy", "gross_pnl", "transaction_cost", "net_pnl", "equity", "drawdown", "turnover"),
    "trade_audit_report": _columns("trades", "trade_id", "event_id", "strategy", "entry_date", "exit_date", "side", "predicted_reversion_probability", "position_size", "gross_pnl", "transaction_cost", "net_pnl", "exit_reason"),
}


@dataclass(frozen=True)
class Reference:
    """Rows of `child` must have one of `parent`: its columns `keys` name them.  `show` are the columns of rows that have
    none; counted: how many rows, by those columns."""

    child: str
    parent: str
    keys: dict[str, str]
    show: tuple[str, ...]
    counted: bool = False


def missing_references(child: DataFrame, parent: DataFrame, keys: dict[str, str], show: tuple[str, ...], counted: bool = False) -> DataFrame:
    """The rows of `child` whose `keys` (child column: parent column) no row of `parent` has."""
    known = parent.select(*(F.col(p).alias(c) for c, p in keys.items()))
    lost = child.join(known, list(keys), "left_anti").select(*show)
    return lost.groupBy(*show).agg(F.count("*").alias("row_count")) if counted else lost


def repeated_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def outside(df: DataFrame, column: str, low: float, high: float, show: tuple[str, ...]) -> DataFrame:
    """Rows whose `column` is null or not within [low, high]."""
    return df.where(~F.coalesce(F.col(column).between(low, high), F.lit(False))).select(*show)


def missing_values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`columns` of the rows that lack one of them."""
    return df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))).select(*columns)


def missing_legs(tables: Tables) -> DataFrame:
    """Triplets with a leg that is no asset: one pass over legs, whatever their number."""
    legs = ("target_symbol", "hedge_symbol_1", "hedge_symbol_2")
    long = tables["triplets"].select("triplet_id", *legs, F.explode(F.array(*legs)).alias("symbol"))
    return long.join(tables["assets"].select("symbol"), "symbol", "left_anti").select("triplet_id", *legs).distinct()


EVENT = {"event_id": "event_id"}
REFERENCES: dict[str, Reference] = {
    "clean_prices_without_assets": Reference("prices_clean", "assets", {"symbol": "symbol"}, ("symbol",), True),
    "returns_without_clean_prices": Reference("returns_daily", "prices_clean", {"symbol": "symbol", "date": "date"}, ("symbol", "date")),
    "residuals_without_triplets": Reference("residuals", "triplets", {"triplet_id": "triplet_id"}, ("triplet_id",), True),
    "candidate_events_without_residuals": Reference("candidate_events", "residuals", {"triplet_id": "triplet_id", "method": "method", "event_date": "date"}, ("event_id", "triplet_id", "method", "event_date")),
    "event_features_without_candidate_events": Reference("event_features", "candidate_events", EVENT, ("event_id", "triplet_id", "event_date")),
    "event_labels_without_candidate_events": Reference("event_labels", "candidate_events", EVENT, ("event_id", "triplet_id", "event_date")),
    "model_predictions_without_model_runs": Reference("model_predictions", "model_runs", {"model_run_id": "model_run_id"}, ("prediction_id", "model_run_id")),
    "model_predictions_without_candidate_events": Reference("model_predictions", "candidate_events", EVENT, ("prediction_id", "event_id")),
    "trades_without_candidate_events": Reference("trades", "candidate_events", EVENT, ("trade_id", "event_id")),
    "positions_without_trades": Reference("positions", "trades", {"trade_id": "trade_id"}, ("position_id", "trade_id")),
}
REPEATS = {"duplicate_prices_clean_keys": ("prices_clean", ("symbol", "date")), "duplicate_model_predictions": ("model_predictions", ("model_run_id", "event_id", "split"))}
PROBABILITY, PNL = "predicted_reversion_probability", ("date", "strategy", "net_pnl", "equity")

CHECKS: dict[str, Report] = {
    "triplet_symbols_missing_from_assets": missing_legs,
    **{name: lambda t, r=r: missing_references(t[r.child], t[r.parent], r.keys, r.show, r.counted) for name, r in REFERENCES.items()},
    "model_prediction_probability_bounds": lambda t: outside(t["model_predictions"], PROBABILITY, 0.0, 1.0, ("prediction_id", PROBABILITY)),
    "pnl_missing_required_values": lambda t: missing_values(t["pnl_daily"], PNL),
    **{name: lambda t, table=table, keys=keys: repeated_keys(t[table], keys) for name, (table, keys) in REPEATS.items()},
}


def run(reports: dict[str, Report], tables: Tables) -> dict[str, DataFrame]:
    """Every report over `tables`, lazily."""
    return {name: report(tables) for name, report in reports.items()}
