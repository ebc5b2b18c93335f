"""Queries from prices to labelled events, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.operators import cleaning, events, hedges, residuals
from tercet.plans.frames import CONFIG, WINDOW, Frames, rounded
from tercet.sources.stages import stored
from tercet.plans.oracle import CORR, SUMMARY, K, query, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, build: Callable[[Frames], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    """A query over Frames, rounded, and the select that it must agree with."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(Frames(spark, sf_dir)), digits)
    if sql is not None:
        SQL[name] = query(sql)


register("io16_unique_symbols", lambda f: cleaning.unique_symbols(f.triplets), "SELECT DISTINCT unnest([target_symbol, hedge_symbol_1, hedge_symbol_2]) AS symbol FROM c_triplets")
register("io17_assets_table", lambda f: cleaning.assets_table(f.triplets), "SELECT symbol, 'equity' AS asset_type, 'theme_' || lower(substr(symbol, 1, 3)) AS sector, 1 AS active FROM c_symbols")
register("io18_triplets_table", lambda f: cleaning.triplets_table(f.triplets), f"SELECT {K}, theme AS relationship_theme, 1 AS active FROM c_triplets")
register("cl1_clean_prices", lambda f: f.clean, f"SELECT symbol, date, {r('adj_close', 'volume', digits=9)}, source, quality_flag FROM c_clean", digits=9)
register("cl2_only_clean", lambda f: cleaning.only_clean(f.clean).groupBy("symbol").agg(F.count("*").alias("n")), "SELECT symbol, count(*) AS n FROM c_clean WHERE quality_flag = 'clean' GROUP BY symbol")
register("cl3_daily_returns", lambda f: cleaning.daily_returns(f.clean), f"SELECT symbol, date, {r('simple_return', 'log_return')} FROM c_returns")
register(
    "cl4_coverage_report",
    lambda f: cleaning.coverage_report(f.clean, cleaning.unique_symbols(f.triplets).union(f.spark.sql("SELECT 'ABSENT'"))),
    f"SELECT s.symbol, count(c.symbol) AS row_count, coalesce(sum(CAST(quality_flag = 'clean' AS BIGINT)), 0)::BIGINT AS clean_rows, {r('sum(CAST(quality_flag = $$clean$$ AS BIGINT)) / nullif(count(c.symbol), 0) AS coverage_ratio')} FROM (SELECT symbol FROM c_symbols UNION ALL SELECT 'ABSENT') s LEFT JOIN c_clean c ON c.symbol = s.symbol GROUP BY s.symbol",
)
register("cl5_log_prices", lambda f: cleaning.log_prices(f.clean), f"SELECT symbol, date, {r('ln(adj_close) AS log_price')} FROM c_clean WHERE quality_flag = 'clean'")
register("cl8_complete_cases", lambda f: f.obs, f"SELECT {K}, date, {r('y', 'x1', 'x2')} FROM c_obs")
register("cl10_percent_of_first", lambda f: cleaning.percent_of_first(f.panel, "vwap"), f"SELECT symbol, date, {r('vwap / first_value(vwap) OVER (PARTITION BY symbol ORDER BY date) * 100 AS indexed')} FROM c_panel")
register("panel_weekly", lambda f: f.panel, f"SELECT symbol, date, {r('vwap', 'volume', 'log_price')} FROM c_panel")

register("rg1_fit_ols", lambda f: hedges.fit(f.obs, ["triplet_id"]), f"SELECT triplet_id, {r('alpha', 'beta_1', 'beta_2', 'r_squared')}, n AS n_obs FROM c_full")
register("rg3_static_coefficients", lambda f: hedges.static_fit(f.obs)[0], f"SELECT {K}, {r('alpha', 'beta_1', 'beta_2', 'r_squared')}, n AS n_obs, 'static_ols' AS method FROM c_full")
register(
    "rg3_static_residuals",
    lambda f: hedges.static_fit(f.obs)[1].drop("window", "ridge_alpha"),
    f"SELECT {', '.join('o.' + k.strip() for k in K.split(','))}, date, 'static_ols_full_sample' AS method, {r('y AS actual_log_price', 'alpha + beta_1 * x1 + beta_2 * x2 AS fitted_log_price', 'y - (alpha + beta_1 * x1 + beta_2 * x2) AS residual')} FROM c_obs o JOIN c_full c USING (triplet_id)",
)
register(
    "rg4_static_out_of_sample",
    lambda f: hedges.static_out_of_sample(f.obs, WINDOW).drop("ridge_alpha"),
    f"SELECT {K}, date, method, {r('actual_log_price', 'fitted_log_price', 'residual')}, \"window\" FROM c_resid WHERE method = 'static_ols_initial_window'",
)
COEFFICIENTS = r("y", "x1", "x2", "alpha", "beta_1", "beta_2")
register("rg5_rolling_ols", lambda f: hedges.rolling_ols(f.obs, WINDOW), f"SELECT {K}, date, {COEFFICIENTS}, train_start, train_end, {WINDOW} AS \"window\", 'rolling_ols' AS method FROM c_ols")
register("rg6_ridge_fit", lambda f: hedges.fit(f.obs, ["triplet_id"], 2.5).drop("r_squared"), f"SELECT triplet_id, {r('alpha', 'beta_1', 'beta_2')}, n AS n_obs FROM c_ridge_full")
register("rg8_rolling_ridge", lambda f: hedges.rolling_ridge(f.obs, WINDOW, 1.0), f"SELECT {K}, date, {COEFFICIENTS}, train_start, train_end, {WINDOW} AS \"window\", 1.0::DOUBLE AS ridge_alpha, 'rolling_ridge' AS method FROM c_ridge")
register("rg9_dynamic_residuals", lambda f: f.residuals, f"SELECT {K}, date, method, {r('actual_log_price', 'fitted_log_price', 'residual')}, \"window\", ridge_alpha::DOUBLE AS ridge_alpha FROM c_resid")
register("rg10_fittable_triplets", lambda f: _fittable(f), "SELECT triplet_id, false AS skipped FROM c_triplets WHERE 'ECONOMY' NOT IN (target_symbol, hedge_symbol_1, hedge_symbol_2) UNION ALL SELECT triplet_id, true FROM c_triplets WHERE 'ECONOMY' IN (target_symbol, hedge_symbol_1, hedge_symbol_2)")
register("rg11_kernel_rolling", lambda f: hedges.kernel_rolling(_spine(f), WINDOW), f"SELECT triplet_id, date, {r('alpha', 'beta_1', 'beta_2', 'fitted_log_price', 'residual', digits=4)}, 'expr' AS backend FROM c_kernel", digits=4)
register("rg14_kernel_with_fallback", lambda f: hedges.kernel_rolling_with_fallback(_spine(f), WINDOW).drop("backend"), f"SELECT triplet_id, date, {r('alpha', 'beta_1', 'beta_2', 'fitted_log_price', 'residual', digits=4)} FROM c_kernel", digits=4)
register("rg16_kernel_benchmark", lambda f: hedges.benchmark_kernels(stored(_spine(f)), WINDOW, 2).select("backend", "repeats", (F.col("min_seconds") <= F.col("max_seconds")).alias("timed")), "SELECT unnest(['expr', 'pandas']) AS backend, 2 AS repeats, true AS timed")
register("rg12_residual_kernel", lambda f: hedges.residual_kernel(hedges.rolling_ols(f.obs, WINDOW)).select("triplet_id", "date", "fitted_log_price", "residual"), f"SELECT triplet_id, date, {r('fitted_log_price', 'residual')} FROM c_resid WHERE method = 'rolling_ols'")
register("rg15_compare_backends", lambda f: hedges.compare_backends(hedges.kernel_rolling(_spine(f), WINDOW), hedges.kernel_rolling(_spine(f), WINDOW, "pandas")).select("output_column", (F.col("max_abs_diff") < 1e-7).alias("agrees"), "n_compared"), "SELECT c AS output_column, true AS agrees, count(residual) AS n_compared FROM c_kernel, (SELECT unnest(['alpha', 'beta_1', 'beta_2', 'fitted_log_price', 'residual']) AS c) GROUP BY c")


def _fittable(f: Frames) -> DataFrame:
    ok, skipped = hedges.fittable(f.triplets, f.panel.where("symbol <> 'ECONOMY'"))
    return ok.select("triplet_id", F.lit(False).alias("skipped")).union(skipped.select("triplet_id", F.lit(True)))


def _spine(f: Frames) -> DataFrame:
    """All dates of the panel for every triplet; the first hedge is missing in every tenth week."""
    dates = f.panel.select("date").distinct().crossJoin(f.triplets.select("triplet_id", "target_symbol", "hedge_symbol_1", "hedge_symbol_2"))
    leg = lambda role, out: f.panel.select(F.col("symbol").alias(role), "date", F.col("log_price").alias(out))
    got = dates.join(leg("target_symbol", "y"), ["target_symbol", "date"], "left").join(leg("hedge_symbol_1", "x1"), ["hedge_symbol_1", "date"], "left").join(leg("hedge_symbol_2", "x2"), ["hedge_symbol_2", "date"], "left")
    return got.withColumn("x1", F.when(F.weekofyear("date") % 10 != 0, F.col("x1")))


register("rs1_residuals", lambda f: f.residuals.select("triplet_id", "method", "date", residuals.residual().alias("residual")), f"SELECT triplet_id, method, date, {r('residual')} FROM c_resid")
register("rs2_autocorrelation", lambda f: residuals.autocorrelation(f.residuals), f"SELECT triplet_id, method, {r('autocorr_1 AS autocorrelation')} FROM c_summary")
register("rs3_residual_summary", lambda f: residuals.summary(f.residuals), f"SELECT triplet_id, method, n_obs, {r(*SUMMARY)} FROM c_summary")
register(
    "rs4_compare_stability",
    lambda f: residuals.compare_stability(f.residuals),
    f"SELECT s.triplet_id, s.method, s.n_obs, {r(*('s.' + c + ' AS ' + c for c in SUMMARY))}, {r('b.residual_std AS static_residual_std', 'b.residual_abs_mean AS static_abs_mean', 's.residual_std / nullif(b.residual_std, 0) AS std_ratio_vs_static', 's.residual_abs_mean / nullif(b.residual_abs_mean, 0) AS abs_mean_ratio_vs_static')} FROM c_summary s LEFT JOIN c_summary b ON b.triplet_id = s.triplet_id AND b.method = 'static_ols_initial_window'",
)
_Z = "SELECT triplet_id, method, date, round(CASE WHEN count(residual) OVER w >= {n} THEN (residual - avg(residual) OVER w) / nullif(stddev_samp(residual) OVER w, 0) END, 6) + 0.0 AS z_score FROM c_resid WINDOW w AS (PARTITION BY triplet_id, method ORDER BY date ROWS BETWEEN {f})"
_z = lambda f, **kw: residuals.z_score(f.residuals, **kw).select("triplet_id", "method", "date", "z_score")
register("rs5_zscore_full_window", lambda f: _z(f, window=40), _Z.format(n=40, f="40 PRECEDING AND 1 PRECEDING"))
register("rs6_zscore_expanding", lambda f: _z(f, window=None, min_periods=20), _Z.format(n=20, f="UNBOUNDED PRECEDING AND 1 PRECEDING"))
register("rs7_event_z_scores", lambda f: f.scored.select("triplet_id", "method", "date", "z_score"), f"SELECT triplet_id, method, date, {r('z_score')} FROM c_scored")
register("rs8_zscore_with_current", lambda f: _z(f, window=None, min_periods=2, current=True), _Z.format(n=2, f="UNBOUNDED PRECEDING AND CURRENT ROW"))
register("rs9_zscore_inclusive", lambda f: _z(f, window=60, min_periods=20, current=True), _Z.format(n=20, f="59 PRECEDING AND CURRENT ROW"))
_ACF = " UNION ALL ".join(f"SELECT triplet_id, method, {k} AS lag, {r(CORR.format(a='residual', b='l') + ' AS autocorrelation')} FROM (SELECT triplet_id, method, residual, lag(residual, {k}) OVER (PARTITION BY triplet_id, method ORDER BY date) AS l FROM c_resid) GROUP BY triplet_id, method" for k in range(1, 21))
register("rs10_autocorrelations", lambda f: residuals.autocorrelations(f.residuals, max_lag=20), _ACF)

_EVENT = "entry_z_score", "entry_abs_z", "entry_residual"
register(
    "ev1_candidate_events",
    lambda f: f.events,
    f"SELECT event_id, triplet_id, method, event_date, target_symbol, hedge_symbol_1, hedge_symbol_2, side, {r(*_EVENT)}, 2.0::DOUBLE AS entry_threshold, 0.5::DOUBLE AS exit_z, 3.0::DOUBLE AS stop_loss_z, 20 AS max_holding_period, 60 AS z_window, event_row::INTEGER AS event_row FROM c_events",
)
register("ev2_event_ids", lambda f: events.candidate_events(f.scored, CONFIG, exact_ids=True).select("event_id"), "SELECT event_id FROM c_events")
register(
    "ev3_event_labels",
    lambda f: f.labels,
    f"SELECT event_id, triplet_id, method, event_date, exit_date, side, label, outcome, exit_reason, holding_period, {r(*_EVENT, 'exit_z_score', 'exit_residual')}, entry_threshold::DOUBLE AS entry_threshold, exit_z::DOUBLE AS exit_z, stop_loss_z::DOUBLE AS stop_loss_z, max_holding_period FROM c_labels",
)
_COUNTS = f"count(*) AS n_events, sum(label)::BIGINT AS success_count, (count(*) - sum(label))::BIGINT AS failure_count, {r('sum(label) / count(*) AS success_rate')}"
register("ev4_missing_paths", lambda f: _missing(f), "SELECT exit_reason, n FROM (VALUES ('missing_residual_path', 1), ('missing_event_date', 1)) AS t(exit_reason, n)")
register("ev6_label_summary", lambda f: events.label_summary(f.labels), f"SELECT triplet_id, method, {_COUNTS} FROM c_labels GROUP BY triplet_id, method")
register("ev6_label_totals", lambda f: events.label_summary(f.labels, []), f"SELECT {_COUNTS} FROM c_labels")
register("ev7_success_by_z_bucket", lambda f: events.success_by_z_bucket(f.labels), f"SELECT format('[{{:.1f}}, {{:.1f}})', floor(entry_abs_z * 2) / 2, floor(entry_abs_z * 2) / 2 + 0.5) AS z_bucket, {_COUNTS} FROM c_labels GROUP BY 1")
register("ev8_label_distribution", lambda f: events.label_distribution(f.labels), "SELECT outcome, count(*) AS count FROM c_labels GROUP BY outcome")


def _missing(f: Frames) -> DataFrame:
    """Labels of two events that have no path: one of an unknown triplet, one on a date that is not there."""
    one = f.events.orderBy("event_id").limit(1)
    lost = one.withColumn("triplet_id", F.lit("NONE")).union(one.withColumn("event_date", F.lit("1900-01-01").cast("date")))
    return events.label_events(f.scored, lost, CONFIG).groupBy("exit_reason").agg(F.count("*").cast("int").alias("n"))
