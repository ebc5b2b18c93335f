"""Residual diagnostics and z-scores; baselines end before the scored row unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tercet.functions.expressions import correlation, over, rows
from tercet.guards import require, require_columns

GROUP = ["triplet_id", "method"]


def residual(actual: str = "actual_log_price", fitted: str = "fitted_log_price"):
    """actual - fitted."""
    return F.col(actual) - F.col(fitted)


def autocorrelation(df: DataFrame, value: str = "residual", lag: int = 1, by: list[str] | None = None, order: str = "date") -> DataFrame:
    """by columns and autocorrelation: of each group's values with those `lag` rows before; null where constant."""
    by = by or GROUP
    w = Window.partitionBy(*by).orderBy(order)
    pairs = df.where(F.col(value).isNotNull()).withColumn("__l", F.lag(value, lag).over(w))
    return pairs.groupBy(*by).agg(correlation(F.col(value), F.col("__l")).alias("autocorrelation"))


def autocorrelations(df: DataFrame, value: str = "residual", max_lag: int = 20, by: list[str] | None = None, order: str = "date") -> DataFrame:
    """by columns, lag, autocorrelation for lags from 1 to `max_lag`, in one pass over one window."""
    by = by or GROUP
    w = Window.partitionBy(*by).orderBy(order)
    x = F.col(value)
    base = df.where(x.isNotNull()).select(*by, x.alias("x"), *(F.lag(value, k).over(w).alias(f"l{k}") for k in range(1, max_lag + 1)))
    got = base.groupBy(*by).agg(*(correlation(F.col("x"), F.col(f"l{k}")).alias(str(k)) for k in range(1, max_lag + 1)))
    return got.unpivot(by, [str(k) for k in range(1, max_lag + 1)], "lag", "autocorrelation").withColumn("lag", F.col("lag").cast("int"))


def summary(df: DataFrame, by: list[str] | None = None, order: str = "date") -> DataFrame:
    """Counts, moments, exact quantiles and the lag-1 autocorrelation of residuals; the spread of one value is 0."""
    by = by or GROUP
    require_columns(df, [*by, order, "residual"])
    r = F.col("residual")
    base = df.where(r.isNotNull()).withColumn("__l", F.lag(r).over(Window.partitionBy(*by).orderBy(order)))
    q = lambda p: F.percentile(r, F.lit(p))
    return base.groupBy(*by).agg(
        F.count("*").alias("n_obs"), F.avg(r).alias("residual_mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("residual_std"), F.avg(F.abs(r)).alias("residual_abs_mean"),
        F.min(r).alias("residual_min"), q(0.05).alias("residual_q05"), q(0.5).alias("residual_median"), q(0.95).alias("residual_q95"), F.max(r).alias("residual_max"),
        correlation(r, F.col("__l")).alias("autocorr_1"),
    )


def compare_stability(df: DataFrame, order: str = "date") -> DataFrame:
    """summary() with each triplet's ratios to its initial-window method."""
    s = summary(df, order=order)
    base = s.where("method = 'static_ols_initial_window'").select("triplet_id", F.col("residual_std").alias("static_residual_std"), F.col("residual_abs_mean").alias("static_abs_mean"))
    got = s.join(base, "triplet_id", "left")
    return got.withColumn("std_ratio_vs_static", over("residual_std", "static_residual_std")).withColumn("abs_mean_ratio_vs_static", over("residual_abs_mean", "static_abs_mean"))


def z_score(df: DataFrame, window: int | None = 60, min_periods: int | None = None, value: str = "residual", by: list[str] | None = None, order: str = "date", out: str = "z_score", current: bool = False) -> DataFrame:
    """`out`: the distance from the mean of the rows before, in their standard deviations.

    window None expands from the group's first row; min_periods rows with a value are needed (default: the whole
    window); current=True takes the row itself into its baseline; a constant baseline gives null.
    """
    require(window is None or window > 1, "window must exceed 1")
    require(min_periods is None or min_periods > 1, "min_periods must exceed 1")
    end = 0 if current else -1
    w = rows(by or GROUP, order, Window.unboundedPreceding if window is None else -window + (1 if current else 0), end)
    need = min_periods if min_periods is not None else window or 2
    z = over(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return df.withColumn(out, F.when(F.count(value).over(w) >= need, z))


def event_z_scores(residuals: DataFrame, window: int | None = 60, min_periods: int = 20, rescore: bool = True) -> DataFrame:
    """Residuals with z_score; rescore=False keeps a z_score column that is there."""
    if not rescore and "z_score" in residuals.columns:
        return residuals
    return z_score(residuals.drop("z_score"), window, min_periods)
