"""As-of features of events: what was known at an event's date, and nothing after it.

Panels are windows over residuals, coefficients and the market calendar; the matrix joins them to events by date.
Trailing windows of market features count calendar rows (a missing value takes its place); those of residual features
count the residual rows themselves.  Events off the calendar see the last calendar date before them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.functions.expressions import correlation, over, rows
from tercet.guards import require, require_columns
from tercet.operators.ordered import as_of, quantiles
from tercet.sources.stages import dealt

GROUP = ["triplet_id", "method"]


# The windows, and the names of the feature columns below.
@dataclass(frozen=True)
class FeatureConfig:
    """Rows in each trailing window; market_symbol is the one whose return stands for the market."""

    residual_window: int = 20
    volatility_window: int = 20
    stability_window: int = 20
    correlation_window: int = 20
    moving_average_window: int = 20
    min_periods: int = 5
    market_symbol: str = "QQQ"


RESIDUAL_FEATURES = ["residual_change", "residual_volatility", "residual_autocorrelation", "half_life_estimate", "rolling_r_squared"]
COEFFICIENT_FEATURES = ["beta_1", "beta_2", "beta_1_stability", "beta_2_stability", "beta_stability"]
MARKET_FEATURES = [
    "target_return_volatility", "anchor_1_return_volatility", "anchor_2_return_volatility", "market_return", "sector_return", "target_anchor_1_correlation", "target_anchor_2_correlation",
    "anchor_correlation", "correlation_stability", "recent_drawdown", "distance_from_moving_average", "volume_shock",
]
METADATA = ["event_id", "triplet_id", "method", "event_date", "target_symbol", "hedge_symbol_1", "hedge_symbol_2", "side"]
LABELS = ["label", "outcome", "exit_reason", "holding_period"]


def residual_panel(scored: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """triplet_id, method, date, residual, z_score and RESIDUAL_FEATURES, the current row included."""
    require_columns(scored, [*GROUP, "date", "residual", "z_score", "actual_log_price", "fitted_log_price"])
    n, least = config.residual_window, config.min_periods
    w, pairs = rows(GROUP, "date", -(n - 1), 0), rows(GROUP, "date", -(n - 2), 0)
    x, y = F.col("residual"), F.col("actual_log_price")
    base = dealt(scored, "triplet_id").select(*GROUP, "date", "residual", "z_score", "actual_log_price", "fitted_log_price", F.lag("residual").over(Window.partitionBy(*GROUP).orderBy("date")).alias("l"))
    base = base.withColumn("residual_change", x - F.col("l"))
    base = base.withColumn("my", F.when(F.count(y).over(w) >= least, F.avg(y).over(w))).withColumn("q", (y - F.col("my")) ** 2)
    enough = F.count(x).over(w) >= least
    slope = over(F.covar_pop("residual_change", "l").over(pairs), F.var_pop(F.when(x.isNotNull(), F.col("l"))).over(pairs))
    return base.select(
        *GROUP, "date", "residual", "z_score", "residual_change", F.when(F.count("residual_change").over(w) >= least, F.stddev_samp("residual_change").over(w)).alias("residual_volatility"),
        F.when(enough, correlation(x, F.col("l"), pairs)).alias("residual_autocorrelation"), F.when(enough & (slope < 0), F.lit(-math.log(2)) / slope).alias("half_life_estimate"),
        F.when(F.count("q").over(w) >= least, 1 - over(F.sum((y - F.col("fitted_log_price")) ** 2).over(w), F.sum("q").over(w))).alias("rolling_r_squared"),
    )


def coefficient_panel(coefficients: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """triplet_id, method, date and COEFFICIENT_FEATURES: the spread of each slope and the norm of both."""
    w = rows(GROUP, "date", -(config.stability_window - 1), 0)
    spread = lambda c: F.when(F.count(c).over(w) >= config.min_periods, F.stddev_samp(c).over(w))
    got = coefficients.select(*GROUP, "date", "beta_1", "beta_2", spread("beta_1").alias("beta_1_stability"), spread("beta_2").alias("beta_2_stability"))
    return got.withColumn("beta_stability", F.sqrt(F.col("beta_1_stability") ** 2 + F.col("beta_2_stability") ** 2))


def market_grid(market: DataFrame) -> DataFrame:
    """symbol, date, simple_return, log_price, volume on every calendar date of every symbol; gaps are null."""
    require_columns(market, ["symbol", "date", "simple_return", "log_price", "volume"])
    grid = market.select("date").distinct().crossJoin(market.select("symbol").distinct())  # dates x symbols: the panel's own size
    return grid.join(market.select("symbol", "date", "simple_return", "log_price", "volume"), ["symbol", "date"], "left")


def symbol_panel(grid: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """symbol, date and what one symbol's trailing window says: volatility, last return, drawdown, distance, shock."""
    vol, avg = (rows("symbol", "date", -(n - 1), 0) for n in (config.volatility_window, config.moving_average_window))
    so_far = rows("symbol", "date", Window.unboundedPreceding, 0)
    now = lambda c, w: F.last(c, ignorenulls=True).over(w)
    price = now("log_price", avg)
    high = F.max("log_price").over(avg)
    held = F.filter(F.collect_list("volume").over(vol), lambda v: v.isNotNull())  # at most a window's values
    base = grid.select(
        "symbol", "date", F.when(F.count("simple_return").over(vol) >= 2, F.stddev_samp("simple_return").over(vol)).alias("return_volatility"), now("simple_return", so_far).alias("last_return"),
        F.when(high != 0, F.exp(price - high) - 1).alias("recent_drawdown"), (price - F.avg("log_price").over(avg)).alias("distance_from_moving_average"), held.alias("v"),
    )
    sorted_ = F.array_sort(F.slice("v", 1, F.size("v") - 1))
    base = base.withColumn("v", F.when(F.size("v") >= 2, F.struct(F.element_at("v", -1).alias("now"), sorted_.alias("before"))))
    k = F.size("v.before")
    median = (F.element_at("v.before", ((k + 1) / 2).cast("int")) + F.element_at("v.before", (k / 2).cast("int") + 1)) / 2
    return base.select("symbol", "date", "return_volatility", "last_return", "recent_drawdown", "distance_from_moving_average", F.when(median > 0, F.col("v.now") / median - 1).alias("volume_shock"))


def pair_panel(grid: DataFrame, pairs: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """a, b, date, correlation (3 or more complete pairs), rolling (min_periods or more) for the symbol pairs (a, b)."""
    w = rows(["a", "b"], "date", -(config.correlation_window - 1), 0)
    r = lambda s: grid.select(F.col("symbol").alias(s), "date", F.col("simple_return").alias(f"r_{s}"))
    both = pairs.select("a", "b").distinct().join(r("a"), "a").join(r("b"), ["b", "date"])
    whole = F.col("r_a").isNotNull() & F.col("r_b").isNotNull()
    n, c = F.count(F.when(whole, F.lit(1))).over(w), correlation(F.col("r_a"), F.col("r_b"), w)
    return both.select("a", "b", "date", F.when(n >= 3, c).alias("correlation"), F.when(n >= config.min_periods, c).alias("rolling"))


def as_of_dates(events: DataFrame, grid: DataFrame) -> DataFrame:
    """event_date, as_of: the last calendar date not after each event date."""
    return as_of(events.select("event_date").distinct(), grid.select("date").distinct(), [], "event_date", "date", [])


def market_features(events: DataFrame, market: DataFrame, config: FeatureConfig = FeatureConfig(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """event_id and MARKET_FEATURES; keep() may make stage tables of the panels, which several joins read."""
    grid = keep(market_grid(market))
    e = events.select("event_id", "event_date", "target_symbol", "hedge_symbol_1", "hedge_symbol_2").join(as_of_dates(events, grid), "event_date")
    s = keep(symbol_panel(grid, config))
    legs = (("target_symbol", "t"), ("hedge_symbol_1", "h1"), ("hedge_symbol_2", "h2"))
    one = e
    for role, short in legs:
        one = one.join(s.select(F.col("symbol").alias(role), F.col("date").alias("as_of"), *(F.col(c).alias(f"{short}_{c}") for c in ("return_volatility", "last_return", *(("recent_drawdown", "distance_from_moving_average", "volume_shock") if short == "t" else ())))), [role, "as_of"], "left")
    one = one.join(s.where(F.col("symbol") == config.market_symbol).select(F.col("date").alias("as_of"), F.col("last_return").alias("market_return")), "as_of", "left")
    triples = events.select("target_symbol", "hedge_symbol_1", "hedge_symbol_2").distinct()
    pairs = triples.select(F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("target_symbol", "hedge_symbol_1"), ("target_symbol", "hedge_symbol_2"), ("hedge_symbol_1", "hedge_symbol_2"))))).alias("p")).select("p.*")
    p = keep(pair_panel(grid, pairs, config))
    for x, y, name in (("target_symbol", "hedge_symbol_1", "target_anchor_1_correlation"), ("target_symbol", "hedge_symbol_2", "target_anchor_2_correlation"), ("hedge_symbol_1", "hedge_symbol_2", "anchor_correlation")):
        one = one.join(p.select(F.col("a").alias(x), F.col("b").alias(y), F.col("date").alias("as_of"), F.col("correlation").alias(name)), [x, y, "as_of"], "left")
    w = rows(["t", "h1", "h2"], "date", -(config.stability_window - 1), 0)
    by = Window.partitionBy("t", "h1", "h2").orderBy("date")
    named = triples.select(F.col("target_symbol").alias("t"), F.col("hedge_symbol_1").alias("h1"), F.col("hedge_symbol_2").alias("h2"))
    both = named.join(p.select(F.col("a").alias("t"), F.col("b").alias("h1"), "date", F.col("rolling").alias("c1")), ["t", "h1"]).join(p.select(F.col("a").alias("t"), F.col("b").alias("h2"), "date", F.col("rolling").alias("c2")), ["t", "h2", "date"])
    mean = F.coalesce((F.col("c1") + F.col("c2")) / 2, "c1", "c2")
    both = both.withColumn("m", mean).withColumn("rn", F.row_number().over(by))
    stable = both.select(F.col("t").alias("target_symbol"), F.col("h1").alias("hedge_symbol_1"), F.col("h2").alias("hedge_symbol_2"), F.col("date").alias("as_of"), F.when((F.col("rn") >= config.min_periods + 2) & (F.count("m").over(w) >= 2), F.stddev_samp("m").over(w)).alias("correlation_stability"))
    one = one.join(stable, ["target_symbol", "hedge_symbol_1", "hedge_symbol_2", "as_of"], "left")
    return one.select(
        "event_id", F.col("t_return_volatility").alias("target_return_volatility"), F.col("h1_return_volatility").alias("anchor_1_return_volatility"), F.col("h2_return_volatility").alias("anchor_2_return_volatility"),
        "market_return", F.col("h1_last_return").alias("sector_return"), "target_anchor_1_correlation", "target_anchor_2_correlation", "anchor_correlation", "correlation_stability",
        F.col("t_recent_drawdown").alias("recent_drawdown"), F.col("t_distance_from_moving_average").alias("distance_from_moving_average"), F.col("t_volume_shock").alias("volume_shock"),
    )


def feature_matrix(events: DataFrame, scored: DataFrame, coefficients: DataFrame | None = None, market: DataFrame | None = None, labels: DataFrame | None = None, config: FeatureConfig = FeatureConfig(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row an event: METADATA, entry z-scores, residual, coefficient and market features, labels.

    Inputs that are not given leave their columns null; keep() is that of market_features().
    """
    e = events.select(*METADATA, "entry_z_score", "entry_abs_z")
    panel = residual_panel(scored, config).withColumnRenamed("date", "event_date")
    got = e.join(panel, [*GROUP, "event_date"], "left")
    if coefficients is not None:
        got = got.join(coefficient_panel(coefficients, config).withColumnRenamed("date", "event_date"), [*GROUP, "event_date"], "left")
    if market is not None:
        got = got.join(market_features(events, market, config, keep), "event_id", "left")
    if labels is not None:
        got = got.join(labels.select("event_id", *LABELS), "event_id", "left")
    want = [*METADATA, "entry_z_score", "entry_abs_z", "z_score", "residual", *RESIDUAL_FEATURES, *COEFFICIENT_FEATURES, *MARKET_FEATURES]
    kinds = {"label": "int", "holding_period": "int", "outcome": "string", "exit_reason": "string"}
    return got.select(*(F.col(c) if c in got.columns else F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in [*want, *LABELS]))


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns that are neither metadata, labels nor settings of the labelling."""
    out = {*METADATA, *LABELS, "entry_threshold", "exit_z", "stop_loss_z", "max_holding_period", "z_window", "event_row", "entry_residual"}
    return [c for c, t in df.dtypes if c not in out and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, value: one row for every cell of `columns`."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")


def summary_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature, count, mean, std, min, p25, median, p75, max."""
    v, cells = F.col("value"), _long(df, columns or numeric_features(df))
    middle = quantiles(cells, ["feature"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    sums = cells.groupBy("feature").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return sums.join(middle, "feature").select("feature", "count", "mean", "std", "min", "p25", "median", "p75", "max")


def missingness(df: DataFrame) -> DataFrame:
    """column, missing_count, missing_rate of all columns."""
    counts = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    got = counts.unpivot(["__n"], df.columns, "column", "missing_count")
    return got.select("column", "missing_count", over("missing_count", "__n").alias("missing_rate"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, min_non_null: int = 3) -> DataFrame:
    """feature_1, feature_2, correlation of all pairs (each once, with itself too), of pairwise complete rows.

    Every row is dealt out to its pairs, which are combined before the shuffle: one row a pair and task goes over it.
    Columns with fewer than `min_non_null` complete pairs are null.
    """
    cols = columns or numeric_features(df)
    rows_ = df.select(F.array(*(F.col(c).cast("double") for c in cols)).alias("v")).select("v", F.posexplode("v").alias("i", "x"))
    pairs = rows_.select("i", "x", F.posexplode(F.slice("v", F.col("i") + 1, len(cols))).alias("k", "y"))
    got = pairs.groupBy("i", (F.col("i") + F.col("k")).alias("j")).agg(F.count(F.col("x") + F.col("y")).alias("n"), correlation(F.col("x"), F.col("y")).alias("r"))
    name = F.array(*(F.lit(c) for c in cols))
    return got.select(F.get(name, F.col("i")).alias("feature_1"), F.get(name, F.col("j")).alias("feature_2"), F.when(F.col("n") >= min_non_null, F.col("r")).alias("correlation"))


def collinear_pairs(correlations: DataFrame, threshold: float = 0.85) -> DataFrame:
    """feature_1, feature_2, correlation, absolute_correlation of different features that reach the threshold."""
    require(0 < threshold <= 1, "threshold must be within (0, 1]")
    got = correlations.where("feature_1 <> feature_2").withColumn("absolute_correlation", F.abs("correlation"))
    return got.where(F.col("absolute_correlation") >= threshold)


def feature_outputs(matrix: DataFrame, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """The matrix with its statistics, missingness and correlations."""
    return {"feature_matrix": matrix, "feature_summary_statistics": summary_statistics(matrix, columns), "feature_missingness_report": missingness(matrix), "feature_correlation_matrix": correlation_matrix(matrix, columns)}


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, standard_deviation (of the population; 1 where it is 0 or there is no value)."""
    s = _long(df, columns).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("s"))
    return s.select("feature", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)).alias("standard_deviation"))


def scale(df: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """`df` with `columns` standardised by `fitted` (default: their own scaler)."""
    s = (fitted if fitted is not None else scaler(df, columns)).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "standard_deviation")))).alias("__s"))
    put: dict[str, Column] = {c: (F.col(c) - F.col("__s")[c]["mean"]) / F.col("__s")[c]["standard_deviation"] for c in columns}
    return df.crossJoin(F.broadcast(s)).withColumns(put).drop("__s")  # one row: two numbers for each column


def pairs_of(columns: list[str]) -> list[tuple[str, str]]:
    """All pairs of different columns."""
    return list(combinations(columns, 2))
