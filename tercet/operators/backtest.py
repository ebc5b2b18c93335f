"""Trades of three strategies on labelled events, costs, and sensitivity grids.

Strategies, cost scenarios and grids are small frames crossed with the events, so each sweep is one scan.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.functions.expressions import over
from tercet.guards import assert_rows, require, require_columns
from tercet.operators.metrics import robustness_summary
from tercet.operators.portfolio import performance

P = "predicted_reversion_probability"
STRATEGIES = ("baseline_rule_based", "ml_filtered", "ml_probability_sized")


@dataclass(frozen=True)
class Cost:
    """A cost scenario, in spread units a unit of position; borrowing is in basis points a day held."""

    scenario: str
    commission_per_trade: float = 0.0
    bid_ask_spread_proxy: float = 0.0
    slippage: float = 0.0
    borrow_cost_bps_per_day: float = 0.0

    def __post_init__(self) -> None:
        require(bool(self.scenario), "a cost scenario needs a name")
        require(min(self.commission_per_trade, self.bid_ask_spread_proxy, self.slippage, self.borrow_cost_bps_per_day) >= 0, "costs must not be negative")

    @property
    def per_unit(self) -> float:
        return self.commission_per_trade + self.bid_ask_spread_proxy + self.slippage


# The default cost scenarios.
DEFAULT_COSTS = (Cost("zero_cost"), Cost("low_cost", 0.005, 0.01, 0.005), Cost("base_cost", 0.01, 0.025, 0.015), Cost("high_cost", 0.02, 0.05, 0.03))


# The default grid.
@dataclass(frozen=True)
class Grid:
    """Thresholds to combine; every stop level must exceed every entry threshold that it meets."""

    entry_thresholds: tuple[float, ...] = (1.5, 2.0, 2.5)
    exit_thresholds: tuple[float, ...] = (0.25, 0.5, 0.75)
    stop_loss_levels: tuple[float, ...] = (2.75, 3.0, 3.5)
    max_holding_periods: tuple[int, ...] = (10, 15, 20)

    def __post_init__(self) -> None:
        require(all(getattr(self, f.name) for f in fields(self)), "a grid needs values")
        require(min(self.entry_thresholds) > 0 and min(self.exit_thresholds) >= 0 and min(self.max_holding_periods) > 0, "grid values out of range")
        require(min(self.stop_loss_levels) > max(self.entry_thresholds), "stop levels must exceed entry thresholds")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = list(product(self.entry_thresholds, self.exit_thresholds, self.stop_loss_levels, self.max_holding_periods))
        return spark.createDataFrame(rows, "entry_threshold double, exit_threshold double, stop_loss_level double, max_holding_period int")


def prepare_events(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels with their probabilities, one to one; pnl_date is the exit date, or the event's.

    Running it fails where an event_id repeats on either side or a probability is not within [0, 1].  Repeats are counted
    on the key that both sides are joined by, so that they need no shuffle of their own.
    """
    require_columns(labels, ["event_id", "event_date", "exit_date", "side", "entry_z_score", "exit_z_score"])
    require_columns(predictions, ["event_id", P])
    seen = lambda name: F.count("*").over(Window.partitionBy("event_id")).alias(name)
    split = ["split"] if "split" in predictions.columns else []
    got = labels.select("*", seen("__n")).join(predictions.select("event_id", P, *split, seen("__m")), "event_id")
    got = assert_rows(got, (F.col("__n") == 1) & (F.col("__m") == 1), "labels and predictions must match one to one").drop("__n", "__m")
    got = assert_rows(got, F.col(P).between(0.0, 1.0), "probabilities must be within [0, 1]")
    return got.withColumn("pnl_date", F.coalesce("exit_date", "event_date"))


def spread_pnl() -> Column:
    """Entry minus exit z-score for a short spread, the reverse for a long one; another side is an error."""
    short, long = F.col("entry_z_score") - F.col("exit_z_score"), F.col("exit_z_score") - F.col("entry_z_score")
    return F.when(F.col("side") == "short_spread", short).when(F.col("side") == "long_spread", long).otherwise(F.raise_error(F.lit("unknown side")).cast("double"))


def strategy_trades(events: DataFrame, threshold: float = 0.6, cost: float = 0.05, strategies: tuple[str, ...] = STRATEGIES, floor: float = 0.0, cap: float = 1.0) -> DataFrame:
    """The trades of all `strategies`, one scan: baseline takes all with size 1, the others probabilities above the
    threshold, with size 1 or the probability."""
    require(0 <= threshold <= 1, "threshold must be within [0, 1]")
    require(cost >= 0, "cost must not be negative")
    require(set(strategies) <= set(STRATEGIES), "unknown strategy")
    got = events.withColumn("strategy", F.explode(F.array(*(F.lit(s) for s in strategies)))).where((F.col("strategy") == STRATEGIES[0]) | (F.col(P) > threshold))
    size = F.when(F.col("strategy") == STRATEGIES[2], F.least(F.greatest(F.col(P), F.lit(floor)), F.lit(cap))).otherwise(F.lit(1.0))
    got = got.withColumn("spread_pnl_units", spread_pnl()).withColumn("position_size", size)
    return priced(got.withColumn("gross_pnl", F.col("position_size") * F.col("spread_pnl_units")), F.lit(cost))


def priced(trades: DataFrame, cost: Column) -> DataFrame:
    """Trades with transaction_cost, net_pnl and turnover at a cost a unit of position."""
    paid = cost * F.abs("position_size")
    return trades.withColumn("transaction_cost", paid).withColumn("net_pnl", F.col("gross_pnl") - F.col("transaction_cost")).withColumn("turnover", 2 * F.abs("position_size"))


def avoided_trades(events: DataFrame, threshold: float = 0.6, cost: float = 0.05) -> DataFrame:
    """One row on the events that the filter leaves out: counts, failure rate, what they would have earned."""
    p = events.where(F.col(P) <= threshold).withColumn("net", spread_pnl() - cost)
    fails = F.count_if(F.col("label") == 0)
    return p.agg(
        F.lit(threshold).alias("probability_threshold"), F.count("*").alias("avoided_trade_count"), fails.alias("avoided_failure_count"), F.count_if(F.col("label") == 1).alias("avoided_success_count"),
        over(fails, F.count("*")).alias("avoided_failure_rate"), F.coalesce(F.sum("net"), F.lit(0.0)).alias("avoided_baseline_net_pnl"), F.avg(P).alias("avoided_average_probability"),
    )


def trade_count_comparison(summary: DataFrame) -> DataFrame:
    """strategy, trade_count, trade_count_ratio to the baseline; null where that has none."""
    base = summary.where(F.col("strategy") == STRATEGIES[0]).agg(F.max("trade_count").alias("__b"))
    return summary.crossJoin(F.broadcast(base)).select("strategy", "trade_count", over("trade_count", "__b").alias("trade_count_ratio"))  # one row


def pnl_comparison(summary: DataFrame) -> DataFrame:
    """The PnL columns of a summary."""
    return summary.select("strategy", "gross_pnl", "net_pnl", "average_net_pnl", "max_drawdown", "sharpe")


def cost_frame(spark: SparkSession, costs: tuple[Cost, ...]) -> DataFrame:
    """The scenarios as rows, with total_cost_per_unit."""
    require(bool(costs), "at least one cost scenario is needed")
    return spark.createDataFrame([(*asdict(c).values(), c.per_unit) for c in costs], "cost_scenario string, commission_per_trade double, bid_ask_spread_proxy double, slippage double, borrow_cost_bps_per_day double, total_cost_per_unit double")


def apply_costs(trades: DataFrame, costs: tuple[Cost, ...]) -> DataFrame:
    """Every trade repriced under every scenario; borrowing is charged where trades have a holding period."""
    got = trades.crossJoin(F.broadcast(cost_frame(trades.sparkSession, costs)))  # as many rows as scenarios were given
    held = F.greatest(F.lit(0), F.col("holding_period")) if "holding_period" in trades.columns else F.lit(0)
    unit = F.col("total_cost_per_unit") + F.col("borrow_cost_bps_per_day") / 1e4 * held
    return priced(got, unit)


def cost_sensitivity(events: DataFrame, costs: tuple[Cost, ...] = DEFAULT_COSTS, threshold: float = 0.6) -> DataFrame:
    """performance() for each scenario and strategy, with the scenario's costs and the drag."""
    trades = apply_costs(strategy_trades(events, threshold, 0.0), costs)
    s = performance(trades, ["cost_scenario", "strategy"], calendar_by=["cost_scenario"])
    got = s.join(F.broadcast(cost_frame(events.sparkSession, costs)), "cost_scenario")
    drag = F.col("gross_pnl") - F.col("net_pnl")
    return got.select(*s.columns, "total_cost_per_unit", "commission_per_trade", "bid_ask_spread_proxy", "slippage", drag.alias("cost_drag"), drag.alias("gross_to_net_pnl_delta"))


def relabel(events: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Every event under every rule of the grid whose entry threshold it reaches, with label and scenario_exit_reason.

    Labels come from the recorded exit z-score and holding period; a success is neither stopped nor held too long.
    """
    require_columns(events, ["side", "entry_z_score", "exit_z_score", "holding_period"])
    got = events.drop("entry_threshold", "max_holding_period").crossJoin(F.broadcast(grid.frame(events.sparkSession)))  # as many rows as the grid has
    got = got.where(F.abs("entry_z_score") >= F.col("entry_threshold"))
    toward = F.when(F.col("side") == "short_spread", F.col("exit_z_score")).when(F.col("side") == "long_spread", -F.col("exit_z_score"))
    stop, late = F.coalesce(toward >= F.col("stop_loss_level"), F.lit(False)), F.coalesce(F.col("holding_period") > F.col("max_holding_period"), F.lit(False))
    good = F.coalesce(toward <= F.col("exit_threshold"), F.lit(False)) & ~stop & ~late
    return got.withColumn("label", good.cast("int")).withColumn("scenario_exit_reason", F.when(good, "reversion").when(stop, "stop_loss").when(late, "max_holding").otherwise("no_reversion"))


def threshold_sensitivity(events: DataFrame, grid: Grid = Grid(), threshold: float = 0.6, cost: float = 0.05) -> DataFrame:
    """performance() for every rule and strategy; strategies without trades have a zero row, rules without events none."""
    keys = ["entry_threshold", "exit_threshold", "stop_loss_level", "max_holding_period"]
    ruled = relabel(events, grid)
    s = performance(strategy_trades(ruled, threshold, cost), [*keys, "strategy"], calendar_by=keys)
    all_ = ruled.select(*keys).distinct().withColumn("strategy", F.explode(F.array(*(F.lit(x) for x in STRATEGIES))))
    got = all_.join(s, [*keys, "strategy"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in s.dtypes if c in ("trade_count", "gross_pnl", "net_pnl", "turnover", "max_drawdown")}
    return got.withColumns(zero).select("strategy", *keys, F.lit(threshold).alias("probability_threshold"), F.lit(cost).alias("transaction_cost"), *(c for c in s.columns if c not in (*keys, "strategy")))


def robustness(events: DataFrame, costs: tuple[Cost, ...] = DEFAULT_COSTS, grid: Grid = Grid(), threshold: float = 0.6) -> dict[str, DataFrame]:
    """Cost sensitivity, threshold sensitivity at the cost of the middle scenario, and the summary of both by strategy."""
    by_cost = cost_sensitivity(events, costs, threshold)
    by_rule = threshold_sensitivity(events, grid, threshold, costs[len(costs) // 2].per_unit)
    return {"costs": by_cost, "thresholds": by_rule, "summary": robustness_summary(by_rule, by_cost)}


def compare(labels: DataFrame, predictions: DataFrame, threshold: float = 0.6, cost: float = 0.05) -> dict[str, DataFrame]:
    """Trades, equity curve, summary, avoided trades and comparisons of the three strategies."""
    from tercet.operators.portfolio import equity_curve

    events = prepare_events(labels, predictions)
    trades = strategy_trades(events, threshold, cost)
    summary = performance(trades, ["strategy"])
    return {
        "trades": trades, "equity": equity_curve(trades), "summary": summary, "avoided": avoided_trades(events, threshold, cost),
        "trade_counts": trade_count_comparison(summary), "pnl": pnl_comparison(summary),
    }
