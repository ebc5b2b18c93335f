"""Threshold-crossing events and their first-passage labels."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tercet.functions.expressions import over
from tercet.guards import require, require_columns
from tercet.operators.residuals import event_z_scores

GROUP = ["triplet_id", "method"]


@dataclass(frozen=True)
class LabelingConfig:
    """When an event opens and how it ends; z_window None expands."""

    entry_threshold: float = 2.0
    exit_z: float = 0.5
    stop_loss_z: float = 3.0
    max_holding_period: int = 20
    z_window: int | None = 60
    min_periods: int = 20
    include_initial_crossing: bool = False

    def __post_init__(self) -> None:
        require(self.entry_threshold > 0, "entry_threshold must be positive")
        require(0 <= self.exit_z < self.entry_threshold, "exit_z must be from 0 to below entry_threshold")
        require(self.stop_loss_z > self.entry_threshold, "stop_loss_z must exceed entry_threshold")
        require(self.max_holding_period > 0, "max_holding_period must be positive")
        require(self.z_window is None or self.z_window > 1, "z_window must exceed 1")
        require(self.min_periods > 1, "min_periods must exceed 1")


@F.pandas_udf(T.StringType())
def _eight_decimals(z: pd.Series) -> pd.Series:
    """The correctly rounded text with eight decimals; the JVM's own format rounds halves of the decimal text."""
    return z.map(lambda x: None if x is None or x != x else f"{x:.8f}")


def event_id(exact: bool = True) -> Column:
    """16 hexadecimal digits of a hash over triplet, method, date, side and the entry z-score.

    exact=False formats the z-score in the JVM, which differs where the ninth decimal is a tie.
    """
    z = _eight_decimals("entry_z_score") if exact else F.format_string("%.8f", "entry_z_score")
    return F.substring(F.sha1(F.concat_ws("|", "triplet_id", "method", F.date_format("event_date", "yyyy-MM-dd"), "side", z).cast("binary")), 1, 16)


SYMBOLS = ("target_symbol", "hedge_symbol_1", "hedge_symbol_2")


def _crossed(size: Column, before: Column, config: LabelingConfig) -> Column:
    """Whether |z| reaches the threshold when the row before was below it (or, if wanted, has none)."""
    return (size >= config.entry_threshold) & ((before < config.entry_threshold) | (F.lit(config.include_initial_crossing) & before.isNull()))


def _events(hits: DataFrame, symbols: list[str], config: LabelingConfig, exact_ids: bool, also: list[str]) -> DataFrame:
    """Event columns of rows that cross, which have rn."""
    got = hits.select(
        *GROUP, F.col("date").alias("event_date"), *symbols, F.when(F.col("z_score") > 0, "short_spread").otherwise("long_spread").alias("side"),
        F.col("z_score").alias("entry_z_score"), F.abs("z_score").alias("entry_abs_z"), F.col("residual").alias("entry_residual"), F.lit(config.entry_threshold).alias("entry_threshold"),
        F.lit(config.exit_z).alias("exit_z"), F.lit(config.stop_loss_z).alias("stop_loss_z"), F.lit(config.max_holding_period).alias("max_holding_period"), F.lit(config.z_window).cast("int").alias("z_window"), (F.col("rn") - 1).alias("event_row"), *also,
    )
    return got.select(event_id(exact_ids).alias("event_id"), *got.columns)


def candidate_events(scored: DataFrame, config: LabelingConfig = LabelingConfig(), exact_ids: bool = False) -> DataFrame:
    """Rows whose |z| reaches the threshold when the row before was below it."""
    require_columns(scored, [*GROUP, "date", "residual", "z_score"])
    w = Window.partitionBy(*GROUP).orderBy("date")
    size = F.abs("z_score")
    symbols = [c for c in SYMBOLS if c in scored.columns]
    crossed = _crossed(size, F.lag(size).over(w), config)
    got = scored.select(*GROUP, *symbols, "date", "residual", "z_score", crossed.alias("hit"), F.row_number().over(w).alias("rn")).where("hit")
    return _events(got, symbols, config, exact_ids, [])


def paths(scored: DataFrame, config: LabelingConfig) -> DataFrame:
    """For every residual row, its place `rn` and what a trade opened there would meet on each side within the holding period.

    short_ok, short_stop, long_ok, long_stop and last hold (rn, date, z_score, residual) of the row met, so that one
    forward frame gives barrier and exit together; rows without a z-score are passed over.
    """
    by_date = Window.partitionBy(*GROUP).orderBy("date")
    n = scored.withColumn("rn", F.row_number().over(by_date))
    ahead = by_date.rowsBetween(1, config.max_holding_period)
    row, z = F.struct("rn", "date", "z_score", "residual"), F.col("z_score")
    first = lambda cond: F.min(F.when(cond, row)).over(ahead)
    met = {"short_ok": first(z <= config.exit_z), "short_stop": first(z >= config.stop_loss_z), "long_ok": first(-z <= config.exit_z), "long_stop": first(-z >= config.stop_loss_z)}
    return n.select("*", *(c.alias(k) for k, c in met.items()), F.max(row).over(ahead).alias("last"))


MET = ["short_ok", "short_stop", "long_ok", "long_stop", "last"]
LABELS = [
    "event_id", *GROUP, "event_date", "exit_date", "side", "label", "outcome", "exit_reason", "holding_period", "entry_z_score", "entry_abs_z", "exit_z_score", "entry_residual", "exit_residual",
    "entry_threshold", "exit_z", "stop_loss_z", "max_holding_period",
]


def _with_outcome(got: DataFrame, missing: Column | None = None) -> DataFrame:
    """Events beside their paths, with exit_reason, exit_date, exit z-score and residual, holding_period, label, outcome."""
    short = F.col("side") == "short_spread"
    got = got.withColumn("ok", F.when(short, F.col("short_ok")).otherwise(F.col("long_ok"))).withColumn("stop", F.when(short, F.col("short_stop")).otherwise(F.col("long_stop")))
    success = F.col("ok").isNotNull() & (F.col("stop").isNull() | (F.col("ok.rn") <= F.col("stop.rn")))
    met = F.when(F.col("last").isNull(), "no_forward_observations").when(success, "reversion").when(F.col("stop").isNotNull(), "stop_loss").otherwise("max_holding_period")
    got = got.withColumn("exit_reason", met if missing is None else F.coalesce(missing, met)).withColumn("end", F.coalesce(F.least("ok", "stop"), F.col("last")))
    good = F.col("exit_reason") == "reversion"
    return got.withColumns({
        "exit_date": F.col("end.date"), "exit_z_score": F.col("end.z_score"), "exit_residual": F.col("end.residual"), "holding_period": F.coalesce(F.col("end.rn") - F.col("rn"), F.lit(0)),
        "label": good.cast("int"), "outcome": F.when(good, "success").otherwise("failure"),
    })


def label_events(scored: DataFrame, events: DataFrame, config: LabelingConfig = LabelingConfig()) -> DataFrame:
    """Each event with label, outcome, exit_reason, exit_date, holding_period, exit_z_score and exit_residual.

    Reversion goes before the stop on one row; without either the last row within the horizon ends the trade.  Events
    without a residual path, date or forward rows are failures with a holding period of 0.  One join, on the key that
    paths are shuffled by.
    """
    p = paths(scored, config).select(*GROUP, F.col("date").alias("event_date"), "rn", *MET)
    got = events.join(p, [*GROUP, "event_date"], "left").join(scored.select(*GROUP).distinct().withColumn("known", F.lit(True)), GROUP, "left")
    missing = F.when(F.col("known").isNull(), "missing_residual_path").when(F.col("rn").isNull(), "missing_event_date")
    return _with_outcome(got, missing).select(*LABELS)


def labelled_crossings(scored: DataFrame, config: LabelingConfig = LabelingConfig(), exact_ids: bool = False) -> DataFrame:
    """candidate_events() and their label_events() columns, from one pass over each path: one sort, no join."""
    symbols = [c for c in SYMBOLS if c in scored.columns]
    before = F.lag(F.abs("z_score")).over(Window.partitionBy(*GROUP).orderBy("date"))
    walked = paths(require_columns(scored, [*GROUP, "date", "residual", "z_score"]).select(*GROUP, *symbols, "date", "residual", "z_score", before.alias("before")), config)
    events = _events(walked.where(_crossed(F.abs("z_score"), F.col("before"), config)), symbols, config, exact_ids, ["rn", *MET])
    return _with_outcome(events).drop("rn", *MET, "ok", "stop", "end")


def generate_labels(residuals: DataFrame, config: LabelingConfig = LabelingConfig(), exact_ids: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored residuals, candidate events, labels."""
    scored = event_z_scores(residuals, config.z_window, config.min_periods)
    both = labelled_crossings(scored, config, exact_ids)
    return scored, both.select(*event_columns(both)), both.select(*LABELS)


def event_columns(both: DataFrame) -> list[str]:
    """The columns of labelled_crossings() that make up candidate events."""
    return [c for c in both.columns if c not in ("exit_date", "exit_z_score", "exit_residual", "holding_period", "label", "outcome", "exit_reason")]


def label_summary(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by columns, n_events, success_count, failure_count, success_rate; groups with null keys stay; by=[]: one row."""
    by = GROUP if by is None else by
    n, s = F.count("*"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0))
    return labels.groupBy(*by).agg(n.alias("n_events"), s.alias("success_count"), (n - s).alias("failure_count"), over(s, n).alias("success_rate"))


def success_by_z_bucket(labels: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """z_bucket, n_events, success_count, failure_count, success_rate of left-closed buckets that occur.

    Without edges, buckets are half a unit wide; values outside given edges belong to none.
    """
    z = F.col("entry_abs_z")
    if edges is None:
        low = F.floor(z * 2) / 2
        high = low + 0.5
    else:
        require(len(edges) > 1 and sorted(edges) == list(edges), "edges must ascend")
        case = lambda pick: F.coalesce(*(F.when((z >= a) & (z < b), F.lit(float(pick(a, b)))) for a, b in zip(edges, edges[1:], strict=False)))
        low, high = case(lambda a, b: a), case(lambda a, b: b)
    name = F.concat(F.lit("["), low.cast("double").cast("string"), F.lit(", "), high.cast("double").cast("string"), F.lit(")"))
    return label_summary(labels.withColumn("z_bucket", name).where("z_bucket is not null"), ["z_bucket"])


def label_distribution(labels: DataFrame) -> DataFrame:
    """outcome and count."""
    return labels.groupBy("outcome").agg(F.count("*").alias("count"))
