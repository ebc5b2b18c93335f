"""The frames that queries share, each built from the tables when asked for; nothing is kept from one query to the next."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.functions.expressions import over, sigmoid
from tercet.operators import backtest, cleaning, events, features, hedges, models, residuals
from tercet.sources import panel
from tercet.sources.stages import stored

WINDOW = 60
CONFIG = events.LabelingConfig()
FEATURES = features.FeatureConfig(market_symbol="STANDARD")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; dates as text."""
    as_is = {"double": lambda c: F.round(c, digits) + 0.0, "date": lambda c: c.cast("string")}
    return df.select(*(as_is.get(t, lambda c: c)(F.col(f"`{c}`")).alias(c) for c, t in df.dtypes))


class Frames:
    """Frames over one data folder.  Those that several steps read are stage tables, written when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return panel.raw_prices(self.spark, self.sf_dir)

    @cached_property
    def clean(self) -> DataFrame:
        return cleaning.clean_prices(self.raw)

    @cached_property
    def panel(self) -> DataFrame:
        return stored(panel.weekly_panel(self.spark, self.sf_dir))

    @cached_property
    def triplets(self) -> DataFrame:
        return panel.universe(self.panel)

    @cached_property
    def obs(self) -> DataFrame:
        return panel.observations(self.panel, self.triplets)

    @cached_property
    def residuals(self) -> DataFrame:
        return hedges.dynamic_residuals(self.obs, WINDOW, 1.0)

    @cached_property
    def scored(self) -> DataFrame:
        """Residuals with z-scores; from the observations to here, and on to outcomes, one shuffle by triplet."""
        return residuals.event_z_scores(self.residuals, CONFIG.z_window, CONFIG.min_periods)

    @cached_property
    def scored_table(self) -> DataFrame:
        return stored(self.scored)

    @cached_property
    def outcomes(self) -> DataFrame:
        """Events with their labels, a row each."""
        return stored(events.labelled_crossings(self.__dict__.get("scored_table", self.scored), CONFIG))

    @cached_property
    def events(self) -> DataFrame:
        return self.outcomes.select(*events.event_columns(self.outcomes))

    @cached_property
    def labels(self) -> DataFrame:
        return self.outcomes.select(*events.LABELS)

    @cached_property
    def market(self) -> DataFrame:
        """symbol, date, simple_return, log_price, volume of the weekly panel."""
        before = F.lag("vwap").over(Window.partitionBy("symbol").orderBy("date"))
        return self.panel.select("symbol", "date", (over("vwap", before) - 1).alias("simple_return"), "log_price", "volume")

    @cached_property
    def coefficients(self) -> DataFrame:
        return hedges.rolling_both(self.obs, WINDOW, 1.0)

    @cached_property
    def matrix(self) -> DataFrame:
        scored = self.scored_table  # events come from it, too
        return stored(features.feature_matrix(self.events, scored, self.coefficients, self.market, self.labels, FEATURES, stored))

    @cached_property
    def predictions(self) -> DataFrame:
        """A fixed score of the entry z-score and the event's place stands for a model; splits are by time."""
        z = 0.4 + 0.9 * (2.5 - F.col("entry_abs_z")) + 0.3 * (F.col("event_row") % 5 - 2)
        return stored(models.predictions(models.time_split(self.outcomes.withColumn(models.P, sigmoid(z))), 0.5))

    @cached_property
    def traded(self) -> DataFrame:
        """Labels with their predictions; events without forward rows cannot be traded."""
        done = self.labels.where("exit_z_score is not null")
        return stored(backtest.prepare_events(done, self.predictions.join(done.select("event_id"), "event_id", "left_semi")))

    @cached_property
    def trades(self) -> DataFrame:
        return backtest.strategy_trades(self.traded, 0.5, 0.05)
