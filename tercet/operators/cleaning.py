"""Cleaning, returns, coverage, and the asset and triplet dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tercet.functions.expressions import over
from tercet.guards import require_columns

LEGS = ("target_symbol", "hedge_symbol_1", "hedge_symbol_2")


def clean_prices(raw: DataFrame, min_price: float = 0.01, order: str = "ingest_seq") -> DataFrame:
    """The last row of every symbol and date, by `order`, with quality_flag 'clean' or 'invalid_price'.

    Rows that tie in `order` are told apart by their other columns, from adj_close on, the greatest being the last.
    """
    require_columns(raw, ["symbol", "date", "adj_close", order])
    rest = [c for c in raw.columns if c not in ("symbol", "date", "adj_close", order)]
    last = Window.partitionBy("symbol", "date").orderBy(*(F.col(f"`{c}`").desc_nulls_last() for c in (order, "adj_close", *rest)))
    kept = raw.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", order)
    return kept.withColumn("quality_flag", F.when(F.col("adj_close") >= min_price, "clean").otherwise("invalid_price"))


def only_clean(prices: DataFrame) -> DataFrame:
    """Rows flagged clean, or all where there is no flag."""
    return prices.where("quality_flag = 'clean'") if "quality_flag" in prices.columns else prices


def daily_returns(prices: DataFrame) -> DataFrame:
    """symbol, date, simple_return, log_return to the previous clean row, over gaps."""
    w = Window.partitionBy("symbol").orderBy("date")
    p = only_clean(require_columns(prices, ["symbol", "date", "adj_close"])).withColumn("__p", F.lag("adj_close").over(w))
    return p.select("symbol", "date", (over("adj_close", "__p") - 1).alias("simple_return"), (F.log("adj_close") - F.log("__p")).alias("log_return"))


def coverage_report(prices: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, row_count, clean_rows, coverage_ratio of each requested symbol; absent ones have 0, 0 and null."""
    counts = prices.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("quality_flag") == "clean").alias("c"))
    got = symbols.select("symbol").distinct().join(counts, "symbol", "left")
    return got.select("symbol", F.coalesce("n", F.lit(0)).alias("row_count"), F.coalesce("c", F.lit(0)).alias("clean_rows"), over("c", "n").alias("coverage_ratio"))


def log_prices(prices: DataFrame) -> DataFrame:
    """symbol, date, log_price of clean rows, long."""
    return only_clean(prices).where("adj_close > 0").select("symbol", "date", F.log("adj_close").alias("log_price"))


def percent_of_first(prices: DataFrame, value: str = "adj_close") -> DataFrame:
    """symbol, date, indexed: values in percent of each symbol's first."""
    first = F.first(value, ignorenulls=True).over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return prices.select("symbol", "date", (over(value, first) * 100).alias("indexed"))


def unique_symbols(triplets: DataFrame) -> DataFrame:
    """symbol: the distinct legs of all triplets."""
    return triplets.select(F.explode(F.array(*LEGS)).alias("symbol")).where("symbol is not null").distinct()


def assets_table(triplets: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """symbol, asset_type, sector, active: equities are the symbols that are ever a target; others are ETFs.

    The sector is that of `sectors` (symbol, sector) or a target's theme, the one of its greatest triplet_id.
    """
    targets = triplets.groupBy(F.col("target_symbol").alias("symbol")).agg(F.max_by("theme", "triplet_id").alias("theme"))
    got = unique_symbols(triplets).join(targets.withColumn("is_target", F.lit(True)), "symbol", "left")
    got = got.join(sectors.select("symbol", F.col("sector").alias("given")), "symbol", "left") if sectors is not None else got.withColumn("given", F.lit(None).cast("string"))
    return got.select("symbol", F.when(F.col("is_target"), "equity").otherwise("etf").alias("asset_type"), F.coalesce("given", "theme").alias("sector"), F.lit(1).alias("active"))


def triplets_table(triplets: DataFrame) -> DataFrame:
    """The triplet dimension as it is stored."""
    return triplets.select("triplet_id", *LEGS, F.col("theme").alias("relationship_theme"), F.lit(1).alias("active"))
