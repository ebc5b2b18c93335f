"""Price panels and triplets derived from the star-schema tables, and readers and writers of files.

A long panel has one row for each symbol and date; nothing is pivoted.  Wide inputs are turned long by unpivot().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.guards import require_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, by a given schema (never inferred); a missing file is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A stage's rows as files; CSV gets a header."""
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def unpivot(wide: DataFrame, symbols: list[str], date: str = "date", value: str = "value") -> DataFrame:
    """date, symbol, value of a frame that has a column for each symbol."""
    require_columns(wide, [date, *symbols])
    return wide.unpivot([date], symbols, "symbol", value)


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, adj_close, volume, source, ingest_seq: one row for each order line, unclean as lines are.

    Lines without a discount have no price, lines taxed highest have a price below any minimum; days repeat.
    """
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    price = F.when(F.col("l_discount") < 0.005, F.lit(None)).when(F.col("l_tax") > 0.075, F.lit(0.0)).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    joined = line.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("p_type").alias("symbol"), F.to_date("l_shipdate").alias("date"), price.alias("adj_close"), F.col("l_quantity").alias("volume"),
        F.lit("lineitem").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"),
    )


#: Logs are added in whole multiples of 2 ** -40.
LOG_UNITS = float(2**40)


def split_for_sums(x: Column | str, units: float = 1.0) -> tuple[Column, Column]:
    """`x` in whole multiples of 1 / units, whose sums are exact, and the small rest: sums do not depend on the order of rows."""
    c = F.col(x) if isinstance(x, str) else x
    whole = F.coalesce(F.rint(c * units).try_cast("long"), F.lit(0))
    return whole, c - whole / units


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date (Monday), vwap, volume, log_price: weekly prices of part types, accumulated to an index."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    joined = line.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    (paid, cents), (volume, part_units) = split_for_sums("l_extendedprice"), split_for_sums("l_quantity")
    sums = joined.groupBy(F.col("p_type").alias("symbol"), week.alias("date")).agg((F.sum(paid) + F.sum(cents)).alias("paid"), (F.sum(volume) + F.sum(part_units)).alias("volume"))
    vwap = sums.where("volume > 0 and paid > 0").select("symbol", "date", (F.col("paid") / F.col("volume")).alias("vwap"), "volume")
    whole, rest = split_for_sums(F.log("vwap"), LOG_UNITS)
    every = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    path = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    got = vwap.select("*", whole.alias("w"), rest.alias("r"))
    got = got.select("*", *(F.sum(c).over(f).alias(k) for c, f, k in (("w", path, "wt"), ("r", path, "rt"), ("w", every, "wn"), ("r", every, "rn"))), F.count("w").over(path).alias("t"), F.count("w").over(every).alias("n"))
    # the sum of the logs to here less t means: whole units first, which are exact, then what a mean has beyond whole units
    beyond = F.col("t") * F.expr("wn % n") / F.col("n")
    step_sum = (F.expr("wt - t * (wn div n)") - beyond) / LOG_UNITS + (F.col("rt") - F.col("t") * F.col("rn") / F.col("n"))
    return got.select("symbol", "date", "vwap", "volume", (4.0 + step_sum).alias("log_price"))


def universe(panel: DataFrame) -> DataFrame:
    """triplet_id, target_symbol, hedge_symbol_1, hedge_symbol_2, theme: every target with every pair of other symbols.

    The symbols are few (six here, about a hundred in practice), so all triplets of them are a small dimension.
    """
    s = panel.select("symbol").distinct()
    pairs = s.withColumnRenamed("symbol", "h1").join(s.withColumnRenamed("symbol", "h2"), F.col("h1") < F.col("h2"))
    t = s.withColumnRenamed("symbol", "t").join(pairs, (F.col("t") != F.col("h1")) & (F.col("t") != F.col("h2")))
    return t.select(
        F.concat_ws("_", "t", "h1", "h2").alias("triplet_id"), F.col("t").alias("target_symbol"), F.col("h1").alias("hedge_symbol_1"),
        F.col("h2").alias("hedge_symbol_2"), F.concat(F.lit("theme_"), F.lower(F.substring("t", 1, 3))).alias("theme"),
    )


def observations(panel: DataFrame, triplets: DataFrame, value: str = "log_price") -> DataFrame:
    """triplet_id, symbols, date, y, x1, x2: the dates on which all three legs have a value."""
    keep = triplets.select("triplet_id", "target_symbol", "hedge_symbol_1", "hedge_symbol_2")
    v = panel.where(F.col(value).isNotNull()).select("symbol", "date", value)
    leg = lambda role, out: v.select(F.col("symbol").alias(role), "date", F.col(value).alias(out))
    got = keep.join(leg("target_symbol", "y"), "target_symbol").join(leg("hedge_symbol_1", "x1"), ["hedge_symbol_1", "date"]).join(leg("hedge_symbol_2", "x2"), ["hedge_symbol_2", "date"])
    return got.select("triplet_id", "target_symbol", "hedge_symbol_1", "hedge_symbol_2", "date", "y", "x1", "x2")


def baskets(panel: DataFrame, k: int, value: str = "log_price") -> DataFrame:
    """target, date, y, x1..xk: every symbol beside the k symbols that follow it by name, around, on dates that all of them have.

    A date's values meet in one map, with as many entries as there are symbols; baskets are read from it without a join.
    """
    names = [row.symbol for row in panel.select("symbol").distinct().orderBy("symbol").collect()]  # symbols, a small dimension
    if len(names) <= k:
        raise ValueError("a basket needs more symbols than hedges")
    wide = panel.where(F.col(value).isNotNull()).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("symbol", value))).alias("m"))
    legs = [[names[(i + j) % len(names)] for j in range(k + 1)] for i in range(len(names))]
    rows = F.explode(F.array(*(F.struct(F.lit(own[0]).alias("target"), *(F.col("m")[s].alias("y" if j == 0 else f"x{j}") for j, s in enumerate(own))) for own in legs)))
    return wide.select("date", rows.alias("r")).select("r.target", "date", "r.y", *(f"r.x{j + 1}" for j in range(k))).dropna()
