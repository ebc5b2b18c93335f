"""Queries over what reads, writes, names and guards, and their SQL: files, the catalog, named statements, settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet import guards
from tercet.operators import backtest, cleaning, events, features, hedges, metrics, portfolio, residuals
from tercet.plans.frames import CONFIG, WINDOW, Frames, rounded
from tercet.plans.market_queries import _EVENT
from tercet.plans.model_queries import _PERF, COSTS, GRID, NUMERIC
from tercet.plans.model_queries import SQL as MODEL_SQL
from tercet.plans.oracle import part, query, r
from tercet.plans.sql_queries import NAMED, CanonicalTables
from tercet.sources import catalog, panel, typed
from tercet.sources.stages import shared_dir, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, build: Callable[[Frames], DataFrame], sql: str, digits: int = 6) -> None:
    """As in market_queries."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(Frames(spark, sf_dir)), digits)
    SQL[name] = query(sql)


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _through_csv(f: Frames) -> DataFrame:
    """The panel, written as CSV and read by its schema."""
    path = _path(f.spark)
    panel.write_table(f.panel, path, "csv")
    return panel.read_csv(f.spark, path, "symbol string, date date, vwap double, volume double, log_price double")


def _wide(f: Frames) -> DataFrame:
    """Log prices with a column for each symbol, turned long again."""
    symbols = [x.symbol for x in f.panel.select("symbol").distinct().orderBy("symbol").collect()]  # the columns of a wide frame
    wide = f.panel.groupBy("date").pivot("symbol", symbols).agg(F.first("log_price"))
    return panel.unpivot(wide, symbols, value="log_price").where("log_price is not null")


def _catalogued(f: Frames) -> DataFrame:
    """What a database says of itself after storing, appending and a table that is not there."""
    c = catalog.Catalog(f.spark, f"tercet_{uuid.uuid4().hex[:12]}")
    try:
        c.initialize({"triplets": f.triplets.schema, "assets": "symbol string, asset_type string"})
        tables = CanonicalTables(f)
        c.store(tables["assets"], "assets")
        n = c.append(f.triplets, "triplets") + c.append(f.triplets.limit(0), "triplets")
        rows = [(t, c.exists(t), c.table(t).count() if c.exists(t) else -1) for t in ("assets", "triplets", "trades")]
        rows += [("listed: " + ", ".join(c.tables()), True, n)]
        return f.spark.createDataFrame(rows, "table_name string, present boolean, row_count long")
    finally:
        f.spark.sql(f"DROP DATABASE {c.database} CASCADE")


def _typed_stores(f: Frames) -> DataFrame:
    """step, outcome and rows of stores that plant faults: a symbol that assets lack, negative sizes, text for numbers, repeated keys;
    then of labels stored again; at last the sum of what the labels' table holds."""
    c = typed.TypedCatalog(f.spark, f"tercet_{uuid.uuid4().hex[:12]}")
    late = F.when(F.col("holding_period") == 2, "two").otherwise(F.col("holding_period").cast("string"))
    faulty = f.labels.withColumn("holding_period", late).withColumn("not_of_the_table", F.lit(1))
    steps = {
        "assets": ("assets", cleaning.assets_table(f.triplets).where("symbol <> 'ECONOMY'")),
        "triplets": ("triplets", f.triplets),
        "candidate_events": ("candidate_events", f.events.withColumn("entry_abs_z", F.when(F.col("entry_abs_z") > 3.2, -F.col("entry_abs_z")).otherwise(F.col("entry_abs_z")))),
        "event_labels": ("event_labels", faulty.unionByName(faulty.where("holding_period = '3'"))),
        "event_labels again": ("event_labels", f.labels.where("holding_period = 4").withColumn("holding_period", F.col("holding_period") + 100)),
    }
    try:
        out = [c.merge(df, table).select(F.lit(step).alias("step"), "outcome", "rows") for step, (table, df) in steps.items()]
        out.append(c.table("event_labels").agg(F.lit("held").alias("step"), F.lit("holding_period").alias("outcome"), F.sum("holding_period").alias("rows")))
        return stored(reduce(DataFrame.unionByName, out))
    finally:
        f.spark.sql(f"DROP DATABASE {c.database} CASCADE")


_LACKS = " ".join(f"WHEN {c} = 'ECONOMY' THEN 'reference {c}'" for c in ("target_symbol", "hedge_symbol_1", "hedge_symbol_2"))
part("c_typed_triplets", f"SELECT triplet_id, CASE {_LACKS} END AS refusal FROM c_triplets")
part("c_typed_events", "SELECT event_id, CASE WHEN entry_abs_z > 3.2 THEN 'range entry_abs_z' WHEN triplet_id NOT IN (SELECT triplet_id FROM c_typed_triplets WHERE refusal IS NULL) THEN 'reference triplet_id' END AS refusal FROM c_events")
_NEEDED = " ".join(f"WHEN {c} IS NULL THEN 'missing {c}'" for c in typed.SPECS["event_labels"].needed)
part("c_typed_labels", f"""SELECT holding_period, CASE {_NEEDED} WHEN holding_period = 2 THEN 'type holding_period' WHEN event_id NOT IN (SELECT event_id FROM c_typed_events WHERE refusal IS NULL) THEN 'reference event_id' WHEN holding_period = 3 THEN 'repeated key' END AS refusal
  FROM (SELECT *, unnest(range(CASE WHEN holding_period = 3 THEN 2 ELSE 1 END)) AS copy FROM c_labels)""")
part("c_typed", """SELECT 'assets' AS step, NULL AS refusal FROM d_assets UNION ALL SELECT 'triplets', refusal FROM c_typed_triplets UNION ALL SELECT 'candidate_events', refusal FROM c_typed_events
  UNION ALL SELECT 'event_labels', refusal FROM c_typed_labels UNION ALL SELECT 'event_labels again', refusal FROM c_typed_labels WHERE holding_period = 4""")
register("io5_typed_stores", _typed_stores, """SELECT step, refusal AS outcome, count(*) AS rows FROM c_typed WHERE refusal IS NOT NULL GROUP BY step, refusal
  UNION ALL SELECT step, outcome, CASE WHEN (outcome = 'replaced') = (step = 'event_labels again') THEN n ELSE 0 END FROM (SELECT step, count(*) - count(refusal) AS n FROM c_typed GROUP BY step), (SELECT unnest(['added', 'replaced']) AS outcome)
  UNION ALL SELECT 'held', 'holding_period', CAST(sum(holding_period + CASE WHEN holding_period = 4 THEN 100 ELSE 0 END) AS BIGINT) FROM c_typed_labels WHERE refusal IS NULL""")


def _faulty_matrix(f: Frames) -> DataFrame:
    """The feature matrix with its successes twice, and without the ids of events held for two rows."""
    twice = f.matrix.unionByName(f.matrix.where("label = 1"))
    return twice.withColumn("event_id", F.when(F.col("holding_period") == 2, None).otherwise(F.col("event_id")))


def _refused(f: Frames) -> DataFrame:
    """Settings and inputs that are refused, and whether they are."""
    frame = f.spark.sql("SELECT 1 AS label, 1.5D AS predicted_reversion_probability, 'up' AS side, 1.0D AS entry_z_score, 0.0D AS exit_z_score, CAST('NaN' AS DOUBLE) AS x")
    calls: dict[str, Callable] = {
        "exit above entry": lambda: events.LabelingConfig(exit_z=2.5), "stop below entry": lambda: events.LabelingConfig(stop_loss_z=1.0), "no horizon": lambda: events.LabelingConfig(max_holding_period=0),
        "negative cost": lambda: backtest.Cost("a", -0.1), "nameless cost": lambda: backtest.Cost(""), "stops below entries": lambda: backtest.Grid((3.0,), stop_loss_levels=(2.5,)),
        "probability above 1": lambda: guards.probabilities(frame, "label", metrics.P).collect(), "threshold of 1": lambda: guards.probabilities(frame, "label", metrics.P, 1.0), "unknown side": lambda: frame.select(backtest.spread_pnl()).collect(),
        "not finite": lambda: guards.finite(frame, ["x"]).collect(), "missing column": lambda: guards.require_columns(frame, ["y"]), "default settings": events.LabelingConfig, "default grid": backtest.Grid,
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, False))
        except (ValueError, guards.MissingColumns):
            rows.append((name, True))
        except PySparkException as e:
            if "USER_RAISED_EXCEPTION" not in str(e):  # anything but a check of ours
                raise
            rows.append((name, True))
    return f.spark.createDataFrame(rows, "setting string, refused boolean")


REFUSED = ("exit above entry", "stop below entry", "no horizon", "negative cost", "nameless cost", "stops below entries", "probability above 1", "threshold of 1", "unknown side", "not finite", "missing column")
ALLOWED = ("default settings", "default grid")

register("io3_csv_round_trip", _through_csv, f"SELECT symbol, date, {r('vwap', 'volume', 'log_price')} FROM c_panel")
register("io9_catalog", _catalogued, "SELECT * FROM (VALUES ('assets', true, 5), ('triplets', true, 60), ('trades', false, -1), ('listed: assets, triplets', true, 60)) t(table_name, present, row_count)")
register("io12_parsed_names", lambda f: f.spark.createDataFrame(list(catalog.parse_named_queries(NAMED).items()), "name string, statement string").select("name", F.upper(F.substring("statement", 1, 6)).alias("begins")), "SELECT unnest(['long_spreads', 'exits']) AS name, 'SELECT' AS begins")
register(
    "io15_exported",
    lambda f: catalog.export(catalog.run_named(f.spark, NAMED, CanonicalTables(f)), _path(f.spark)).drop("output_path"),
    "SELECT 'long_spreads' AS query_name, count(DISTINCT method) AS row_count FROM c_labels WHERE side = 'long_spread' UNION ALL SELECT 'exits', count(DISTINCT exit_reason) FROM c_labels SEMI JOIN d_candidate_events USING (event_id)",
)
register("cl6_wide_and_long", _wide, f"SELECT symbol, date, {r('log_price')} FROM c_panel")
register("cl7_finite", lambda f: guards.finite(f.panel, ["vwap", "log_price"]).groupBy("symbol").agg(F.count("*").alias("n")), "SELECT symbol, count(*) AS n FROM c_panel GROUP BY symbol")
register("cl7_settings_refused", _refused, "SELECT unnest([" + ", ".join(f"'{x}'" for x in REFUSED) + "]) AS setting, true AS refused UNION ALL SELECT unnest([" + ", ".join(f"'{x}'" for x in ALLOWED) + "]), false")
register(
    "ev5_generated_labels",
    lambda f: events.generate_labels(f.residuals, CONFIG)[2].drop("entry_threshold", "exit_z", "stop_loss_z", "max_holding_period"),
    f"SELECT event_id, triplet_id, method, event_date, exit_date, side, label, outcome, exit_reason, holding_period, {r(*_EVENT, 'exit_z_score', 'exit_residual')} FROM c_labels",
)
register("ml11_feature_columns", lambda f: f.spark.createDataFrame([(c,) for c in features.numeric_features(f.matrix)], "feature string"), "SELECT unnest([" + ", ".join(f"'{c}'" for c in NUMERIC) + "]) AS feature")
register("pf5_ordered_strategies", lambda f: _ordered(f), f"SELECT strategy, {_PERF} FROM c_perf WHERE strategy <> 'baseline_rule_based'", 5)
# The middle cost scenario is the cost of pf12's grid, so both are one table in SQL.
QUERIES["bt13_robustness"] = lambda spark, sf_dir: rounded(backtest.robustness(Frames(spark, sf_dir).traded, COSTS, GRID, 0.5)["summary"], 5)
SQL["bt13_robustness"] = MODEL_SQL["pf12_robustness_summary"]


def _ordered(f: Frames) -> DataFrame:
    """The two strategies that come after the first, in the order asked for."""
    order = (backtest.STRATEGIES[0], backtest.STRATEGIES[2], backtest.STRATEGIES[1])
    got = portfolio.ordered(stored(portfolio.performance(f.trades)), order)
    return got.offset(1)


def _stage_tables(f: Frames) -> dict[str, DataFrame]:
    """Stage tables by the names under which they are stored, as the operators give them."""
    by = "split"
    return {
        "rolling_coefficients": hedges.rolling_ols(f.obs, WINDOW), "dynamic_residuals": f.residuals, "residual_method_summary": residuals.compare_stability(f.residuals), "candidate_trade_events": f.events,
        "event_label_summary": events.label_summary(f.labels), "logistic_event_predictions": f.predictions, "model_evaluation_summary": metrics.classification_summary(f.predictions, 0.5, by),
        "model_confusion_matrix": metrics.confusion_matrix(f.predictions, 0.5, by), "probability_bucket_summary": metrics.probability_buckets(f.predictions, 5, by), "model_calibration_curve": metrics.calibration_curve(f.predictions, 5, by),
        "ml_backtest_trade_log": f.trades, "ml_backtest_equity_curve": portfolio.equity_curve(f.trades), "ml_backtest_summary": portfolio.performance(f.trades), "avoided_bad_trades_analysis": backtest.avoided_trades(f.traded, 0.5),
        "transaction_cost_sensitivity": backtest.cost_sensitivity(f.traded, COSTS, 0.5),
    }


STAGES = (
    "rolling_coefficients dynamic_residuals residual_method_summary candidate_trade_events event_label_summary logistic_event_predictions model_evaluation_summary model_confusion_matrix probability_bucket_summary "
    "model_calibration_curve ml_backtest_trade_log ml_backtest_equity_curve ml_backtest_summary avoided_bad_trades_analysis transaction_cost_sensitivity"
).split()
register("io8_stage_table_keys", lambda f: catalog.key_checks(_stage_tables(f)), "SELECT unnest([" + ", ".join(f"'{t}'" for t in STAGES) + "]) AS table_name, 0 AS repeated_keys, 0 AS null_keys")
register("io8_faulty_keys", lambda f: catalog.key_checks({"event_feature_matrix": _faulty_matrix(f)}), """SELECT 'event_feature_matrix' AS table_name, count(*) FILTER (n > 1) AS repeated_keys, count(*) FILTER (k IS NULL) AS null_keys
  FROM (SELECT k, count(*) AS n FROM (SELECT CASE WHEN holding_period = 2 THEN NULL ELSE event_id END AS k FROM (SELECT * FROM c_matrix UNION ALL SELECT * FROM c_matrix WHERE label = 1)) GROUP BY k)""")
