"""Tables by name: storing, listing, counting, named SQL, integrity checks, exports.

Named SQL is text with `-- name: x` before each statement; its tables are frames, given by name, so nothing needs to be
stored first.  Keys and references, which a file-based catalog cannot enforce, are checks.
"""

from __future__ import annotations

import re
from collections import ChainMap
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tercet.guards import require, require_columns

#: Keys of the canonical tables; every stored frame must have them.
KEYS: dict[str, tuple[str, ...]] = {
    "assets": ("symbol",), "prices_raw": ("symbol", "date", "source"), "prices_clean": ("symbol", "date"), "returns_daily": ("symbol", "date"), "triplets": ("triplet_id",),
    "regression_results": ("triplet_id", "method"), "hedge_ratios": ("triplet_id", "date", "method"), "residuals": ("triplet_id", "date", "method"), "residual_diagnostics": ("triplet_id", "method"),
    "candidate_events": ("event_id",), "event_features": ("event_id",), "event_labels": ("event_id",), "model_runs": ("model_run_id",), "model_predictions": ("prediction_id",), "trades": ("trade_id",),
    "positions": ("position_id",), "pnl_daily": ("date", "strategy"), "performance_summary": ("strategy",),
}

# Keys of the tables that stages store, beside the canonical ones.
STAGE_KEYS: dict[str, tuple[str, ...]] = {
    "rolling_coefficients": ("date", "triplet_id", "method"), "ridge_coefficients": ("date", "triplet_id", "method", "ridge_alpha"), "dynamic_residuals": ("date", "triplet_id", "method"),
    "residual_method_summary": ("triplet_id", "method"), "kalman_states": ("date", "triplet_id", "method", "process_noise", "measurement_noise"), "kalman_residuals": ("date", "triplet_id", "method", "process_noise", "measurement_noise"),
    "candidate_trade_events": ("event_id",), "event_label_summary": ("triplet_id", "method"), "event_feature_matrix": ("event_id",), "feature_summary_statistics": ("feature",), "feature_missingness_report": ("column",),
    "logistic_model_coefficients": ("feature",), "logistic_training_loss": ("iteration",), "logistic_event_predictions": ("event_id", "split"), "logistic_validation_metrics": ("split",), "logistic_probability_calibration": ("probability_bucket",),
    "model_evaluation_summary": ("split", "threshold"), "model_confusion_matrix": ("split", "actual_label", "predicted_label", "threshold"), "probability_bucket_summary": ("split", "probability_bucket"), "model_calibration_curve": ("split", "probability_bucket"),
    "ml_backtest_trade_log": ("event_id", "strategy"), "ml_backtest_equity_curve": ("date", "strategy"), "ml_backtest_summary": ("strategy",), "avoided_bad_trades_analysis": ("probability_threshold",),
    "decision_tree_event_predictions": ("event_id", "split", "model_type"), "decision_tree_feature_splits": ("node_id",), "decision_tree_logistic_comparison": ("model_type",), "hmm_regime_probabilities": ("date", "triplet_id", "model_type", "feature_column"),
    "hmm_regime_parameters": ("triplet_id", "model_type", "state"), "hmm_strategy_performance_by_regime": ("strategy", "regime_bucket"), "c_kernel_validation": ("output_column", "backend_pair"), "c_kernel_benchmark": ("backend", "sample_rows", "window"), "c_kernel_test_results": ("test_name",),
    "transaction_cost_sensitivity": ("cost_scenario", "strategy"), "threshold_sensitivity": ("strategy", "entry_threshold", "exit_threshold", "stop_loss_level", "max_holding_period"), "robustness_summary": ("strategy",),
}


class Catalog:
    """Tables of one database of the session's catalog, as Parquet."""

    def __init__(self, spark: SparkSession, database: str = "tercet"):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def store(self, df: DataFrame, table: str, mode: str = "overwrite") -> None:
        """`df` as a table; its key columns must be there, and are not checked for repeats (see checks())."""
        require(mode in ("append", "overwrite"), "mode must be append or overwrite")
        require_columns(df, keys_of(table))
        df.write.mode(mode).format("parquet").saveAsTable(f"{self.database}.{table}")

    def initialize(self, schemas: Mapping[str, StructType | str], views: Mapping[str, Callable] | None = None) -> None:
        """Empty tables of the given schemas, where there are none yet, and views by name, over the database's tables."""
        for table, schema in schemas.items():
            if not self.exists(table):
                self.store(self.spark.createDataFrame([], schema), table)
        held = {t: self.table(t) for t in self.tables()}
        for name, build in (views or {}).items():
            build(held).createOrReplaceTempView(name)

    def append(self, df: DataFrame, table: str) -> int:
        """Adds rows, dates as the table has them, and gives their number; nothing is written for an empty frame."""
        kinds = dict(self.table(table).dtypes)
        fits = df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in kinds))
        n = fits.count()
        if n:
            self.store(fits, table, "append")
        return n

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{table}")

    def tables(self) -> list[str]:
        """Names of the tables of the database, sorted."""
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{table}")

    def row_counts(self, tables: list[str] | None = None) -> DataFrame:
        return row_counts(self.spark, {t: self.table(t) if self.exists(t) else None for t in tables or list(KEYS)})

    def run(self, text: str) -> dict[str, DataFrame]:
        return run_named(self.spark, text, {t: self.table(t) for t in self.tables()})


def keys_of(table: str) -> tuple[str, ...]:
    """The key columns of a canonical or stage table; none for others."""
    return KEYS.get(table) or STAGE_KEYS.get(table, ())


def row_counts(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """table_name, row_count, exists; missing tables have a null count."""
    parts = [spark.range(1).select(F.lit(t).alias("table_name"), F.lit(None).cast("long").alias("row_count"), F.lit(False).alias("exists")) if df is None else df.agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count"), F.lit(True).alias("exists")) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def parse_named_queries(text: str) -> dict[str, str]:
    """Statements by name; without their final semicolon, and without empty ones."""
    parts = re.split(r"^--\s*name:\s*(\w+)\s*$", text, flags=re.M)
    found = {name: re.sub(r"^--.*$", "", body, flags=re.M).strip().rstrip(";").strip() for name, body in zip(parts[1::2], parts[2::2], strict=True)}
    return {k: v for k, v in found.items() if v}


def bound(sql: str, names, to) -> str:
    """`sql` with the tables after FROM and JOIN that are in `names` written as to(name)."""
    return re.sub(r"\b(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {to(m[2])}" if m[2] in names else m[0], sql)


def run_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """A statement over frames."""
    used = {t for t in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql) if t in tables}
    return spark.sql(bound(sql, used, lambda t: "{" + t + "}"), **{t: tables[t] for t in used})


def run_named(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], views: str = "") -> dict[str, DataFrame]:
    """Every statement of `text` over `tables` and the statements of `views`, which may use earlier ones; lazily."""
    known = ChainMap({}, tables)
    for name, sql in parse_named_queries(views).items():
        known[name] = run_sql(spark, sql, known)
    return {name: run_sql(spark, sql, known) for name, sql in parse_named_queries(text).items()}


def check_results(results: dict[str, DataFrame]) -> DataFrame:
    """check_name, issue_count, status: pass where a check has no rows."""
    parts = [df.agg(F.lit(name).alias("check_name"), F.count("*").alias("issue_count")) for name, df in results.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when(F.col("issue_count") == 0, "pass").otherwise("fail"))


def key_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, repeated_keys, null_keys of canonical and stage tables."""
    parts = []
    for t, df in tables.items():
        key = [F.col(c) for c in keys_of(t)]
        null = reduce(lambda a, b: a | b, (c.isNull() for c in key))
        per = df.groupBy(*keys_of(t)).agg(F.count("*").alias("n"))
        parts.append(per.agg(F.lit(t).alias("table_name"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(null).alias("null_keys")))
    return reduce(DataFrame.unionByName, parts)


def export(results: dict[str, DataFrame], path: str, fmt: str = "csv") -> DataFrame:
    """Every result as files below `path`; query_name, row_count, output_path of what was written."""
    spark = next(iter(results.values())).sparkSession
    rows = []
    for name, df in results.items():
        out = f"{path}/{name}"
        df.write.mode("overwrite").format(fmt).option("header", True).save(out)
        rows.append((name, df.count(), out))
    return spark.createDataFrame(rows, "query_name string, row_count long, output_path string")
