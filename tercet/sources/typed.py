"""Typed stores: tables with declared columns, keys, references and ranges, held to them while they are written.

A frame is brought to the table's columns and types, every row is either accepted or refused with a reason, and accepted rows take
the place of stored rows of the same key.  The new table is written aside and then swapped in, so a run that is lost before the swap
leaves the old table as it was.

Reasons, the first that holds: `missing <column>` (null where a value must be, a column that is not there being null), `type <column>`
(a value that its type cannot hold), `range <column>`, `reference <column>` (no such key in the other table), `repeated key` (several
rows of the frame: none of them is taken, for none is the right one).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.guards import require
from tercet.sources.catalog import Catalog
from tercet.sources.stages import stored


@dataclass(frozen=True)
class Spec:
    """columns: types by name; key; needed: columns beside the key that must have values; references: the table whose key (of one
    column) a column holds; ranges: least and greatest value, either of which may be None."""

    columns: dict[str, str]
    key: tuple[str, ...]
    needed: tuple[str, ...] = ()
    references: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        require(bool(self.key), "a table must have a key")
        unknown = {*self.key, *self.needed, *self.references, *self.ranges} - set(self.columns)
        require(not unknown, f"not columns of the table: {sorted(unknown)}")

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in self.columns.items())


def _spec(text: str, key: str, needed: str = "", references: dict | None = None, ranges: dict | None = None) -> Spec:
    """A Spec from 'name type, name type' and names between spaces."""
    columns = dict(part.split() for part in text.split(", "))
    return Spec(columns, tuple(key.split()), tuple(needed.split()), references or {}, ranges or {})


_LEGS = {"target_symbol": "assets", "hedge_symbol_1": "assets", "hedge_symbol_2": "assets"}
_FLAG, _SHARE, _POSITIVE = (0, 1), (0.0, 1.0), (0, None)
# Columns, types, keys and constraints of the tables that the engine's main steps fill.
SPECS: dict[str, Spec] = {
    "assets": _spec("symbol string, asset_type string, active int", "symbol", "asset_type", ranges={"active": _FLAG}),
    "prices_clean": _spec("symbol string, date date, adj_close double, volume double, quality_flag string, source string", "symbol date", "adj_close", {"symbol": "assets"}),
    "returns_daily": _spec("symbol string, date date, simple_return double, log_return double", "symbol date", "", {"symbol": "assets"}),
    "triplets": _spec("triplet_id string, target_symbol string, hedge_symbol_1 string, hedge_symbol_2 string, active int", "triplet_id", " ".join(_LEGS), _LEGS, {"active": _FLAG}),
    "residuals": _spec("triplet_id string, date date, method string, actual_log_price double, fitted_log_price double, residual double, z_score double", "triplet_id date method", "actual_log_price fitted_log_price residual", {"triplet_id": "triplets"}),
    "candidate_events": _spec("event_id string, triplet_id string, method string, event_date date, side string, entry_z_score double, entry_abs_z double", "event_id", "triplet_id method event_date side entry_z_score entry_abs_z", {"triplet_id": "triplets"}, {"entry_abs_z": _POSITIVE}),
    "event_labels": _spec("event_id string, triplet_id string, method string, event_date date, exit_date date, side string, label int, outcome string, exit_reason string, holding_period int", "event_id", "triplet_id method event_date side label outcome exit_reason holding_period", {"event_id": "candidate_events", "triplet_id": "triplets"}, {"label": _FLAG, "holding_period": _POSITIVE}),
    "model_predictions": _spec("prediction_id string, event_id string, split string, predicted_reversion_probability double, predicted_label int, label int", "prediction_id", "event_id split predicted_reversion_probability", {"event_id": "candidate_events"}, {"predicted_reversion_probability": _SHARE, "predicted_label": _FLAG, "label": _FLAG}),
    "trades": _spec("trade_id string, event_id string, strategy string, side string, entry_date date, exit_date date, position_size double, gross_pnl double, transaction_cost double, net_pnl double", "trade_id", "event_id strategy side entry_date position_size", {"event_id": "candidate_events"}, {"transaction_cost": _POSITIVE}),
    "pnl_daily": _spec("date date, strategy string, gross_pnl double, transaction_cost double, net_pnl double, equity double, drawdown double", "date strategy", ranges={"drawdown": (None, 0.0)}),
}


def judged(df: DataFrame, spec: Spec, tables: Mapping[str, DataFrame], specs: Mapping[str, Spec] = SPECS) -> DataFrame:
    """The table's columns of `df`, in their types, and `refusal`: why a row is not taken, null where it is.

    Other columns are dropped.  Keys of referenced tables are joined by value, in one row each; Spark broadcasts them where small.
    """
    given = {c: F.col(f"`{c}`") if c in df.columns else F.lit(None) for c in spec.columns}
    must = [*spec.key, *(c for c in spec.needed if c not in spec.key)]
    reasons = [F.when(given[c].isNull(), f"missing {c}") for c in must]
    reasons += [F.when(given[c].isNotNull() & given[c].try_cast(t).isNull(), f"type {c}") for c, t in spec.columns.items()]
    typed = {c: given[c].try_cast(t) for c, t in spec.columns.items()}
    for c, (low, high) in spec.ranges.items():
        beyond = [*([typed[c] < low] if low is not None else []), *([typed[c] > high] if high is not None else []), F.isnan(typed[c].cast("double"))]
        reasons.append(F.when(reduce(lambda a, b: a | b, beyond), f"range {c}"))
    rows = df.select(*(v.alias(c) for c, v in typed.items()), F.coalesce(*reasons).alias("__own"))
    for c, other in spec.references.items():
        (key,) = specs[other].key
        there = tables[other].select(F.col(key).alias("__key")).distinct().withColumn(f"__there_{c}", F.lit(True))
        rows = rows.join(there, F.col(c) == F.col("__key"), "left").drop("__key")
    lost = [F.when(F.col(c).isNotNull() & F.col(f"__there_{c}").isNull(), f"reference {c}") for c in spec.references]
    counts = rows.groupBy(*spec.key).agg(F.count("*").alias("__n")).where("__n > 1").withColumnsRenamed({c: f"__of_{c}" for c in spec.key})
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__of_{c}") for c in spec.key))
    whole = rows.join(counts, same, "left")
    return whole.select(*spec.columns, F.coalesce("__own", *lost, F.when(F.col("__n") > 1, "repeated key")).alias("refusal"))


class TypedCatalog(Catalog):
    """A catalog whose tables hold what their specs say."""

    def __init__(self, spark, database: str = "tercet", specs: Mapping[str, Spec] = SPECS):
        super().__init__(spark, database)
        self.specs = specs

    def create(self, tables: list[str] | None = None) -> None:
        """Empty tables, where there are none yet."""
        for t in tables or list(self.specs):
            if not self.exists(t):
                self.spark.createDataFrame([], self.specs[t].schema).write.format("parquet").saveAsTable(f"{self.database}.{t}")

    def merge(self, df: DataFrame, table: str) -> DataFrame:
        """Stores what is accepted of `df`, in place of rows of the same keys; outcome (added, replaced or the refusal) and rows."""
        spec = self.specs[table]
        self.create([table, *spec.references.values()])
        rows = stored(judged(df, spec, {t: self.table(t) for t in spec.references.values()}, self.specs))
        taken, held = rows.where("refusal IS NULL").drop("refusal"), self.table(table)
        kept = held.join(taken, list(spec.key), "left_anti")
        replaced = stored(taken.join(held.select(*spec.key), list(spec.key), "left_semi").agg(F.lit("replaced").alias("outcome"), F.count("*").alias("rows")))
        aside, full = f"{self.database}.{table}_{uuid.uuid4().hex[:12]}", f"{self.database}.{table}"
        kept.unionByName(taken).write.format("parquet").saveAsTable(aside)
        self.spark.sql(f"DROP TABLE {full}")
        self.spark.sql(f"ALTER TABLE {aside} RENAME TO {full}")
        refused = rows.where("refusal IS NOT NULL").groupBy(F.col("refusal").alias("outcome")).agg(F.count("*").alias("rows"))
        added = taken.agg(F.count("*").alias("all")).crossJoin(replaced).select(F.lit("added").alias("outcome"), (F.col("all") - F.col("rows")).alias("rows"))  # one row each
        return added.unionByName(replaced).unionByName(refused)
