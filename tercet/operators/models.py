"""Splits, imputation, logistic regression by gradient descent, and decision trees.

Descent (descent.py) and tree growth (trees.py) are distributed and cover all training rows, whatever their number; scoring is
column arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.functions.expressions import sigmoid
from tercet.guards import require, require_columns
from tercet.operators import descent, trees
from tercet.operators.ordered import quantiles

P = "predicted_reversion_probability"
KEEP = ("event_id", "triplet_id", "method", "event_date")


@dataclass(frozen=True)
class LogisticConfig:
    learning_rate: float = 0.05
    max_iter: int = 2000
    l2: float = 0.0
    tolerance: float = 1e-8
    threshold: float = 0.5


@dataclass(frozen=True)
class TreeConfig:
    max_depth: int = 3
    min_samples_split: int = 20
    min_samples_leaf: int = 10
    min_impurity_decrease: float = 1e-6
    max_thresholds: int = 64
    criterion: str = "gini"
    threshold: float = 0.5


def _numbered(df: DataFrame, date: str) -> DataFrame:
    """rn and n: each row's place by date and event_id, and the number of rows.

    Places are counts of the dates before (one row a date) and places within a date, so that no task sorts all rows.
    """
    per = df.groupBy(date).agg(F.count("*").alias("__k"), F.lit(0).alias("__one"))
    path = Window.partitionBy("__one").orderBy(F.col(date).asc_nulls_first())
    per = per.select(F.col(date).alias("__d"), (F.sum("__k").over(path.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__k")).alias("__before"), F.sum("__k").over(Window.partitionBy("__one")).alias("n"))
    got = df.withColumn("__r", F.row_number().over(Window.partitionBy(date).orderBy("event_id")))
    return got.join(per, F.col(date).eqNullSafe(F.col("__d"))).withColumn("rn", F.col("__before") + F.col("__r")).drop("__d", "__before", "__r")


def time_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, date: str = "event_date") -> DataFrame:
    """`df` with split: train, validation or test by time; at least one row each from three rows on."""
    require(0 < train < 1 and 0 < validation < 1 and train + validation < 1, "split sizes must be positive and leave a rest")
    got = _numbered(require_columns(df, [date, "event_id"]), date)
    a = F.greatest(F.lit(1), F.floor(F.col("n") * train))
    b = F.least(F.greatest(a + 1, F.floor(F.col("n") * (train + validation))), F.col("n") - 1)
    return got.withColumn("split", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= b, "validation").otherwise("test")).drop("rn", "n")


def walk_forward(df: DataFrame, initial: int = 20, size: int = 5, step: int = 5, date: str = "event_date") -> DataFrame:
    """fold, role, event_id: growing training sets, each with the `size` rows after it for validation."""
    require(min(initial, size, step) >= 1, "walk-forward sizes must be positive")
    got = _numbered(df, date).select("event_id", "rn", "n")
    last = F.floor((F.col("n") - initial - size) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - initial - size) / step)).cast("long")  # the first fold that reaches the row
    got = got.where(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    role = F.when(F.col("rn") <= initial + F.col("fold") * step, "train").otherwise("validation")
    return got.select("fold", role.alias("role"), "event_id")


def impute(df: DataFrame, columns: list[str], fit_on: str | None = None) -> DataFrame:
    """Labelled rows, with missing values of `columns` replaced by exact medians (0 where there are no values).

    fit_on: the split whose medians are used; None takes those of all rows.
    """
    rows = require_columns(df, ["label", *columns]).where("label is not null")
    base = rows.where(F.col("split") == fit_on) if fit_on else rows
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    middle = quantiles(base.select(cells.alias("x")).select("x.*"), ["feature"], "value", {"median": 0.5})
    medians = middle.agg(*(F.coalesce(F.max(F.when(F.col("feature") == c, F.col("median"))), F.lit(0.0)).alias(f"__{c}") for c in columns))
    got = rows.crossJoin(F.broadcast(medians))  # one row
    return got.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in columns} | {"label": F.col("label").cast("int")}).drop(*(f"__{c}" for c in columns))


def large_enough(df: DataFrame, events: int = 100, positive: int = 20, negative: int = 20) -> DataFrame:
    """n_events, n_positive, n_negative, large_enough: one row."""
    p, q = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.agg(F.count("label").alias("n_events"), p.alias("n_positive"), q.alias("n_negative")).withColumn("large_enough", (F.col("n_events") >= events) & (F.col("n_positive") >= positive) & (F.col("n_negative") >= negative))


MODEL = "features array<string>, coefficients array<double>, intercept double, means array<double>, deviations array<double>, losses array<double>"


def fit_logistic(train: DataFrame, columns: list[str], config: LogisticConfig = LogisticConfig(), barrier: bool | None = None) -> DataFrame:
    """One row: features, coefficients, intercept, means, deviations, losses; none where there are no training rows."""
    got = descent.fit(train, columns, config, barrier)
    rows = [] if got is None else [(columns, got[0][1:].tolist(), float(got[0][0]), got[1].tolist(), got[2].tolist(), got[3])]
    return train.sparkSession.createDataFrame(rows, MODEL)


def coefficients(model: DataFrame) -> DataFrame:
    """feature, coefficient; the intercept too."""
    return model.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit("intercept")), "features").alias("feature"), F.concat(F.array("intercept"), "coefficients").alias("coefficient"))).alias("x")).select(F.col("x.feature"), F.col("x.coefficient"))


def loss_history(model: DataFrame) -> DataFrame:
    """iteration (from 1), loss."""
    return model.select(F.posexplode("losses").alias("iteration", "loss")).select((F.col("iteration") + 1).alias("iteration"), "loss")


def logistic_probability(columns: list[str]) -> Column:
    """The probability of a row that has a model's columns beside its features."""
    z = F.col("intercept")
    for k, c in enumerate(columns):
        z = z + F.col("coefficients")[k] * (F.col(c) - F.col("means")[k]) / F.col("deviations")[k]
    return sigmoid(z)


def predict_logistic(df: DataFrame, model: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """Event columns, split, probability, classification_threshold, predicted_label, label."""
    got = df.crossJoin(F.broadcast(model.drop("losses")))  # one row
    return predictions(got.withColumn(P, logistic_probability(columns)), threshold)


def predictions(df: DataFrame, threshold: float = 0.5, model_type: str | None = None) -> DataFrame:
    """The columns of a prediction table from rows with probabilities."""
    extra = [F.lit(model_type).alias("model_type")] if model_type else []
    return df.select(*KEEP, "split", *extra, P, F.lit(threshold).alias("classification_threshold"), (F.col(P) >= threshold).cast("int").alias("predicted_label"), "label")


def placeholder_predictions(labels: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Predictions for trying a backtest out without a model: a noisy function of the label itself, so of no other use.

    0.38 + 0.32 * label + 0.16 * noise, within [0.05, 0.95]; the noise is normal, from a hash of event_id.
    """
    u = lambda k: (F.conv(F.substring(F.md5(F.concat("event_id", F.lit(f"|{k}")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.05), 0.38 + 0.32 * F.col("label") + 0.16 * noise))
    return predictions(labels.withColumn("split", F.lit("placeholder")).withColumn(P, p), threshold)


def train_logistic(matrix: DataFrame, columns: list[str], config: LogisticConfig = LogisticConfig()) -> dict[str, DataFrame]:
    """model, coefficients, losses, and predictions of validation and test rows (training rows get none)."""
    rows = time_split(impute(matrix, columns))
    model = fit_logistic(rows.where("split = 'train'"), columns, config)
    scored = predict_logistic(rows.where("split <> 'train'"), model, columns, config.threshold)
    return {"model": model, "coefficients": coefficients(model), "losses": loss_history(model), "predictions": scored}


NODE = "node_id int, depth int, n_samples int, positive_count int, probability double, impurity double, feature string, threshold double, information_gain double, left_node_id int, right_node_id int"


def fit_tree(train: DataFrame, columns: list[str], config: TreeConfig = TreeConfig()) -> DataFrame:
    """The nodes of a tree, a row each, numbered in preorder; none where there are no training rows."""
    require(config.criterion in ("gini", "entropy"), "criterion must be gini or entropy")
    nodes = [n | {"feature": None if n["feature"] is None else columns[n["feature"]]} for n in trees.grow(train, columns, config)]
    names = [x.split()[0] for x in NODE.split(", ")]
    return train.sparkSession.createDataFrame([tuple(n[c] for c in names) for n in nodes], NODE)


def tree_probability(nodes: list[dict]) -> Column:
    """Nested CASE WHEN over the nodes, collected (a tree has at most 2 ** (depth + 1) of them)."""
    by = {n["node_id"]: n for n in nodes}

    def case(k: int) -> Column:
        n = by[k]
        if n["feature"] is None:
            return F.lit(float(n["probability"]))
        return F.when(F.col(n["feature"]) <= F.lit(float(n["threshold"])), case(n["left_node_id"])).otherwise(case(n["right_node_id"]))

    return case(0)


def split_summary(nodes: DataFrame) -> DataFrame:
    """The inner nodes."""
    return nodes.where("feature is not null").select("node_id", "depth", "feature", "threshold", "information_gain", "n_samples", F.col("probability").alias("positive_rate"), "left_node_id", "right_node_id")


def leaf_summary(nodes: DataFrame) -> DataFrame:
    """The leaves."""
    return nodes.where("feature is null").select("node_id", "depth", "n_samples", "positive_count", F.col("probability").alias("positive_rate"), "impurity")


def train_tree(matrix: DataFrame, columns: list[str], config: TreeConfig = TreeConfig(), train: float = 0.7) -> dict[str, DataFrame]:
    """nodes, splits, leaves, and predictions of the rows after the first `train` share by time."""
    rows = _numbered(impute(matrix, columns), "event_date")
    at = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * train)))
    rows = rows.withColumn("split", F.when(F.col("rn") <= at, "train").otherwise("validation")).drop("rn", "n")
    nodes = fit_tree(rows.where("split = 'train'"), columns, config)
    grown = [r.asDict() for r in nodes.collect()]  # at most 2 ** (max_depth + 1) nodes
    scored = predictions(rows.where("split = 'validation'").withColumn(P, tree_probability(grown)), config.threshold, "decision_tree")
    return {"nodes": nodes, "splits": split_summary(nodes), "leaves": leaf_summary(nodes), "predictions": scored}
