"""Evaluation of probability models: confusion, summary metrics, curves, calibration, and sensitivity summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.functions.expressions import log_loss_term, over
from tercet.guards import require, require_columns
from tercet.operators.ordered import running

P, Y = "predicted_reversion_probability", "label"


def _by(split: str | None) -> list[str]:
    return [split] if split else []


def labelled(predictions: DataFrame, split: str | None = None) -> DataFrame:
    """Rows with a label; the columns of evaluation must be there."""
    return require_columns(predictions, [P, Y, *_by(split)]).where(F.col(Y).isNotNull())


def confusion_matrix(predictions: DataFrame, threshold: float = 0.5, split: str | None = None) -> DataFrame:
    """actual_label, predicted_label, count, threshold: four rows for each split, zeros included."""
    require(0 < threshold < 1, "threshold must be between 0 and 1")
    rows = labelled(predictions, split)
    n = rows.groupBy(*_by(split), F.col(Y).cast("int").alias("actual_label"), (F.col(P) >= threshold).cast("int").alias("predicted_label")).agg(F.count("*").alias("count"))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("actual_label"), F.lit(b).alias("predicted_label")) for a in (0, 1) for b in (0, 1))))
    grid = (rows.select(split).distinct() if split else rows.sparkSession.range(1)).select(*_by(split), cells.alias("c")).select(*_by(split), "c.*")
    got = grid.join(n, [*_by(split), "actual_label", "predicted_label"], "left")
    return got.select(*_by(split), "actual_label", "predicted_label", F.coalesce("count", F.lit(0)).alias("count"), F.lit(threshold).alias("threshold"))


def _counts(threshold: float) -> dict[str, Column]:
    y, hit = F.col(Y) == 1, F.col(P) >= threshold
    return {"true_positive": F.count_if(y & hit), "true_negative": F.count_if(~y & ~hit), "false_positive": F.count_if(~y & hit), "false_negative": F.count_if(y & ~hit)}


def rank_auc(predictions: DataFrame, split: str | None = None) -> DataFrame:
    """roc_auc by average ranks (Mann-Whitney); null where a class is absent.

    Ranks come from running counts over distinct probabilities, in ranges of them.
    """
    per = labelled(predictions, split).groupBy(*_by(split), P).agg(F.sum(F.col(Y).cast("long")).alias("pos"), F.count("*").alias("n"))
    ranked = running(per, _by(split), [P], {"upto": F.col("n")}).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    g = ranked.groupBy(*_by(split)).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("n1"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("n0"))
    return g.select(*_by(split), over(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("roc_auc"))


def classification_summary(predictions: DataFrame, threshold: float = 0.5, split: str | None = None) -> DataFrame:
    """One row for each split: counts, rates, accuracy, precision, recall, specificity, NPV, F1, losses and AUC."""
    require(0 < threshold < 1, "threshold must be between 0 and 1")
    rows = labelled(predictions, split)
    g = rows.groupBy(*_by(split)).agg(F.count("*").alias("n_obs"), F.avg(F.col(Y)).alias("positive_rate"), F.avg(log_loss_term(Y, P)).alias("log_loss"), F.avg((F.col(P) - F.col(Y)) ** 2).alias("brier_score"), *(c.alias(k) for k, c in _counts(threshold).items()))
    tp, tn, fp, fn = (F.col(k) for k in ("true_positive", "true_negative", "false_positive", "false_negative"))
    g = g.withColumns({"accuracy": over(tp + tn, "n_obs"), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "specificity": over(tn, tn + fp), "negative_predictive_value": over(tn, tn + fn), "threshold": F.lit(threshold)})
    g = g.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    auc = rank_auc(predictions, split)
    g = g.join(auc, split, "left") if split else g.crossJoin(auc)  # one row each
    return g.select(
        *_by(split), "n_obs", "positive_rate", "threshold", "accuracy", "precision", "recall", "specificity", "negative_predictive_value", "f1", "log_loss", "brier_score", "roc_auc",
        "true_positive", "true_negative", "false_positive", "false_negative",
    )


def losses(predictions: DataFrame, split: str | None = None) -> DataFrame:
    """brier_score and log_loss."""
    return labelled(predictions, split).groupBy(*_by(split)).agg(F.avg((F.col(P) - F.col(Y)) ** 2).alias("brier_score"), F.avg(log_loss_term(Y, P)).alias("log_loss"))


def _curve(predictions: DataFrame, split: str | None) -> DataFrame:
    """Distinct probabilities and two sentinels: pos, neg at each; tp, fp at it and above; all_pos, all_neg of the split."""
    per = labelled(predictions, split).groupBy(*_by(split), F.col(P).alias("threshold")).agg(F.sum(F.col(Y).cast("long")).alias("pos"), F.count("*").alias("n"))
    keys = per.select(*_by(split)).distinct() if split else per.sparkSession.range(1).select()
    ends = keys.select(*_by(split), F.explode(F.array(F.lit(2.0), F.lit(-1.0))).alias("threshold"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"))
    points = per.unionByName(ends).select(*_by(split), "threshold", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    return running(points, _by(split), [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")}, {"all_pos": "tp", "all_neg": "fp"})


def roc_curve(predictions: DataFrame, split: str | None = None) -> DataFrame:
    """threshold, true_positive_rate, false_positive_rate at each distinct probability, and above and below all.

    The sentinels have thresholds 2 and -1; a rate whose class is absent is null.
    """
    return _curve(predictions, split).select(*_by(split), "threshold", over("tp", "all_pos").alias("true_positive_rate"), over("fp", "all_neg").alias("false_positive_rate"))


def trapezoid_auc(predictions: DataFrame, split: str | None = None) -> DataFrame:
    """roc_auc as the area below roc_curve(); equals rank_auc().  A point's share needs no neighbour: it knows its own step."""
    area = over("neg", "all_neg") * over(2 * F.col("tp") - F.col("pos"), "all_pos") / 2
    return _curve(predictions, split).groupBy(*_by(split)).agg(F.sum(area).alias("roc_auc"))


def probability_buckets(predictions: DataFrame, n_bins: int = 5, split: str | None = None) -> DataFrame:
    """All right-closed bins of [0, 1], also empty ones: counts, mean probability, realised success rate."""
    require(n_bins > 0, "n_bins must be positive")
    k = F.greatest(F.lit(1), F.ceil(F.col(P) * n_bins).cast("int"))
    rows = labelled(predictions, split)
    n = rows.groupBy(*_by(split), k.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(Y).cast("long")).alias("s"), F.avg(P).alias("mean_predicted_probability"))
    grid = (rows.select(split).distinct() if split else rows.sparkSession.range(1)).select(*_by(split), F.explode(F.sequence(F.lit(1), F.lit(n_bins))).alias("bin"))
    got = grid.join(n, [*_by(split), "bin"], "left")
    low, high = (F.col("bin") - 1) / n_bins, F.col("bin") / n_bins
    rate = over("s", "n")
    return got.select(
        *_by(split), F.format_string("(%.2f, %.2f]", low, high).alias("probability_bucket"), low.alias("bucket_lower"), high.alias("bucket_upper"), F.coalesce("n", F.lit(0)).alias("n_events"),
        F.coalesce("s", F.lit(0)).alias("success_count"), (F.coalesce("n", F.lit(0)) - F.coalesce("s", F.lit(0))).alias("failure_count"), "mean_predicted_probability", rate.alias("realized_success_rate"), rate.alias("precision"),
    )


def calibration_curve(predictions: DataFrame, n_bins: int = 5, split: str | None = None) -> DataFrame:
    """Bins that have events, with the signed and absolute distance of realised from predicted rates."""
    b = probability_buckets(predictions, n_bins, split).where("n_events > 0")
    error = F.col("realized_success_rate") - F.col("mean_predicted_probability")
    return b.select(*_by(split), "probability_bucket", "n_events", "mean_predicted_probability", "realized_success_rate", error.alias("calibration_error"), F.abs(error).alias("absolute_calibration_error"))


def evaluate(predictions: DataFrame, threshold: float = 0.5, n_bins: int = 5, split: str = "split") -> dict[str, DataFrame]:
    """All five tables, by split."""
    return {
        "summary": classification_summary(predictions, threshold, split), "confusion": confusion_matrix(predictions, threshold, split), "buckets": probability_buckets(predictions, n_bins, split),
        "calibration": calibration_curve(predictions, n_bins, split), "roc": roc_curve(predictions, split),
    }


def cost_drag(summary: DataFrame) -> DataFrame:
    """Cost scenarios with cost_drag (gross - net) and its ratio to |gross|."""
    drag = F.col("gross_pnl") - F.col("net_pnl")
    return summary.select("cost_scenario", "strategy", "trade_count", "gross_pnl", "net_pnl", drag.alias("cost_drag"), over(drag, F.abs("gross_pnl")).alias("cost_drag_ratio"))


def cost_adjusted_performance(summary: DataFrame) -> DataFrame:
    """Net to gross ratios beside the drag."""
    drag = F.col("gross_pnl") - F.col("net_pnl")
    return summary.select("cost_scenario", "strategy", "trade_count", "gross_pnl", "net_pnl", "win_rate", "max_drawdown", "sharpe", drag.alias("cost_drag"), over(drag, F.abs("gross_pnl")).alias("cost_drag_ratio"), over("net_pnl", "gross_pnl").alias("net_to_gross_ratio"))


def threshold_pivot(sensitivity: DataFrame, exits: list[float], metric: str = "net_pnl") -> DataFrame:
    """strategy, entry_threshold, and the mean of `metric` in a column exit_<value> for each exit threshold."""
    got = sensitivity.groupBy("strategy", "entry_threshold").pivot("exit_threshold", exits).agg(F.avg(metric))
    return got.select("strategy", "entry_threshold", *(F.col(f"`{x}`").alias(f"exit_{x:g}".replace(".", "_")) for x in exits))


def robustness_summary(thresholds: DataFrame, costs: DataFrame) -> DataFrame:
    """Per strategy: spread of results over the threshold grid, and the worst and mean over cost scenarios."""
    t = thresholds.groupBy("strategy").agg(
        F.count("*").alias("threshold_scenarios"), F.avg("net_pnl").alias("average_net_pnl"), F.percentile("net_pnl", F.lit(0.5)).alias("median_net_pnl"), F.min("net_pnl").alias("worst_net_pnl"), F.max("net_pnl").alias("best_net_pnl"),
        F.avg((F.col("net_pnl") > 0).cast("int")).alias("profitable_scenario_rate"), F.avg("sharpe").alias("average_sharpe"), F.min("max_drawdown").alias("worst_drawdown"), F.avg("turnover").alias("average_turnover"),
        F.min("trade_count").alias("minimum_trade_count"), F.max("trade_count").alias("maximum_trade_count"),
    )
    c = cost_drag(costs).groupBy("strategy").agg(F.count_distinct("cost_scenario").alias("cost_scenarios"), F.min("net_pnl").alias("worst_cost_adjusted_net_pnl"), F.avg("cost_drag").alias("average_cost_drag"), F.max("cost_drag").alias("maximum_cost_drag"))
    return t.join(c, "strategy", "left")
