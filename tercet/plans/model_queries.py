"""Queries from features to models, evaluation, backtests and portfolios, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.functions import expressions as x
from tercet.operators import backtest, features, kalman, metrics, models, portfolio, regimes, stationarity
from tercet.operators.ordered import as_of
from tercet.operators.residuals import GROUP
from tercet.plans.frames import FEATURES, Frames, rounded
from tercet.sources.stages import stored
from tercet.plans.oracle import CORR, PERFORMANCE, REGIME, RULE, SUMMARY, part, query, r

QUERIES: dict = {}
SQL: dict[str, str] = {}
COSTS = (*backtest.DEFAULT_COSTS, backtest.Cost("borrow", 0.01, 0.025, 0.015, 2.0))
GRID = backtest.Grid()
#: Events begin at extreme z-scores, where a reversion is never likely at once: the threshold that tells their days apart.
EVENT_REGIME = 0.01
NUMERIC = ["entry_z_score", "entry_abs_z", "z_score", "residual", *features.RESIDUAL_FEATURES, *features.COEFFICIENT_FEATURES, *features.MARKET_FEATURES]
MODEL_COLUMNS = ["entry_abs_z", "residual_change", "residual_volatility", "residual_autocorrelation", "rolling_r_squared", "target_return_volatility", "market_return", "anchor_correlation", "recent_drawdown", "volume_shock"]


def register(name, build, sql: str | None = None, digits: int = 6) -> None:
    """As in market_queries."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(Frames(spark, sf_dir)), digits)
    if sql is not None:
        SQL[name] = query(sql)


# Features
register("fe2_residual_features", lambda f: features.residual_panel(f.scored, FEATURES), f"SELECT triplet_id, method, date, {r('residual', 'z_score', *features.RESIDUAL_FEATURES, digits=4)} FROM c_resid_panel", 4)
register("fe7_coefficient_features", lambda f: features.coefficient_panel(f.coefficients, FEATURES), f"SELECT triplet_id, method, date, {r(*features.COEFFICIENT_FEATURES, digits=5)} FROM c_coef_panel", 5)
register("fe8_market_features", lambda f: features.market_features(f.events, f.market, FEATURES, stored), f"SELECT event_id, {r(*features.MARKET_FEATURES)} FROM c_market_features")
register("fe9_as_of_dates", lambda f: _off_calendar(f), "SELECT (event_date + 3)::DATE AS event_date, event_date AS as_of FROM (SELECT DISTINCT event_date FROM c_events)".replace("(event_date + 3)::DATE AS event_date, event_date AS as_of", "CAST(event_date + 3 AS VARCHAR) AS shifted, CAST(event_date AS VARCHAR) AS as_of"))
register("fe9_as_of_prices", lambda f: _seen_prices(f), f"""SELECT event_id, symbol, strftime(moment, '%Y-%m-%d %H:%M') AS moment, CASE WHEN near THEN CAST(as_of AS VARCHAR) END AS as_of, {r('CASE WHEN near THEN adj_close END AS seen_price')} FROM (
  SELECT e.*, p.date AS as_of, p.adj_close, p.date::TIMESTAMP >= moment - INTERVAL 1 DAY AS near FROM (SELECT event_id, target_symbol AS symbol, event_date::TIMESTAMP + to_hours(event_row % 12 * 24 + event_row % 24) AS moment FROM c_events) e
  ASOF LEFT JOIN (SELECT symbol, date, adj_close FROM c_clean WHERE quality_flag = 'clean') p ON e.symbol = p.symbol AND e.moment >= p.date::TIMESTAMP)""")
register("fe22_feature_outputs", lambda f: _outputs(f), f"SELECT 'feature_matrix' AS output, count(*) AS rows FROM c_matrix UNION ALL SELECT * FROM (VALUES ('feature_summary_statistics', {len(NUMERIC)}), ('feature_missingness_report', {len(NUMERIC) + len(features.METADATA) + len(features.LABELS)}), ('feature_correlation_matrix', {len(NUMERIC) * (len(NUMERIC) + 1) // 2}))")
register("fe1_feature_matrix", lambda f: f.matrix, f"SELECT event_id, triplet_id, method, event_date, target_symbol, hedge_symbol_1, hedge_symbol_2, side, {r(*NUMERIC, digits=4)}, label, outcome, exit_reason, holding_period FROM c_matrix", 4)
_STATS = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS count, {r(f'avg({c}) AS mean', f'stddev_samp({c}) AS std', f'min({c}) AS min', f'quantile_cont({c}, 0.25) AS p25', f'quantile_cont({c}, 0.5) AS median', f'quantile_cont({c}, 0.75) AS p75', f'max({c}) AS max', digits=4)} FROM c_matrix" for c in NUMERIC)
register("fe17_summary_statistics", lambda f: features.summary_statistics(f.matrix, NUMERIC), _STATS, 4)
_META = [*features.METADATA, *NUMERIC, *features.LABELS]
register("fe18_missingness", lambda f: features.missingness(f.matrix), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, {r(f'(count(*) - count({c})) / count(*) AS missing_rate')} FROM c_matrix" for c in _META))
_PAIRS = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'c': {CORR.format(a=a, b=b)}}}" for k, a in enumerate(NUMERIC) for b in NUMERIC[k:])
_CORRELATIONS = f"SELECT p.a AS feature_1, p.b AS feature_2, p.c AS correlation FROM (SELECT unnest([{_PAIRS}]) AS p FROM c_matrix)"
register("fe19_correlation_matrix", lambda f: features.correlation_matrix(f.matrix, NUMERIC), f"SELECT feature_1, feature_2, {r('correlation', digits=4)} FROM ({_CORRELATIONS})", 4)
register("fe20_collinear_pairs", lambda f: features.collinear_pairs(features.correlation_matrix(f.matrix, NUMERIC)), f"SELECT feature_1, feature_2, {r('correlation', 'abs(correlation) AS absolute_correlation', digits=4)} FROM ({_CORRELATIONS}) WHERE feature_1 <> feature_2 AND abs(correlation) >= 0.85", 4)
_SCALED = ["entry_abs_z", "residual_volatility", "volume_shock"]
_SCALER = " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'avg({c}) AS mean', f'coalesce(nullif(stddev_pop({c}), 0), 1) AS standard_deviation')} FROM c_matrix" for c in _SCALED)
register("fe21_feature_scaler", lambda f: features.scaler(f.matrix, _SCALED), _SCALER)
register("fe21_scaled_matrix", lambda f: features.scale(f.matrix, _SCALED).select("event_id", *_SCALED), "SELECT event_id, " + ", ".join(r(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}", digits=5) for c in _SCALED) + " FROM c_matrix", 5)


def _outputs(f: Frames) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("output"), F.count("*").alias("rows")) for name, df in features.feature_outputs(f.matrix, NUMERIC).items()]
    return reduce(DataFrame.union, parts)


def _off_calendar(f: Frames) -> DataFrame:
    """The calendar date that events on Thursdays, three days after their week began, see."""
    late = f.events.withColumn("event_date", F.date_add("event_date", 3))
    return features.as_of_dates(late, features.market_grid(f.market)).select(F.col("event_date").alias("shifted"), "as_of")


def _seen_prices(f: Frames) -> DataFrame:
    """The price of its target that an event sees some days and hours after its week began; at most a day old."""
    moment = F.col("event_date").cast("timestamp") + F.make_dt_interval(F.col("event_row") % 12, F.col("event_row") % 24)
    late = f.events.select("event_id", F.col("target_symbol").alias("symbol"), moment.alias("moment"))
    gaps = f.clean.where("quality_flag = 'clean'")
    return as_of(late, gaps, ["symbol"], "moment", "date", ["adj_close"], "1 days").select("event_id", "symbol", F.date_format("moment", "yyyy-MM-dd HH:mm").alias("moment"), "as_of", F.col("adj_close").alias("seen_price"))


# Models: splits, imputation, scoring; trained models have no SQL
register("ml1_log_loss", lambda f: f.predictions.agg(F.avg(x.log_loss_term("label", models.P)).alias("log_loss"), F.avg(x.sigmoid(F.col("label") * 2.0 - 1)).alias("mean_sigmoid")), f"SELECT {r('avg(-(label * ln(predicted_reversion_probability) + (1 - label) * ln(1 - predicted_reversion_probability))) AS log_loss', 'avg(1 / (1 + exp(-(label * 2.0 - 1)))) AS mean_sigmoid')} FROM c_preds")
register("ml5_prediction_frame", lambda f: f.predictions, f"SELECT event_id, triplet_id, method, event_date, split, {r('predicted_reversion_probability')}, classification_threshold::DOUBLE AS classification_threshold, predicted_label, label FROM c_preds")
register("ml9_time_split", lambda f: models.time_split(f.labels).groupBy("split").agg(F.count("*").alias("n"), F.min("event_date").alias("first_clean_date"), F.max("event_date").alias("last_clean_date")), "SELECT split, count(*) AS n, min(event_date) AS first_clean_date, max(event_date) AS last_clean_date FROM c_preds GROUP BY split")
register("ml10_walk_forward", lambda f: models.walk_forward(f.labels, 500, 100, 250).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most")), "SELECT fold, CASE WHEN rn2 <= 500 + fold * 250 THEN 'train' ELSE 'validation' END AS role, count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM c_preds0, (SELECT unnest(range(0, 1000)) AS fold) WHERE fold <= floor((nn - 600) / 250) AND rn2 <= 600 + fold * 250 GROUP BY 1, 2")
register("ml12_imputed_frame", lambda f: models.impute(f.matrix, _SCALED).select("event_id", "label", *_SCALED), "SELECT event_id, label, " + ", ".join(r(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM c_matrix)) AS {c}") for c in _SCALED) + " FROM c_matrix WHERE label IS NOT NULL")
register("ml14_impurities", lambda f: _impurities(f), f"SELECT triplet_id, {r('2 * p * (1 - p) AS gini', 'CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END AS entropy')} FROM (SELECT triplet_id, sum(label) / count(*) AS p FROM c_labels GROUP BY triplet_id)")
register("ml19_large_enough", lambda f: models.large_enough(f.labels), "SELECT count(label) AS n_events, count(CASE WHEN label = 1 THEN 1 END) AS n_positive, count(CASE WHEN label = 0 THEN 1 END) AS n_negative, count(label) >= 100 AND count(CASE WHEN label = 1 THEN 1 END) >= 20 AND count(CASE WHEN label = 0 THEN 1 END) >= 20 AS large_enough FROM c_labels")
_TRAIN = models.LogisticConfig()
_M = MODEL_COLUMNS
part("c_medians", "SELECT " + ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0.0) AS {c}" for c in _M) + " FROM c_matrix WHERE label IS NOT NULL")
part("c_model_rows", "SELECT m.event_id, m.triplet_id, m.method, m.event_date, m.label, " + ", ".join(f"coalesce(m.{c}, d.{c}) AS {c}" for c in _M) + ", row_number() OVER (ORDER BY m.event_date, m.event_id) AS rn, count(*) OVER () AS n FROM c_matrix m, c_medians d WHERE m.label IS NOT NULL")
part("c_model_split", "SELECT *, CASE WHEN rn <= greatest(1, floor(n * 0.6)) THEN 'train' WHEN rn <= least(greatest(greatest(1, floor(n * 0.6)) + 1, floor(n * 0.8)), n - 1) THEN 'validation' ELSE 'test' END AS split FROM c_model_rows")
part("c_model_scale", "SELECT " + ", ".join(f"avg({c}) AS m{k}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s{k}" for k, c in enumerate(_M)) + " FROM c_model_split WHERE split = 'train'")
part("c_model_z", "SELECT event_id, triplet_id, method, event_date, label, split, [1.0::DOUBLE, " + ", ".join(f"({c} - m{k}) / s{k}" for k, c in enumerate(_M)) + "] AS x FROM c_model_split, c_model_scale")
# one step of descent a row: the loss before the step, and the weights after it
part("c_descent", f"""/*recursive*/ SELECT 0 AS iteration, list_transform(range({len(_M) + 1}), lambda i: 0.0::DOUBLE) AS w, NULL::DOUBLE AS loss, false AS done
  UNION ALL SELECT iteration + 1, list_transform(list_zip(w, g), lambda p: p[1] - {_TRAIN.learning_rate} * p[2]), now, coalesce(abs(now - loss) < {_TRAIN.tolerance}, false)
  FROM (SELECT iteration, w, loss, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS now, [{', '.join(f'avg((p - label) * x[{k + 1}])' for k in range(len(_M) + 1))}] AS g
    FROM (SELECT d.iteration, d.w, d.loss, z.label, z.x, least(greatest(1 / (1 + exp(-list_inner_product(d.w, z.x))), 1e-12), 1 - 1e-12) AS p FROM c_descent d, c_model_z z WHERE z.split = 'train' AND NOT d.done AND d.iteration < {_TRAIN.max_iter}) GROUP BY iteration, w, loss)""")
part("c_weights", "SELECT arg_max(w, iteration) AS w FROM c_descent")
_NAMES = "[" + ", ".join(f"'{c}'" for c in ("intercept", *_M)) + "]"
register("ml2_logistic_coefficients", lambda f: models.train_logistic(f.matrix, MODEL_COLUMNS, _TRAIN)["coefficients"], f"SELECT unnest({_NAMES}) AS feature, round(unnest(w), 4) + 0.0 AS coefficient FROM c_weights", 4)
register("ml4_logistic_losses", lambda f: models.train_logistic(f.matrix, MODEL_COLUMNS, _TRAIN)["losses"], f"SELECT iteration, {r('loss')} FROM c_descent WHERE iteration > 0")
register("ml13_logistic_predictions", lambda f: models.train_logistic(f.matrix, MODEL_COLUMNS, _TRAIN)["predictions"], f"SELECT event_id, triplet_id, method, event_date, split, {r('p AS predicted_reversion_probability', digits=5)}, 0.5::DOUBLE AS classification_threshold, CAST(p >= 0.5 AS INTEGER) AS predicted_label, label FROM (SELECT *, 1 / (1 + exp(-list_inner_product(w, x))) AS p FROM c_model_z, c_weights WHERE split <> 'train')", 5)
# The tree: rows carry the path of turns to their node; in the order of paths, nodes are in preorder
_TREE = models.TreeConfig()
_GINI = "2 * ({s} / {n}) * (1 - {s} / {n})"
part("c_tree_0", "SELECT event_id, triplet_id, method, event_date, label, [" + ", ".join(_M) + "] AS x, rn <= greatest(1, least(n - 1, floor(n * 0.7))) AS train, '' AS path FROM c_model_rows")
for _d in range(_TREE.max_depth):
    part(f"c_tree_values_{_d}", f"SELECT path, f, v, count(*) AS n, sum(label) AS s FROM (SELECT path, label, unnest(range(1, {len(_M) + 1})) AS f, unnest(x) AS v FROM c_tree_{_d} WHERE train) GROUP BY path, f, v")
    part(f"c_tree_cuts_{_d}", f"SELECT DISTINCT path, f, unnest(CASE WHEN len(c) > {_TREE.max_thresholds} THEN list_aggregate(c, 'quantile_cont', {[k / (_TREE.max_thresholds + 1) for k in range(1, _TREE.max_thresholds + 1)]}) ELSE c END) AS cut FROM (SELECT path, f, list(m) FILTER (m IS NOT NULL) AS c FROM (SELECT path, f, (v + lead(v) OVER (PARTITION BY path, f ORDER BY v)) / 2 AS m FROM c_tree_values_{_d}) GROUP BY path, f)")
    part(f"c_tree_gain_{_d}", f"SELECT path, f, cut, {_GINI.format(s='s', n='n')} - (nl * {_GINI.format(s='sl', n='nl')} + (n - nl) * {_GINI.format(s='(s - sl)', n='(n - nl)')}) / n AS gain FROM (SELECT c.path, c.f, c.cut, sum(v.n) FILTER (v.v <= c.cut) AS nl, sum(v.s) FILTER (v.v <= c.cut) AS sl, sum(v.n) AS n, sum(v.s) AS s FROM c_tree_cuts_{_d} c JOIN c_tree_values_{_d} v USING (path, f) GROUP BY ALL) WHERE nl >= {_TREE.min_samples_leaf} AND n - nl >= {_TREE.min_samples_leaf} AND n >= {_TREE.min_samples_split} AND s > 0 AND s < n")
    part(f"c_tree_best_{_d}", f"SELECT * FROM c_tree_gain_{_d} WHERE gain >= {_TREE.min_impurity_decrease} QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, f, cut) = 1")
    part(f"c_tree_{_d + 1}", f"SELECT t.* REPLACE (path || CASE WHEN x[f] <= cut THEN 'L' ELSE 'R' END AS path) FROM c_tree_{_d} t JOIN c_tree_best_{_d} USING (path)")
part("c_tree_nodes", "SELECT row_number() OVER (ORDER BY path) - 1 AS node_id, q.*, b.f, b.cut, b.gain FROM (" + " UNION ALL ".join(f"SELECT path, {d} AS depth, count(*) AS n, sum(label) AS s FROM c_tree_{d} WHERE train GROUP BY path" for d in range(_TREE.max_depth + 1)) + ") q LEFT JOIN (" + " UNION ALL ".join(f"SELECT * FROM c_tree_best_{d}" for d in range(_TREE.max_depth)) + ") b USING (path)")
part("c_tree_preds", "SELECT event_id, triplet_id, method, event_date, label, n.s / n.n AS p FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY len(path) DESC) AS k FROM (" + " UNION ALL ".join(f"SELECT * FROM c_tree_{d}" for d in range(_TREE.max_depth + 1)) + ") WHERE NOT train) t JOIN c_tree_nodes n USING (path) WHERE k = 1")
_TURN = "(SELECT CAST(m.node_id AS INTEGER) FROM c_tree_nodes m WHERE m.path = n.path || '{t}')"
register("ml15_tree_splits", lambda f: models.train_tree(f.matrix, MODEL_COLUMNS)["splits"], f"SELECT CAST(node_id AS INTEGER) AS node_id, depth, [{', '.join(repr(c) for c in _M)}][f] AS feature, {r('cut AS threshold', 'gain AS information_gain')}, CAST(n.n AS INTEGER) AS n_samples, {r('s / n.n AS positive_rate')}, {_TURN.format(t='L')} AS left_node_id, {_TURN.format(t='R')} AS right_node_id FROM c_tree_nodes n WHERE f IS NOT NULL")
register("ml16_tree_predictions", lambda f: models.train_tree(f.matrix, MODEL_COLUMNS)["predictions"], f"SELECT event_id, triplet_id, method, event_date, 'validation' AS split, 'decision_tree' AS model_type, {r('p AS predicted_reversion_probability')}, 0.5::DOUBLE AS classification_threshold, CAST(p >= 0.5 AS INTEGER) AS predicted_label, label FROM c_tree_preds")
register("ml17_tree_leaves", lambda f: models.train_tree(f.matrix, MODEL_COLUMNS)["leaves"], f"SELECT CAST(node_id AS INTEGER) AS node_id, depth, CAST(n.n AS INTEGER) AS n_samples, CAST(s AS INTEGER) AS positive_count, {r('s / n.n AS positive_rate', _GINI.format(s='s', n='n.n') + ' AS impurity')} FROM c_tree_nodes n WHERE f IS NULL")
part("c_compared", "SELECT model_type, label, least(greatest(p, 1e-12), 1 - 1e-12) AS predicted_reversion_probability FROM (SELECT 'decision_tree' AS model_type, label, p FROM c_tree_preds UNION ALL SELECT 'logistic_regression', label, 1 / (1 + exp(-list_inner_product(w, x))) FROM c_model_z, c_weights WHERE split <> 'train')")


def _impurities(f: Frames) -> DataFrame:
    g = f.labels.groupBy("triplet_id").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    return g.select("triplet_id", x.gini("s", "n").alias("gini"), x.entropy("s", "n").alias("entropy"))


def _compare_models(f: Frames) -> DataFrame:
    tree = models.train_tree(f.matrix, MODEL_COLUMNS)["predictions"]
    logistic = models.train_logistic(f.matrix, MODEL_COLUMNS, _TRAIN)["predictions"].withColumn("model_type", F.lit("logistic_regression"))
    return metrics.classification_summary(tree.unionByName(logistic), 0.5, "model_type")


# Evaluation
_HIT = "predicted_reversion_probability >= 0.5"
_CELLS = "(SELECT unnest([0, 0, 1, 1]) AS actual_label, unnest([0, 1, 0, 1]) AS predicted_label)"
register("mt1_confusion_matrix", lambda f: metrics.confusion_matrix(f.predictions, 0.5, "split"), f"SELECT s.split, c.actual_label, c.predicted_label, count(p.event_id) AS count, 0.5::DOUBLE AS threshold FROM (SELECT DISTINCT split FROM c_preds) s CROSS JOIN {_CELLS} c LEFT JOIN c_preds p ON p.split = s.split AND p.label = c.actual_label AND p.predicted_label = c.predicted_label GROUP BY s.split, c.actual_label, c.predicted_label")
_AUC = "SELECT {by}(sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS roc_auc FROM (SELECT {by}label, rank() OVER (PARTITION BY {part} ORDER BY predicted_reversion_probability) + (count(*) OVER (PARTITION BY {part}, predicted_reversion_probability) - 1) / 2 AS rk FROM c_preds) {group}"
_AUC_SPLIT, _AUC_ALL = _AUC.format(by="split, ", part="split", group="GROUP BY split"), _AUC.format(by="", part="1", group="")
_RATES = r("positive_rate", "(tp + tn) / n_obs AS accuracy", "tp / nullif(tp + fp, 0) AS precision", "tp / nullif(tp + fn, 0) AS recall", "tn / nullif(tn + fp, 0) AS specificity", "tn / nullif(tn + fn, 0) AS negative_predictive_value", "2 * tp / nullif(2 * tp + fp + fn, 0) AS f1", "log_loss", "brier_score", "roc_auc")
_COUNTS = f"count(*) AS n_obs, avg(label) AS positive_rate, avg(-(label * ln(predicted_reversion_probability) + (1 - label) * ln(1 - predicted_reversion_probability))) AS log_loss, avg((predicted_reversion_probability - label) ** 2) AS brier_score, count(CASE WHEN label = 1 AND {_HIT} THEN 1 END) AS tp, count(CASE WHEN label = 0 AND NOT ({_HIT}) THEN 1 END) AS tn, count(CASE WHEN label = 0 AND {_HIT} THEN 1 END) AS fp, count(CASE WHEN label = 1 AND NOT ({_HIT}) THEN 1 END) AS fn"
_FOUR = "tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative"
_EVALUATION = f"SELECT split, n_obs, 0.5::DOUBLE AS threshold, positive_rate, (tp + tn) / n_obs AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, brier_score, roc_auc, {_FOUR} FROM (SELECT split, {_COUNTS} FROM c_preds GROUP BY split) JOIN ({_AUC_SPLIT}) USING (split)"
register("mt2_classification_summary", lambda f: metrics.classification_summary(f.predictions, 0.5, "split"), f"SELECT split, n_obs, 0.5::DOUBLE AS threshold, {_RATES}, {_FOUR} FROM (SELECT split, {_COUNTS} FROM c_preds GROUP BY split) JOIN ({_AUC_SPLIT}) USING (split)")
register("ml6_validation_metrics", lambda f: metrics.classification_summary(f.predictions, 0.5), f"SELECT n_obs, 0.5::DOUBLE AS threshold, {_RATES}, {_FOUR} FROM (SELECT {_COUNTS} FROM c_preds), ({_AUC_ALL})")
_both = lambda sql: sql.replace("c_preds", "c_compared").replace("split", "model_type")
register("ml18_tree_vs_logistic", lambda f: _compare_models(f), f"SELECT model_type, n_obs, 0.5::DOUBLE AS threshold, {_RATES}, {_FOUR} FROM (SELECT model_type, {_COUNTS} FROM c_compared GROUP BY model_type) JOIN ({_both(_AUC_SPLIT)}) USING (model_type)")
register("mt3_losses", lambda f: metrics.losses(f.predictions, "split"), f"SELECT split, {r('brier_score', 'log_loss')} FROM (SELECT split, {_COUNTS} FROM c_preds GROUP BY split)")
register("ml7_rank_auc", lambda f: metrics.rank_auc(f.predictions, "split"), f"SELECT split, {r('roc_auc')} FROM ({_AUC_SPLIT})")
_CURVE = "SELECT split, t, sum(pos) OVER w / nullif(sum(pos) OVER (PARTITION BY split), 0) AS tpr, sum(n - pos) OVER w / nullif(sum(n - pos) OVER (PARTITION BY split), 0) AS fpr FROM (SELECT split, predicted_reversion_probability AS t, sum(label) AS pos, count(*) AS n FROM c_preds GROUP BY 1, 2 UNION ALL SELECT DISTINCT split, 2.0, 0, 0 FROM c_preds UNION ALL SELECT DISTINCT split, -1.0, 0, 0 FROM c_preds) WINDOW w AS (PARTITION BY split ORDER BY t DESC ROWS UNBOUNDED PRECEDING)"
register("mt4_roc_curve", lambda f: metrics.roc_curve(f.predictions, "split"), f"SELECT split, {r('t AS threshold', 'tpr AS true_positive_rate', 'fpr AS false_positive_rate')} FROM ({_CURVE})")
register("mt5_trapezoid_auc", lambda f: metrics.trapezoid_auc(f.predictions, "split"), f"SELECT split, {r('roc_auc')} FROM ({_AUC_SPLIT})")
_BINS = "SELECT s.split, b.bin, count(p.event_id) AS n, coalesce(sum(p.label), 0) AS s1, avg(p.predicted_reversion_probability) AS m, sum(p.label) / nullif(count(p.event_id), 0) AS rate FROM (SELECT DISTINCT split FROM c_preds) s CROSS JOIN (SELECT unnest(range(1, 6)) AS bin) b LEFT JOIN c_preds p ON p.split = s.split AND greatest(1, ceil(p.predicted_reversion_probability * 5)) = b.bin GROUP BY s.split, b.bin"
_NAME = "format('({:.2f}, {:.2f}]', (bin - 1) / 5, bin / 5) AS probability_bucket"
_ALL_BUCKETS = f"SELECT split, {_NAME}, n AS n_events, m AS mean_predicted_probability, rate AS realized_success_rate, rate AS precision FROM ({_BINS})"
register("mt6_probability_buckets", lambda f: metrics.probability_buckets(f.predictions, 5, "split"), f"SELECT split, {_NAME}, {r('(bin - 1) / 5 AS bucket_lower', 'bin / 5 AS bucket_upper', 'm AS mean_predicted_probability', 'rate AS realized_success_rate', 'rate AS precision')}, n AS n_events, s1::BIGINT AS success_count, (n - s1)::BIGINT AS failure_count FROM ({_BINS})")
register("mt7_calibration_curve", lambda f: metrics.calibration_curve(f.predictions, 5, "split"), f"SELECT split, {_NAME}, n AS n_events, {r('m AS mean_predicted_probability', 'rate AS realized_success_rate', 'rate - m AS calibration_error', 'abs(rate - m) AS absolute_calibration_error')} FROM ({_BINS}) WHERE n > 0")
register("ml8_calibration_table", lambda f: metrics.probability_buckets(f.predictions, 10).select("probability_bucket", "n_events", "mean_predicted_probability", F.col("realized_success_rate").alias("observed_success_rate")), f"SELECT format('({{:.2f}}, {{:.2f}}]', (bin - 1) / 10, bin / 10) AS probability_bucket, count(event_id) AS n_events, {r('avg(predicted_reversion_probability) AS mean_predicted_probability', 'sum(label) / nullif(count(event_id), 0) AS observed_success_rate')} FROM (SELECT unnest(range(1, 11)) AS bin) LEFT JOIN c_preds ON greatest(1, ceil(predicted_reversion_probability * 10)) = bin GROUP BY bin")
register("mt8_evaluate_predictions", lambda f: metrics.evaluate(f.predictions)["summary"].select("split", "n_obs", "accuracy", "roc_auc"), f"SELECT split, n_obs, {r('(tp + tn) / n_obs AS accuracy', 'roc_auc')} FROM (SELECT split, {_COUNTS} FROM c_preds GROUP BY split) JOIN ({_AUC_SPLIT}) USING (split)")

# Backtests
_TRADE = r("predicted_reversion_probability", "entry_z_score", "exit_z_score", "spread_pnl_units", "position_size", "gross_pnl", "transaction_cost", "net_pnl", "turnover")
_trade_columns = ["event_id", "triplet_id", "method", "event_date", "exit_date", "pnl_date", "split", "strategy", "side", "label", "outcome", "exit_reason", "holding_period", models.P, "entry_z_score", "exit_z_score", "spread_pnl_units", "position_size", "gross_pnl", "transaction_cost", "net_pnl", "turnover"]
register("bt1_backtest_events", lambda f: f.traded.select("event_id", "split", "pnl_date", models.P), f"SELECT event_id, split, pnl_date, {r('predicted_reversion_probability')} FROM c_traded")
register("bt2_spread_pnl", lambda f: f.traded.select("event_id", backtest.spread_pnl().alias("spread_pnl_units")), f"SELECT event_id, {r('spread_pnl_units')} FROM c_traded")
register("bt3_strategy_trades", lambda f: f.trades.select(*_trade_columns), f"SELECT event_id, triplet_id, method, event_date, exit_date, pnl_date, split, strategy, side, label, outcome, exit_reason, holding_period, {_TRADE} FROM c_trades")
_PERF = f"trade_count, {r(*PERFORMANCE, digits=5)}"
register("bt4_backtest_comparison", lambda f: backtest.compare(f.labels.where("exit_z_score is not null"), f.predictions, 0.5, 0.05)["summary"], f"SELECT strategy, {_PERF} FROM c_perf", 5)
register("bt5_avoided_trades", lambda f: backtest.avoided_trades(f.traded, 0.5, 0.05), f"SELECT 0.5::DOUBLE AS probability_threshold, count(*) AS avoided_trade_count, count(CASE WHEN label = 0 THEN 1 END) AS avoided_failure_count, count(CASE WHEN label = 1 THEN 1 END) AS avoided_success_count, {r('count(CASE WHEN label = 0 THEN 1 END) / nullif(count(*), 0) AS avoided_failure_rate', 'coalesce(sum(spread_pnl_units - 0.05), 0) AS avoided_baseline_net_pnl', 'avg(predicted_reversion_probability) AS avoided_average_probability')} FROM c_traded WHERE predicted_reversion_probability <= 0.5")
register("bt6_trade_count_comparison", lambda f: backtest.trade_count_comparison(portfolio.performance(f.trades)), f"SELECT strategy, trade_count, {r('trade_count / (SELECT trade_count FROM c_perf WHERE strategy = $$baseline_rule_based$$) AS trade_count_ratio')} FROM c_perf")
register("bt7_pnl_comparison", lambda f: backtest.pnl_comparison(portfolio.performance(f.trades)), f"SELECT strategy, {r('gross_pnl', 'net_pnl', 'average_net_pnl', 'max_drawdown', 'sharpe', digits=5)} FROM c_perf", 5)
register("bt9_repriced_trades", lambda f: backtest.apply_costs(f.trades, COSTS).select("cost_scenario", "strategy", "event_id", "transaction_cost", "net_pnl"), f"SELECT cost_scenario, strategy, event_id, {r('transaction_cost', 'net_pnl')} FROM c_repriced")
register("bt10_cost_sensitivity", lambda f: backtest.cost_sensitivity(f.traded, COSTS, 0.5), f"SELECT cost_scenario, strategy, {_PERF}, {r('commission_per_trade + bid_ask_spread_proxy + slippage AS total_cost_per_unit', 'commission_per_trade', 'bid_ask_spread_proxy', 'slippage', 'gross_pnl - net_pnl AS cost_drag', 'gross_pnl - net_pnl AS gross_to_net_pnl_delta', digits=5)} FROM c_cost_perf JOIN c_costs USING (cost_scenario)", 5)
register("bt11_relabelled_events", lambda f: backtest.relabel(f.traded, GRID).select("event_id", "entry_threshold", "exit_threshold", "stop_loss_level", "max_holding_period", "label", "scenario_exit_reason"), f"SELECT event_id, {RULE}, new_label AS label, scenario_exit_reason FROM c_ruled")
_RULE_PERF = f"coalesce(trade_count, 0) AS trade_count, {r(*(f'coalesce({c}, 0) AS {c}' if c in ('gross_pnl', 'net_pnl', 'turnover', 'max_drawdown') else c for c in PERFORMANCE), digits=5)}"
_ALL_RULES = f"SELECT a.strategy, {', '.join('a.' + c.strip() + ' AS ' + c.strip() for c in RULE.split(','))}, p.* EXCLUDE (strategy, {RULE}) FROM (SELECT DISTINCT {RULE}, strategy FROM c_ruled, (SELECT unnest(['baseline_rule_based', 'ml_filtered', 'ml_probability_sized']) AS strategy)) a LEFT JOIN c_rule_perf p USING ({RULE}, strategy)"
register("bt12_threshold_sensitivity", lambda f: backtest.threshold_sensitivity(f.traded, GRID, 0.5, 0.05), f"SELECT strategy, {RULE}, 0.5::DOUBLE AS probability_threshold, 0.05::DOUBLE AS transaction_cost, {_RULE_PERF} FROM ({_ALL_RULES})", 5)

# Portfolio
register("pf1_equity_curve", lambda f: portfolio.equity_curve(f.trades), f"SELECT strategy, date, {r('daily_pnl', 'equity', 'running_peak', 'drawdown')} FROM c_equity")
register("pf3_strategy_performance", lambda f: portfolio.performance(f.trades), f"SELECT strategy, {_PERF} FROM c_perf", 5)
register("pf4_calendar_sharpe", lambda f: portfolio.calendar_sharpe(f.trades, ["strategy"]), f"SELECT strategy, {r('sharpe')} FROM c_perf")
register("pf6_shared_leg_clusters", lambda f: _clusters(f), "SELECT 0 AS cluster_id, string_agg(triplet_id, ';' ORDER BY triplet_id) AS triplets, count(*) AS cluster_size, (SELECT string_agg(DISTINCT s, ';' ORDER BY s) FROM (SELECT unnest([hedge_symbol_1, hedge_symbol_2]) AS s FROM c_triplets)) AS shared_legs, false AS independent_bet FROM c_triplets UNION ALL SELECT 1, 'X_P_Q', 1, '', true")
_P = "successes / n"
register("pf7_wilson_intervals", lambda f: portfolio.wilson_intervals(f.trades), f"SELECT strategy, successes, n, 0.9::DOUBLE AS confidence, {r(f'{_P} AS rate', f'greatest(0, ({_P} + z * z / (2 * n) - z * sqrt(({_P} * (1 - {_P}) + z * z / (4 * n)) / n)) / (1 + z * z / n)) AS ci_low', f'least(1, ({_P} + z * z / (2 * n) + z * sqrt(({_P} * (1 - {_P}) + z * z / (4 * n)) / n)) / (1 + z * z / n)) AS ci_high')} FROM (SELECT strategy, count(CASE WHEN net_pnl > 0 THEN 1 END) AS successes, count(*) AS n, 1.6448536269514722::DOUBLE AS z FROM c_trades GROUP BY strategy)")
part("c_draws", "SELECT strategy, n, i, floor((CAST('0x' || substr(md5('0|' || q || '|' || (i // 4)), (i % 4 * 8 + 1)::INTEGER, 8) AS BIGINT)) / 4294967296.0 * n)::BIGINT AS place, q FROM (SELECT strategy, n, q, unnest(range(n)) AS i FROM (SELECT strategy, count(*) AS n FROM c_trades GROUP BY strategy HAVING count(*) > 1), (SELECT unnest(range(2000)) AS q))")
part("c_placed_trades", "SELECT strategy, net_pnl, row_number() OVER (PARTITION BY strategy ORDER BY pnl_date, event_id) - 1 AS place FROM c_trades")
part("c_mean_intervals", "SELECT strategy, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM (SELECT d.strategy, d.q, avg(t.net_pnl) AS m FROM c_draws d JOIN c_placed_trades t USING (strategy, place) GROUP BY d.strategy, d.q) GROUP BY strategy")
part("c_means", "SELECT strategy, avg(net_pnl) AS estimate, count(*) AS n FROM c_trades GROUP BY strategy")
part("c_days", "SELECT strategy, daily_pnl AS x, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS place, count(*) OVER (PARTITION BY strategy) AS n FROM c_equity")
part("c_block_draws", "SELECT strategy, n, q, i, floor((CAST('0x' || substr(md5('0|' || q || '|' || (i // 4)), (i % 4 * 8 + 1)::INTEGER, 8) AS BIGINT)) / 4294967296.0 * (n - 19))::BIGINT AS place FROM (SELECT strategy, n, q, unnest(range(ceil(n / 20)::BIGINT)) AS i FROM (SELECT DISTINCT strategy, n FROM c_days WHERE n >= 20), (SELECT unnest(range(1000)) AS q))")
part("c_block_paths", "SELECT b.strategy, b.q, b.i * 20 + k AS t, d.x FROM c_block_draws b JOIN (SELECT unnest(range(20)) AS k) ON b.i * 20 + k < b.n JOIN c_days d ON d.strategy = b.strategy AND d.place = b.place + k UNION ALL SELECT strategy, -1, place, x FROM c_days")
part("c_block_equity", "SELECT strategy, q, t, sum(x) OVER (PARTITION BY strategy, q ORDER BY t) AS e FROM c_block_paths")
part("c_block_falls", "SELECT strategy, q, min(e - peak) AS v FROM (SELECT *, max(e) OVER (PARTITION BY strategy, q ORDER BY t) AS peak FROM c_block_equity) GROUP BY strategy, q")
register("pf8_bootstrap_intervals", lambda f: portfolio.bootstrap_interval(f.trades, "mean_pnl"), f"SELECT strategy, 'mean_pnl' AS metric, {r('estimate', 'low AS ci_low', 'high AS ci_high')}, n FROM c_means LEFT JOIN c_mean_intervals USING (strategy)")
part("c_fall_intervals", "SELECT strategy, max(CASE WHEN q = -1 THEN v END) AS estimate, quantile_cont(CASE WHEN q >= 0 THEN v END, 0.05) AS low, quantile_cont(CASE WHEN q >= 0 THEN v END, 0.95) AS high FROM c_block_falls GROUP BY strategy")
register("pf9_block_bootstrap_intervals", lambda f: portfolio.block_bootstrap_interval(portfolio.equity_curve(f.trades)), f"SELECT strategy, 'max_drawdown' AS metric, round(estimate, 6) + 0.0 AS estimate, round(low, 6) + 0.0 AS ci_low, round(high, 6) + 0.0 AS ci_high, n FROM c_fall_intervals JOIN (SELECT strategy, count(*) AS n FROM c_days GROUP BY strategy) USING (strategy)")
_DAYS = "(SELECT strategy, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (SELECT DISTINCT strategy FROM c_trades), (SELECT min(pnl_date) AS lo, max(pnl_date) AS hi FROM c_trades))"
register("pf2_calendar_pnl", lambda f: portfolio.calendar_pnl(f.trades), f"SELECT strategy, CAST(CAST(d AS DATE) AS VARCHAR) AS day, {r('coalesce(p, 0) AS daily_pnl')} FROM {_DAYS} LEFT JOIN (SELECT strategy, pnl_date AS d, sum(net_pnl) AS p FROM c_trades GROUP BY ALL) USING (strategy, d) WHERE isodow(d) < 6".replace("AS day", "AS date"))
_WILSON = SQL["pf7_wilson_intervals"].rsplit("\nSELECT", 1)[1]
register("pf16_confidence_table", lambda f: portfolio.confidence_table(f.trades), f"SELECT strategy, 'win_rate' AS metric, 'wilson_score' AS method, rate AS point_estimate, ci_low, ci_high, confidence, n AS n_trades FROM (SELECT{_WILSON}) UNION ALL SELECT strategy, 'mean_pnl', 'percentile_bootstrap', {r('estimate')}, {r('low')}, {r('high')}, 0.9::DOUBLE, n FROM c_means LEFT JOIN c_mean_intervals USING (strategy)")
_U = "(CAST('0x' || substr(md5(event_id || '|{k}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
register("pf17_placeholder_predictions", lambda f: models.placeholder_predictions(f.labels), f"SELECT event_id, triplet_id, method, event_date, 'placeholder' AS split, {r('p AS predicted_reversion_probability')}, 0.6::DOUBLE AS classification_threshold, CAST(p >= 0.6 AS INTEGER) AS predicted_label, label FROM (SELECT *, least(0.95, greatest(0.05, 0.38 + 0.32 * label + 0.16 * sqrt(-2 * ln({_U.format(k=0)})) * cos(2 * pi() * {_U.format(k=1)}))) AS p FROM c_labels)")
register("pf10_volatility_targeting", lambda f: _targeted(f), f"SELECT event_id, strategy, {r('size AS position_size', 'size * spread_pnl_units AS gross_pnl', 'size * spread_pnl_units - 0.05 * size AS net_pnl', '2 * size AS turnover')} FROM (SELECT t.event_id, t.strategy, t.spread_pnl_units, least(3.0, greatest(0.0, 0.02 / greatest(m.residual_volatility, 1e-6))) AS size FROM c_trades t JOIN c_matrix m USING (event_id) WHERE m.residual_volatility IS NOT NULL)")
register("pf11_buy_and_hold", lambda f: portfolio.buy_and_hold(f.panel, "vwap").select("date", "daily_return", F.log1p("cumulative_return").alias("log_growth")), f"SELECT date, {r('d AS daily_return', 'sum(ln(1 + d)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS log_growth', digits=5)} FROM (SELECT date, avg(simple_return) AS d FROM c_market WHERE simple_return IS NOT NULL GROUP BY date)", 5)
_ROBUST = r("avg(net_pnl) AS average_net_pnl", "quantile_cont(net_pnl, 0.5) AS median_net_pnl", "min(net_pnl) AS worst_net_pnl", "max(net_pnl) AS best_net_pnl", "avg(CAST(net_pnl > 0 AS INTEGER)) AS profitable_scenario_rate", "avg(sharpe) AS average_sharpe", "min(max_drawdown) AS worst_drawdown", "avg(turnover) AS average_turnover", digits=5)
register("pf12_robustness_summary", lambda f: metrics.robustness_summary(backtest.threshold_sensitivity(f.traded, GRID, 0.5, 0.05), backtest.cost_sensitivity(f.traded, COSTS, 0.5)), f"SELECT t.*, c.* EXCLUDE (strategy) FROM (SELECT strategy, count(*) AS threshold_scenarios, {_ROBUST}, min(trade_count) AS minimum_trade_count, max(trade_count) AS maximum_trade_count FROM c_rule_perf GROUP BY strategy) t JOIN (SELECT strategy, count(DISTINCT cost_scenario) AS cost_scenarios, {r('min(net_pnl) AS worst_cost_adjusted_net_pnl', 'avg(gross_pnl - net_pnl) AS average_cost_drag', 'max(gross_pnl - net_pnl) AS maximum_cost_drag', digits=5)} FROM c_cost_perf GROUP BY strategy) c USING (strategy)", 5)
register("pf13_cost_drag", lambda f: metrics.cost_drag(backtest.cost_sensitivity(f.traded, COSTS, 0.5)), f"SELECT cost_scenario, strategy, trade_count, {r('gross_pnl', 'net_pnl', 'gross_pnl - net_pnl AS cost_drag', '(gross_pnl - net_pnl) / nullif(abs(gross_pnl), 0) AS cost_drag_ratio', digits=5)} FROM c_cost_perf", 5)
register("pf14_threshold_pivot", lambda f: metrics.threshold_pivot(backtest.threshold_sensitivity(f.traded, GRID, 0.5, 0.05), list(GRID.exit_thresholds)), f"SELECT strategy, entry_threshold, {r('avg(CASE WHEN exit_threshold = 0.25 THEN net_pnl END) AS exit_0_25', 'avg(CASE WHEN exit_threshold = 0.5 THEN net_pnl END) AS exit_0_5', 'avg(CASE WHEN exit_threshold = 0.75 THEN net_pnl END) AS exit_0_75', digits=5)} FROM c_rule_perf GROUP BY strategy, entry_threshold", 5)
register("pf15_cost_adjusted_performance", lambda f: metrics.cost_adjusted_performance(backtest.cost_sensitivity(f.traded, COSTS, 0.5)), f"SELECT cost_scenario, strategy, trade_count, {r('gross_pnl', 'net_pnl', 'win_rate', 'max_drawdown', 'sharpe', 'gross_pnl - net_pnl AS cost_drag', '(gross_pnl - net_pnl) / nullif(abs(gross_pnl), 0) AS cost_drag_ratio', 'net_pnl / nullif(gross_pnl, 0) AS net_to_gross_ratio', digits=5)} FROM c_cost_perf", 5)


def _clusters(f: Frames) -> DataFrame:
    got = portfolio.shared_leg_clusters(f.triplets.select("triplet_id").union(f.spark.sql("SELECT 'X_P_Q'")))
    return got.withColumns({c: F.array_join(c, ";") for c in ("triplets", "shared_legs")})


def _targeted(f: Frames) -> DataFrame:
    vol = f.matrix.select("event_id", "residual_volatility").where("residual_volatility is not null")
    return portfolio.apply_volatility_targeting(f.trades.join(vol, "event_id"), "residual_volatility").select("event_id", "strategy", "position_size", "gross_pnl", "net_pnl", "turnover")


# Sequential models
_NOISE = "1e-5::DOUBLE AS process_noise, 1e-4::DOUBLE AS measurement_noise, NULL::INTEGER AS initial_window"
_KEYS = "triplet_id, target_symbol, hedge_symbol_1, hedge_symbol_2, date, method"
register("kf3_kalman_states", lambda f: kalman.states_and_residuals(kalman.kalman_regression(f.obs))[0], f"SELECT {_KEYS}, {r(*kalman.NUMBERS[:6], *kalman.NUMBERS[10:])}, {_NOISE} FROM c_filtered")
register("kf4_kalman_residuals", lambda f: kalman.states_and_residuals(kalman.kalman_regression(f.obs))[1], f"SELECT {_KEYS}, {r(*kalman.NUMBERS[6:10])}, {_NOISE} FROM c_filtered")
register("kf5_kalman_vs_rolling", lambda f: kalman.compare_with_rolling(kalman.kalman_regression(f.obs), f.residuals).drop("static_residual_std", "static_abs_mean", "std_ratio_vs_static", "abs_mean_ratio_vs_static"), f"SELECT triplet_id, method, n_obs, {r(*SUMMARY)} FROM c_both_summary")
register("st3_adf_p_values", lambda f: f.spark.sql("SELECT explode(array(-6.0D, -3.43D, -3.0D, -2.86D, -2.6D, -2.57D, -1.0D, 0.0D, 2.0D)) AS tau").select("tau", x.adf_p_value("tau").alias("p")), f"SELECT tau::DOUBLE AS tau, {r('CASE WHEN tau <= -3.43 THEN greatest(0.001, 0.01 + (tau + 3.43) * 0.04 / 0.57) WHEN tau <= -2.86 THEN 0.01 + (tau + 3.43) * 0.04 / 0.57 WHEN tau <= -2.57 THEN 0.05 + (tau + 2.86) * 0.05 / 0.29 ELSE least(0.995, 0.05 + (tau + 2.86) * 0.05 / 0.29) END AS p')} FROM (SELECT unnest([-6.0, -3.43, -3.0, -2.86, -2.6, -2.57, -1.0, 0.0, 2.0]::DOUBLE[]) AS tau)")
register("st4_benjamini_hochberg", lambda f: stationarity.benjamini_hochberg(f.predictions.select("event_id", (1 - F.col(models.P)).alias("p")), "p", 0.3).select("event_id", "fdr_reject"), "SELECT event_id, coalesce(1 - predicted_reversion_probability <= (SELECT max(p) FROM (SELECT 1 - predicted_reversion_probability AS p, row_number() OVER (ORDER BY 1 - predicted_reversion_probability) AS k, count(*) OVER () AS n FROM c_preds) WHERE p <= k * 0.3 / n), false) AS fdr_reject FROM c_preds")
_W = stationarity.fractional_weights(0.4)
register("st7_fractional_weights", lambda f: f.spark.createDataFrame(list(enumerate(stationarity.fractional_weights(0.5, 1e-3))), "k int, w double"), f"SELECT k, {r('w')} FROM (WITH RECURSIVE g(k, w) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT k + 1, -w * (0.5 - k) / (k + 1) FROM g WHERE k < 1000 AND abs(-w * (0.5 - k) / (k + 1)) >= 1e-3) SELECT * FROM g)")
register("st8_fractional_diff", lambda f: stationarity.fractional_diff(f.clean.where("quality_flag = 'clean'").select("symbol", "date", F.ln("adj_close").alias("log_price")), 0.4, block=1024).select("symbol", "date", "fractional_diff"),
         f"SELECT symbol, date, round(CASE WHEN len(w) = {len(_W)} THEN list_inner_product(w, {_W[::-1]!r}) END, 6) + 0.0 AS fractional_diff FROM (SELECT symbol, date, list(ln(adj_close)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {len(_W) - 1} PRECEDING AND CURRENT ROW) AS w FROM c_clean WHERE quality_flag = 'clean')")
register("st10_null_hypothesis_check", lambda f: stationarity.null_hypothesis_check(f.spark))
register("hm4_regime_parameters", lambda f: regimes.regime_parameters(f.scored))
_PROBABILITIES = [*(f"state_{i}_probability" for i in range(3)), *(f"{n}_probability" for n in regimes.REGIMES)]
register("hm8_regime_probabilities", lambda f: regimes.regime_probabilities(f.scored, model=REGIME), f"SELECT triplet_id, method, date, {r('feature_value', *_PROBABILITIES, 'log_likelihood')}, most_likely_state, most_likely_regime, viterbi_state, viterbi_regime FROM c_regimes")
register("hm8_fitted_regimes", lambda f: regimes.regime_probabilities(f.scored))
register("hm9_regimes_by_triplet", lambda f: regimes.regime_probabilities(f.scored, by=["triplet_id"]).groupBy("triplet_id", "viterbi_regime").count())
register("hm11_regime_filter", lambda f: _filtered(f).select("event_id", "mean_reverting_probability", "most_likely_regime", "viterbi_regime", "allowed_by_regime_filter"),
         f"SELECT event_id, {r('mean_reverting_probability')}, most_likely_regime, viterbi_regime, coalesce(mean_reverting_probability > {EVENT_REGIME}, false) AS allowed_by_regime_filter FROM c_events e LEFT JOIN c_regimes g ON g.triplet_id = e.triplet_id AND g.method = e.method AND g.date = e.event_date")
register("hm12_performance_by_regime", lambda f: regimes.performance_by_regime(f.trades.join(_filtered(f).select("event_id", "mean_reverting_probability"), "event_id"), EVENT_REGIME),
         f"SELECT strategy, CASE WHEN coalesce(p > {EVENT_REGIME}, false) THEN 'above_threshold' ELSE 'below_threshold' END AS regime_bucket, count(*) AS trade_count, {r('avg(p) AS average_mean_reverting_probability', 'sum(label) / count(label) AS success_rate', 'sum(net_pnl) AS net_pnl', 'avg(net_pnl) AS average_net_pnl', 'sum(turnover) AS turnover', digits=5)}, {EVENT_REGIME}::DOUBLE AS regime_probability_threshold FROM (SELECT t.*, g.mean_reverting_probability AS p FROM c_trades t JOIN c_events e USING (event_id) LEFT JOIN c_regimes g ON g.triplet_id = e.triplet_id AND g.method = e.method AND g.date = e.event_date) GROUP BY 1, 2", 5)


def _filtered(f: Frames) -> DataFrame:
    """Events beside the regimes of their day."""
    return regimes.trade_filter(f.events, regimes.regime_probabilities(f.scored_table, model=REGIME), EVENT_REGIME)
