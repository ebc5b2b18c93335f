"""Unit-root tests with control of false discoveries, and fractional differencing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.functions.expressions import adf_p_value, correlation, null_if_nan
from tercet.guards import require
from tercet.operators.linear import TINY, square
from tercet.operators.ordered import running
from tercet.sources.stages import stored

GROUP = ["triplet_id", "method"]
# Critical values with a constant.
CRITICAL = {"critical_value_1pct": -3.43, "critical_value_5pct": -2.86, "critical_value_10pct": -2.57}


def adf_by_group(df: DataFrame, value: str = "residual", by: list[str] | None = None, order: str = "date", max_lag: int | None = None) -> DataFrame:
    """by columns, adf_statistic, adf_p_value, lag_used, n_obs, critical values; groups too short to test are left out.

    One sort makes the lags, one aggregation the cross products of differences at all lags, the level and the difference; one
    elimination of the lags, in order, gives all nested models: after lag k is out, what is left of level and difference holds both
    the residual sum and tau of the model with k lags.  All lags use the rows that the largest leaves; the first of least AIC wins.
    Groups need 20 finite values.  A level that the lags explain wholly has no tau (p-value 1).
    """
    named = by or GROUP
    by = [f"__by_{c}" for c in named]  # no name of a group's columns can clash with those in between
    path = Window.partitionBy(*by).orderBy("o")
    v = df.select(*(F.col(c).alias(b) for c, b in zip(named, by, strict=True)), F.col(order).alias("o"), F.col(value).cast("double").alias("v")).where(null_if_nan("v").isNotNull())
    v = v.select(*by, "o", F.lag("v").over(path).alias("level"), (F.col("v") - F.lag("v").over(path)).alias("d"), F.row_number().over(path).alias("rn"), F.count("*").over(Window.partitionBy(*by)).alias("total")).where("total >= 20")
    ceiling = F.floor(12 * F.pow(F.col("total") / 100.0, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    v = stored(v.withColumn("top", F.greatest(F.lit(0), F.least(ceiling, F.col("total") - 4)).cast("int")))
    most = v.agg(F.max("top")).first()[0] or 0
    shift = F.avg("level").over(Window.partitionBy(*by))
    z = v.select(*by, "rn", "top", *(F.coalesce(F.lag("d", i + 1).over(path), F.lit(0.0)).alias(f"z{i}") for i in range(most)), (F.col("level") - shift).alias(f"z{most}"), F.col("d").alias(f"z{most + 1}"))
    used, m = z.where(F.col("rn") >= F.col("top") + 2), most + 2
    cell = lambda i, j: f"sum(z{i} * z{j}) - sum(z{i}) * sum(z{j}) / count(*)"
    sums = used.groupBy(*by, "top").agg(F.count("*").alias("n_obs"), F.expr(square(m, cell)).alias("c"))
    pivot, level, diff = "s.m[i - 1][i - 1]", most, most + 1
    block = lambda m: f"named_struct('ll', {m}[{level}][{level}], 'ly', {m}[{level}][{diff}], 'yy', {m}[{diff}][{diff}])"
    without = f"IF({pivot} > {TINY}D * c[i - 1][i - 1], transform(s.m, row -> zip_with(row, s.m[i - 1], (a, b) -> a - row[i - 1] * b / {pivot})), s.m)"
    steps = "IF(top = 0, cast(array() AS array<int>), sequence(1, top))"
    seen = f"concat(s.out, array({block('s.m')}))"  # a model's block is noted before the next lag goes
    none = "cast(array() AS array<struct<ll: double, ly: double, yy: double>>)"
    states = f"aggregate({steps}, named_struct('m', c, 'out', {none}), (s, i) -> named_struct('m', {without}, 'out', {seen}), s -> {seen})"
    tiny = f"{TINY}D * c[{level}][{level}]"
    rss = f"(x.yy - IF(x.ll > {tiny}, x.ly * x.ly / x.ll, 0D))"
    aic = f"IF({rss} > 0 AND n_obs > k + 2, n_obs * ln({rss} / n_obs) + 2 * (k + 2), NULL)"
    got = sums.withColumn("states", F.expr(states)).withColumn("aic", F.expr(f"transform(states, (x, k) -> {aic})"))
    got = got.withColumn("lag_used", F.expr("coalesce(array_position(aic, array_min(aic)) - 1, 0L)").cast("int"))
    got = got.withColumn("x", F.expr("states[lag_used]")).withColumn("dof", F.expr("n_obs - lag_used - 2")).where("dof > 0")
    se = f"sqrt({rss} / dof / x.ll)"
    got = got.select(*(F.col(b).alias(c) for c, b in zip(named, by, strict=True)), F.expr(f"IF(x.ll > {tiny} AND {rss} > 0, x.ly / x.ll / {se}, NULL)").alias("adf_statistic"), "lag_used", F.col("n_obs").cast("int").alias("n_obs"))
    p = F.when(F.col("adf_statistic").isNull(), F.lit(1.0)).otherwise(adf_p_value("adf_statistic"))
    return got.withColumn("adf_p_value", p).withColumns({k: F.lit(v) for k, v in CRITICAL.items()})


def benjamini_hochberg(df: DataFrame, p: str = "adf_p_value", alpha: float = 0.05, out: str = "fdr_reject") -> DataFrame:
    """`df` with `out`: rejected are p-values up to the largest whose rank k has p <= k * alpha / n.

    p-values are counted by value, and ranked in ranges, so ties and many rows stay cheap.
    """
    require(0 < alpha < 1, "alpha must be between 0 and 1")
    per = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__k"))
    ranked = running(per, [], ["__p"], {"__r": F.col("__k")}, {"__n": "__r"})
    limit = ranked.where(F.col("__p") <= F.col("__r") * alpha / F.col("__n")).agg(F.max("__p").alias("__limit"))
    return df.crossJoin(F.broadcast(limit)).withColumn(out, F.coalesce(F.col(p) <= F.col("__limit"), F.lit(False))).drop("__limit")  # one row


def cointegration_report(residuals: DataFrame, value: str = "residual", alpha: float = 0.05) -> DataFrame:
    """adf_by_group() with fdr_reject over all groups."""
    return benjamini_hochberg(adf_by_group(residuals, value), alpha=alpha)


def cointegration_gate(residuals: DataFrame, report: DataFrame) -> DataFrame:
    """All methods of the triplets for which some method rejects."""
    return residuals.join(report.where("fdr_reject").select("triplet_id").distinct(), "triplet_id", "left_semi")


def fractional_weights(d: float, threshold: float = 1e-5, max_size: int = 10_000) -> list[float]:
    """w_0 = 1, w_k = -w_{k-1} (d - k + 1) / k, up to the first below `threshold` in size."""
    require(d >= 0, "d must not be negative")
    w = [1.0]
    while len(w) < max_size:
        nxt = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(nxt) < threshold:
            break
        w.append(nxt)
    return w


def filtered(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of w[k] * x[t - k]; NaN for the first rows and where one of them is not finite.  Long filters go by Fourier transforms."""
    n, m, whole = len(x), len(w), np.isfinite(x)
    if n < m:
        return np.full(n, np.nan)
    level = np.where(whole, x, 0.0)
    if m <= 64:
        y = np.convolve(level, w)[:n]
    else:
        size = 1 << (n + m - 2).bit_length()
        y = np.fft.irfft(np.fft.rfft(level, size) * np.fft.rfft(w, size), size)[:n]
    held = np.concatenate([[0], np.cumsum(whole)])
    y[: m - 1] = np.nan
    y[m - 1 :][held[m:] - held[:-m] < m] = np.nan
    return y


def _by_block(w: np.ndarray):
    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([filtered(np.asarray(x, float), w) for x in xs])

    return run


def fractional_diffs(df: DataFrame, ds: dict[str, float], value: str = "log_price", by: str = "symbol", order: str = "date", threshold: float = 1e-5, max_size: int = 10_000, block: int = 4096) -> DataFrame:
    """`df` with a column for each d of `ds`: the weighted sum of a value and those before it; null for the first rows and beside
    values that are not finite.

    A series is filtered in blocks of `block` rows (or as many as there are weights), each after the rows before it that its first
    weights reach, so that a row is in two blocks at most, and a series may be of any length.  All d are one pass.
    """
    weights = {out: np.array(fractional_weights(d, threshold, max_size)) for out, d in ds.items()}
    reach = max(len(w) for w in weights.values()) - 1
    size = max(block, reach)
    rows = running(df, [by], [order], {"__rank": F.lit(1)})
    at, own = F.col("__rank") - 1, F.floor((F.col("__rank") - 1) / size)
    blocks = F.when(at % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.withColumn("__block", F.explode(blocks))
    kept = F.when(F.col("__block") == own, F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    row = F.struct("__rank", F.col(value).cast("double").alias("__x"), kept.alias("__row"))
    packed = spread.groupBy(by, "__block").agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    made = packed.select(F.col("__rows.__row").alias("__row"), *(_by_block(w)(F.col("__rows.__x")).alias(out) for out, w in weights.items()))
    each = made.select(F.explode(F.arrays_zip("__row", *weights)).alias("__at")).where("__at.__row IS NOT NULL")
    return each.select(*(F.col(f"__at.__row.`{c}`") for c in df.columns), *(null_if_nan(f"__at.`{out}`").alias(out) for out in weights))


def fractional_diff(df: DataFrame, d: float, value: str = "log_price", by: str = "symbol", order: str = "date", threshold: float = 1e-5, max_size: int = 10_000, out: str = "fractional_diff", block: int = 4096) -> DataFrame:
    """fractional_diffs() of one d."""
    return fractional_diffs(df, {out: d}, value, by, order, threshold, max_size, block)


def minimum_stationary_d(df: DataFrame, grid: tuple[float, ...] = tuple(k / 10 for k in range(11)), significance: float = 0.05, value: str = "log_price", by: str = "symbol", order: str = "date", threshold: float = 1e-5) -> DataFrame:
    """by, d, adf_p_value, correlation_with_level of the least d whose series passes the ADF test; null d if none does."""
    ds = {f"__d{k}": float(d) for k, d in enumerate(sorted(grid))}  # one pass; the test runs once, over all of them
    wide = fractional_diffs(df.select(by, order, value), ds, value, by, order, threshold)
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(c).alias("y")) for c, d in ds.items()))).alias("tried")
    tried = stored(wide.select(by, order, value, each).select(by, order, value, "tried.*").where("y IS NOT NULL"))
    corr = tried.groupBy(by, "d").agg(correlation(F.col(value), F.col("y")).alias("correlation_with_level"))
    tests = adf_by_group(tried, "y", [by, "d"], order).where("adf_statistic IS NOT NULL").join(corr, [by, "d"])
    first = tests.where(F.col("adf_p_value") <= significance).groupBy(by).agg(F.min_by(F.struct("d", "adf_p_value", "correlation_with_level"), "d").alias("x"))
    return df.select(by).distinct().join(first, by, "left").select(by, "x.d", "x.adf_p_value", "x.correlation_with_level")


def random_walks(spark: SparkSession, n_seeds: int = 30, n_days: int = 2000, start: str = "2000-01-03") -> DataFrame:
    """KEYS, date, y, x1, x2: three independent random walks for each seed, made where they are used."""
    from tercet.operators.hedges import KEYS

    def run(batches):
        for pdf in batches:
            for s in pdf["id"].tolist():
                walk = 4.0 + np.cumsum(np.random.default_rng(int(s)).normal(0, 0.01, (n_days, 3)), 0)
                dates = pd.bdate_range(start, periods=n_days).date
                yield pd.DataFrame({"triplet_id": f"seed_{s:04d}", "target_symbol": "A", "hedge_symbol_1": "B", "hedge_symbol_2": "C", "date": dates, "y": walk[:, 0], "x1": walk[:, 1], "x2": walk[:, 2]})

    return spark.range(n_seeds).mapInPandas(run, ", ".join(f"{k} string" for k in KEYS) + ", date date, y double, x1 double, x2 double")


def null_hypothesis_check(spark: SparkSession, n_seeds: int = 30, n_days: int = 2000, window: int = 60) -> DataFrame:
    """triplet_id, n_events, success_count, failure_count, success_rate of walks without any relation."""
    from tercet.operators import events, hedges, residuals

    obs = random_walks(spark, n_seeds, n_days)
    scored = residuals.z_score(hedges.dynamic_residuals(obs, window).where("method = 'rolling_ols'"), window)
    found = events.candidate_events(scored)
    return events.label_summary(events.label_events(scored, found), ["triplet_id"])
