"""Hedge ratios: static, rolling and ridge regressions of a target on two hedges.

Windows hold sufficient statistics (averages, variances, covariances), from running sums; two-variable systems are solved
in expressions, so one shuffle on triplet_id serves all methods.  Frames end before the current row: nothing looks ahead.
Where the two hedges are exactly collinear in a window the coefficients are null; the grouped back end gives the
least-norm solution there.
"""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tercet.functions.expressions import null_if_nan, over
from tercet.guards import require, require_columns
from tercet.sources.stages import dealt

KEYS = ["triplet_id", "target_symbol", "hedge_symbol_1", "hedge_symbol_2"]
RESIDUALS = [*KEYS, "date", "method", "actual_log_price", "fitted_log_price", "residual", "window", "ridge_alpha"]


def moments(y: Column, x1: Column, x2: Column, w: WindowSpec | None = None) -> dict[str, Column]:
    """Averages, population variances and covariances, as aggregates or over a window."""
    on = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    out = {"n": on(F.count(y)), "my": on(F.avg(y)), "m1": on(F.avg(x1)), "m2": on(F.avg(x2)), "vy": on(F.var_pop(y)), "v1": on(F.var_pop(x1)), "v2": on(F.var_pop(x2))}
    return out | {"c12": on(F.covar_pop(x1, x2)), "c1y": on(F.covar_pop(x1, y)), "c2y": on(F.covar_pop(x2, y))}


def solve(alpha: Column | float = 0.0, prefix: str = "") -> dict[str, Column]:
    """alpha, beta_1, beta_2 and r_squared from columns of moments; `alpha` is the ridge penalty (0: least squares).

    Hedges count as collinear, and coefficients are null, where the determinant is within rounding of zero.
    """
    c = lambda k: F.col(prefix + k)
    lam = (F.lit(alpha) if not isinstance(alpha, Column) else alpha) / c("n")
    s1, s2 = c("v1") + lam, c("v2") + lam
    det = s1 * s2 - c("c12") * c("c12")
    det = F.when(det > 1e-11 * s1 * s2, det)
    b1, b2 = (c("c1y") * s2 - c("c2y") * c("c12")) / det, (c("c2y") * s1 - c("c1y") * c("c12")) / det
    rss = c("vy") - 2 * (b1 * c("c1y") + b2 * c("c2y")) + b1 * b1 * c("v1") + b2 * b2 * c("v2") + 2 * b1 * b2 * c("c12")
    return {"alpha": c("my") - b1 * c("m1") - b2 * c("m2"), "beta_1": b1, "beta_2": b2, "r_squared": F.when(c("vy") == 0, F.lit(0.0)).otherwise(1 - over(rss, c("vy")))}


def trailing_moments(rows: DataFrame, window: int, by: str, order: str) -> DataFrame:
    """`rows` (with y, x1, x2) with rn, n and the moments() of those of the `window` rows before each that are complete.

    Moments are differences of running sums, so a row costs the same whatever the window; values are centred on their
    group's first complete row, and variances within rounding of zero are zero.  Missing, NaN and infinite values count
    as missing.  Nothing comes from later rows, not even rounding.
    """
    legs, path = ("y", "x1", "x2"), Window.partitionBy(by).orderBy(order)
    running = path.rowsBetween(Window.unboundedPreceding, 0)
    whole = reduce(lambda a, b: a & b, (null_if_nan(k).isNotNull() for k in legs))
    got = rows.select("*", F.row_number().over(path).alias("rn"), *(F.first(F.when(whole, F.col(k)), ignorenulls=True).over(running).alias(f"__m{k}") for k in legs))
    d = {k: F.when(whole, F.col(k) - F.col(f"__m{k}")).otherwise(0.0) for k in legs}
    terms = {"n": F.when(whole, 1).otherwise(0)} | d | {"yy": d["y"] * d["y"], "11": d["x1"] * d["x1"], "22": d["x2"] * d["x2"], "12": d["x1"] * d["x2"], "1y": d["x1"] * d["y"], "2y": d["x2"] * d["y"]}
    got = got.withColumn("__s", F.struct(*(F.sum(t).over(running).alias(k) for k, t in terms.items())))
    got = got.withColumn("__a", F.lag("__s", 1).over(path)).withColumn("__b", F.lag("__s", window + 1).over(path))
    n = F.coalesce(F.col("__a.n"), F.lit(0)) - F.coalesce(F.col("__b.n"), F.lit(0))
    got = got.select(*rows.columns, "rn", *(f"__m{k}" for k in legs), *((F.col(f"__a.{q}") / F.col("__a.n")).alias(f"__v{k}") for k, q in zip(legs, ("yy", "11", "22"), strict=True)), n.alias("n"), F.nullif(n, F.lit(0)).alias("__n"), *((F.coalesce(F.col(f"__a.{k}"), F.lit(0.0)) - F.coalesce(F.col(f"__b.{k}"), F.lit(0.0))).alias(f"__{k}") for k in terms if k != "n"))
    mean = {k: F.col(f"__{k}") / F.col("__n") for k in legs}
    var = lambda k, q: F.col(q) / F.col("__n") - mean[k] * mean[k]
    some = lambda k, v: F.when(v > 1e-13 * F.col(f"__v{k}"), v).otherwise(F.lit(0.0))
    cov = lambda a, b, q: F.col(q) / F.col("__n") - mean[a] * mean[b]
    out = {"my": F.col("__my") + mean["y"], "m1": F.col("__mx1") + mean["x1"], "m2": F.col("__mx2") + mean["x2"], "vy": some("y", var("y", "__yy")), "v1": some("x1", var("x1", "__11")), "v2": some("x2", var("x2", "__22"))}
    out |= {"c12": cov("x1", "x2", "__12"), "c1y": cov("x1", "y", "__1y"), "c2y": cov("x2", "y", "__2y")}
    return got.select(*rows.columns, "rn", "n", *(v.alias(k) for k, v in out.items()))


def predict(alpha: str = "alpha", beta_1: str = "beta_1", beta_2: str = "beta_2") -> Column:
    """The fitted value of a row that has x1, x2 and coefficients."""
    return F.col(alpha) + F.col(beta_1) * F.col("x1") + F.col(beta_2) * F.col("x2")


def fit(obs: DataFrame, by: list[str], ridge_alpha: float = 0.0) -> DataFrame:
    """by columns, alpha, beta_1, beta_2, r_squared, n_obs of a regression over all rows of each group."""
    require_columns(obs, [*by, "y", "x1", "x2"])
    m = obs.groupBy(*by).agg(*(v.alias(k) for k, v in moments(F.col("y"), F.col("x1"), F.col("x2")).items()))
    return m.select(*by, *(v.alias(k) for k, v in solve(ridge_alpha).items()), F.col("n").alias("n_obs"))


def static_fit(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full-sample coefficients, and the in-sample residuals of every row."""
    coefficients = fit(obs, KEYS).withColumn("method", F.lit("static_ols"))
    joined = obs.join(coefficients.select("triplet_id", "alpha", "beta_1", "beta_2"), "triplet_id")
    return coefficients, _residuals(joined, "static_ols_full_sample", None, None)


def _residuals(df: DataFrame, method: str, window: int | None, ridge_alpha: float | None) -> DataFrame:
    return df.withColumn("fitted_log_price", predict()).select(
        *KEYS, "date", F.lit(method).alias("method"), F.col("y").alias("actual_log_price"), "fitted_log_price", (F.col("y") - F.col("fitted_log_price")).alias("residual"),
        F.lit(window).cast("int").alias("window"), F.lit(ridge_alpha).cast("double").alias("ridge_alpha"),
    )


def static_out_of_sample(obs: DataFrame, window: int) -> DataFrame:
    """Residuals of all rows after each triplet's first `window`, by the fit on those."""
    require(window > 2, "window must exceed the number of hedges")
    numbered = obs.withColumn("rn", F.row_number().over(Window.partitionBy("triplet_id").orderBy("date")))
    first = fit(numbered.where(F.col("rn") <= window), ["triplet_id"]).where(F.col("n_obs") == window).select("triplet_id", "alpha", "beta_1", "beta_2")
    return _residuals(numbered.where(F.col("rn") > window).join(first, "triplet_id"), "static_ols_initial_window", window, None)


def _rolled(obs: DataFrame, window: int) -> DataFrame:
    """Rows with the moments of the `window` rows before each; rows with fewer before them are left out."""
    require(window > 2, "window must be at least 3")
    path = Window.partitionBy("triplet_id").orderBy("date")
    rows = dealt(obs, "triplet_id").select(*KEYS, "date", "y", "x1", "x2", F.lag("date", window).over(path).alias("train_start"), F.lag("date", 1).over(path).alias("train_end"))
    return trailing_moments(rows, window, "triplet_id", "date").where(F.col("n") == window)


def _coefficients(rolled: DataFrame, method: str, window: int, ridge_alpha: float | None) -> DataFrame:
    s = solve(ridge_alpha or 0.0)
    extra = [] if ridge_alpha is None else [F.lit(ridge_alpha).alias("ridge_alpha")]
    return rolled.select(*KEYS, "date", "y", "x1", "x2", *(s[k].alias(k) for k in ("alpha", "beta_1", "beta_2")), "train_start", "train_end", F.lit(window).alias("window"), *extra, F.lit(method).alias("method"))


def rolling_ols(obs: DataFrame, window: int) -> DataFrame:
    """Coefficients for every row from the `window` complete rows strictly before it."""
    return _coefficients(_rolled(obs, window), "rolling_ols", window, None)


def rolling_ridge(obs: DataFrame, window: int, ridge_alpha: float = 1.0) -> DataFrame:
    """As rolling_ols(), with a penalty on the slopes (not on the intercept)."""
    require(ridge_alpha >= 0, "ridge_alpha must not be negative")
    return _coefficients(_rolled(obs, window), "rolling_ridge", window, ridge_alpha)


def rolling_both(obs: DataFrame, window: int, ridge_alpha: float = 1.0) -> DataFrame:
    """rolling_ols() and rolling_ridge(), one after another, from one window of moments."""
    require(ridge_alpha >= 0, "ridge_alpha must not be negative")
    rolled = _rolled(obs, window)
    both = (("rolling_ols", solve(0.0), None), ("rolling_ridge", solve(ridge_alpha), ridge_alpha))
    fits = (F.struct(*(s[k].alias(k) for k in ("alpha", "beta_1", "beta_2")), F.lit(a).cast("double").alias("ridge_alpha"), F.lit(m).alias("method")) for m, s, a in both)
    got = rolled.select(*KEYS, "date", "y", "x1", "x2", "train_start", "train_end", F.lit(window).alias("window"), F.explode(F.array(*fits)).alias("f"))
    return got.select(*KEYS, "date", "y", "x1", "x2", "f.alpha", "f.beta_1", "f.beta_2", "train_start", "train_end", "window", "f.ridge_alpha", "f.method")


def dynamic_residuals(obs: DataFrame, window: int, ridge_alpha: float = 1.0) -> DataFrame:
    """The residuals of all three methods: initial-window OLS, rolling OLS, rolling ridge.

    One shuffle and one sort by triplet: a row gets the moments of the rows before it and those of the triplet's first
    `window` rows, and is expanded to a row for each method that has its window.
    """
    require(window > 2, "window must be at least 3")
    require(ridge_alpha >= 0, "ridge_alpha must not be negative")
    legs = [F.col(c) for c in ("y", "x1", "x2")]
    rolled = trailing_moments(dealt(obs, "triplet_id").select(*KEYS, "date", "y", "x1", "x2"), window, "triplet_id", "date")
    first = moments(*(F.when(F.col("rn") <= window, c) for c in legs), Window.partitionBy("triplet_id"))
    rolled = rolled.select("*", *(v.alias(f"first_{k}") for k, v in first.items()))
    full = F.col("n") == window
    methods = (
        ("static_ols_initial_window", solve(0.0, "first_"), None, (F.col("first_n") == window) & (F.col("rn") > window)), ("rolling_ols", solve(0.0), None, full), ("rolling_ridge", solve(ridge_alpha), ridge_alpha, full),
    )
    fits = (F.when(has, F.struct(F.lit(m).alias("method"), (s["alpha"] + s["beta_1"] * legs[1] + s["beta_2"] * legs[2]).alias("fitted"), F.lit(a).cast("double").alias("ridge_alpha"))) for m, s, a, has in methods)
    got = rolled.select(*KEYS, "date", "y", F.explode(F.array(*fits)).alias("f")).where("f is not null")
    return got.select(*KEYS, "date", "f.method", F.col("y").alias("actual_log_price"), F.col("f.fitted").alias("fitted_log_price"), (F.col("y") - F.col("f.fitted")).alias("residual"), F.lit(window).alias("window"), "f.ridge_alpha")


def fittable(triplets: DataFrame, panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triplets whose three symbols are all in the panel, and the others."""
    s = panel.select("symbol").distinct()
    ok = triplets
    for leg in ("target_symbol", "hedge_symbol_1", "hedge_symbol_2"):
        ok = ok.join(s.withColumnRenamed("symbol", leg), leg, "left_semi")
    return ok, triplets.join(ok, "triplet_id", "left_anti")


def kernel_rolling(series: DataFrame, window: int, engine: str = "expr", by: str = "triplet_id", order: str = "date") -> DataFrame:
    """Rolling regressions over positions: rows with a missing leg stay, and count in the window but not in the fit.

    by, order, alpha, beta_1, beta_2, fitted_log_price, residual, backend.  Null with three complete rows or fewer in
    the window, or where the row itself is incomplete.  engine 'expr' uses window expressions, 'pandas' NumPy by group.
    """
    require(window > 3, "window must be at least 4")
    require(engine in ("expr", "pandas"), "engine must be 'expr' or 'pandas'")
    require_columns(series, [by, order, "y", "x1", "x2"])
    if engine == "pandas":
        kinds = dict(series.dtypes)
        return series.select(by, order, "y", "x1", "x2").groupBy(by).applyInPandas(_kernel_pandas(by, order, window), f"{by} {kinds[by]}, {order} {kinds[order]}, alpha double, beta_1 double, beta_2 double, fitted_log_price double, residual double, backend string")
    got = trailing_moments(dealt(series, by).select(by, order, "y", "x1", "x2"), window, by, order)
    whole = F.col("y").isNotNull() & F.col("x1").isNotNull() & F.col("x2").isNotNull()
    fits = (F.col("n") > 3) & (F.col("rn") > window) & whole
    s = solve(0.0)
    got = got.select(by, order, "y", "x1", "x2", *(F.when(fits, s[k]).alias(k) for k in ("alpha", "beta_1", "beta_2")))
    got = got.withColumn("fitted_log_price", predict()).withColumn("residual", F.col("y") - F.col("fitted_log_price"))
    return got.select(by, order, "alpha", "beta_1", "beta_2", "fitted_log_price", "residual", F.lit("expr").alias("backend"))


def kernel_rolling_with_fallback(series: DataFrame, window: int, by: str = "triplet_id", order: str = "date") -> DataFrame:
    """kernel_rolling() by expressions; groups in which some window's hedges are exactly collinear, which expressions
    leave null, are done again by the grouped back end, which gives the least-norm solution there."""
    fast = kernel_rolling(series, window, by=by, order=order)
    whole = F.col("y").isNotNull() & F.col("x1").isNotNull() & F.col("x2").isNotNull()
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-window, -1)
    fits = series.select(by, order, (whole & (F.count(F.when(whole, F.lit(1))).over(w) > 3) & (F.count(F.lit(1)).over(w) == window)).alias("fits"))
    open_ = fast.join(fits.where("fits"), [by, order]).where("alpha is null").select(by).distinct()
    slow = kernel_rolling(series.join(open_, by, "left_semi"), window, "pandas", by, order)
    return fast.join(open_, by, "left_anti").unionByName(slow)


def benchmark_kernels(series: DataFrame, window: int, repeats: int = 5) -> DataFrame:
    """backend, repeats, mean_seconds, min_seconds, max_seconds of running each back end over `series`."""
    rows = []
    for engine in ("expr", "pandas"):
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            kernel_rolling(series, window, engine).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        rows.append((engine, repeats, float(np.mean(took)), min(took), max(took)))
    return series.sparkSession.createDataFrame(rows, "backend string, repeats int, mean_seconds double, min_seconds double, max_seconds double")


def _kernel_pandas(by: str, order: str, window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        a = pdf[["y", "x1", "x2"]].to_numpy(float)
        ok = np.isfinite(a).all(1)
        out = np.full((len(a), 5), np.nan)
        for i in range(window, len(a)):
            use = np.flatnonzero(ok[i - window : i]) + i - window
            if not ok[i] or len(use) <= 3:
                continue
            design = np.column_stack([np.ones(len(use)), a[use, 1:]])
            beta = np.linalg.lstsq(design, a[use, 0], rcond=None)[0]
            fit_ = beta @ [1.0, a[i, 1], a[i, 2]]
            out[i] = [*beta, fit_, a[i, 0] - fit_]
        got = pd.DataFrame(out, columns=["alpha", "beta_1", "beta_2", "fitted_log_price", "residual"]).astype(object)
        got = got.where(pd.notna(got), None)
        return pd.concat([pdf[[by, order]], got, pd.Series(["pandas"] * len(a), name="backend")], axis=1)

    return run


def residual_kernel(df: DataFrame) -> DataFrame:
    """fitted_log_price and residual of rows with y, x1, x2 and coefficients; null where anything is missing."""
    return df.withColumn("fitted_log_price", predict()).withColumn("residual", F.col("y") - F.col("fitted_log_price"))


def compare_backends(a: DataFrame, b: DataFrame, by: str = "triplet_id", order: str = "date") -> DataFrame:
    """output_column, max_abs_diff, mean_abs_diff, n_compared of two runs of kernel_rolling()."""
    cols = ["alpha", "beta_1", "beta_2", "fitted_log_price", "residual"]
    joined = a.join(b.select(by, order, *(F.col(c).alias(f"o_{c}") for c in cols)), [by, order])
    diffs = joined.select(F.explode(F.array(*(F.struct(F.lit(c).alias("output_column"), F.abs(F.col(c) - F.col(f"o_{c}")).alias("d")) for c in cols))).alias("x")).select("x.*")
    return diffs.groupBy("output_column").agg(F.max("d").alias("max_abs_diff"), F.avg("d").alias("mean_abs_diff"), F.count("d").alias("n_compared"))
