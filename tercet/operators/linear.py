"""Linear and ridge regression on any number of columns, from cross products.

The rows of a group, or of the window before a row, become one matrix of cross products in one aggregation (partial in the tasks)
or one sort; the matrix is solved by Gauss-Jordan elimination in array expressions.  Only where columns are collinear, and the
least-norm solution is asked for, is the matrix (never the rows) handed to NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.functions.expressions import null_if_nan
from tercet.guards import require, require_columns

#: A pivot below this share of what stood there before elimination counts as zero.
TINY = 1e-11


def complete(columns: list[str]) -> Column:
    """Whether all of `columns` are there and finite."""
    return reduce(lambda a, b: a & b, (null_if_nan(c).isNotNull() for c in columns))


def square(m: int, cell) -> str:
    """SQL of an m x m matrix, as an array of rows."""
    return f"array({', '.join('array(' + ', '.join(cell(min(i, j), max(i, j)) for j in range(m)) + ')' for i in range(m))})"


def cross_products(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by columns, n, means (array), cross (matrix of sums of products of deviations), of the rows that are complete."""
    require_columns(rows, [*by, *columns])
    pair = lambda i, j: f"covar_pop(`{columns[i]}`, `{columns[j]}`) * count(*)"
    means = ", ".join(f"avg(`{c}`)" for c in columns)
    return rows.where(complete(columns)).groupBy(*by).agg(F.count("*").alias("n"), F.expr(f"array({means})").alias("means"), F.expr(square(len(columns), pair)).alias("cross"))


def trailing_cross_products(rows: DataFrame, by: list[str], order: str, columns: list[str], window: int) -> DataFrame:
    """`rows` with rn, n, means and cross of those of the `window` rows before each that are complete.

    They are differences of running sums of deviations from the group's first complete row: a row costs the same whatever the
    window, one sort serves all, and nothing comes from later rows.
    """
    path = Window.partitionBy(*by).orderBy(order)
    upto = path.rowsBetween(Window.unboundedPreceding, 0)
    whole, m = complete(columns), len(columns)
    got = rows.select("*", F.row_number().over(path).alias("rn"), *(F.first(F.when(whole, F.col(f"`{c}`")), ignorenulls=True).over(upto).alias(f"__f{i}") for i, c in enumerate(columns)))
    d = [F.when(whole, F.col(f"`{c}`") - F.col(f"__f{i}")).otherwise(0.0) for i, c in enumerate(columns)]
    sums = {"n": F.when(whole, 1).otherwise(0)} | {f"s{i}": d[i] for i in range(m)} | {f"p{i}_{j}": d[i] * d[j] for i in range(m) for j in range(i, m)}
    got = got.withColumn("__s", F.struct(*(F.sum(c).over(upto).alias(k) for k, c in sums.items())))
    got = got.withColumn("__a", F.lag("__s", 1).over(path)).withColumn("__b", F.lag("__s", window + 1).over(path))
    got = got.withColumn("n", F.coalesce("__a.n", F.lit(0)) - F.coalesce("__b.n", F.lit(0)))
    gap = lambda k: f"(coalesce(__a.{k}, 0D) - coalesce(__b.{k}, 0D))"

    def cell(i: int, j: int) -> str:
        v = f"({gap(f'p{i}_{j}')} - {gap(f's{i}')} * {gap(f's{j}')} / nullif(n, 0))"
        return v if i != j else f"CASE WHEN {v} > 1e-13D * __a.p{i}_{i} THEN {v} ELSE 0D END"  # within rounding of zero

    means = ", ".join(f"__f{i} + {gap(f's{i}')} / nullif(n, 0)" for i in range(m))
    return got.select(*rows.columns, "rn", "n", F.expr(f"array({means})").alias("means"), F.expr(square(m, cell)).alias("cross"))


def swept(matrix: str, first: str, last: str) -> str:
    """SQL: struct(m, ok): `matrix` after Gauss-Jordan elimination of the variables first..last (from 0), and which had a pivot."""
    pivot = "s.m[i][i]"
    step = f"transform(s.m, (row, j) -> IF(j = i, transform(row, v -> v / {pivot}), zip_with(row, s.m[i], (a, b) -> a - row[i] * b / {pivot})))"
    clear = f"{pivot} > {TINY}D * {matrix}[i][i]"
    return (
        f"aggregate(sequence({first}, {last}), named_struct('m', {matrix}, 'ok', cast(array() AS array<boolean>)), "
        f"(s, i) -> named_struct('m', IF({clear}, {step}, s.m), 'ok', concat(s.ok, array(coalesce({clear}, false)))))"
    )


def _least_norm(keys: list[str], alpha: float, fit_intercept: bool, penalize_intercept: bool):
    """Solutions of singular systems from their cross products, a row each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for n, means, cross in zip(pdf["n"], pdf["means"], pdf["cross"], strict=True):
                m, c = np.array(means, float), np.array([list(r) for r in cross], float)
                v = np.concatenate([[1.0], m]) if fit_intercept else m
                whole = n * np.outer(v, v)
                whole[-len(m) :, -len(m) :] += c
                lhs = whole[:-1, :-1] + alpha * np.diag([float(penalize_intercept or not fit_intercept or k > 0) for k in range(len(v) - 1)])
                b = np.linalg.lstsq(lhs, whole[:-1, -1], rcond=1e-12)[0]
                rss = whole[-1, -1] - 2 * b @ whole[:-1, -1] + b @ whole[:-1, :-1] @ b
                r2 = 0.0 if c[-1, -1] == 0 else 1 - rss / c[-1, -1]
                out.append((float(b[0]) if fit_intercept else 0.0, b[1:].tolist() if fit_intercept else b.tolist(), float(r2)))
            yield pd.concat([pdf[keys], pd.DataFrame(out, columns=["intercept", "coefficients", "r_squared"])], axis=1)

    return run


def solve(moments: DataFrame, keep: list[str], k: int, alpha: float = 0.0, fit_intercept: bool = True, penalize_intercept: bool = False, least_norm: bool = True) -> DataFrame:
    """keep columns, intercept, coefficients (array), r_squared, n of systems with n, means and cross of k columns and the target.

    alpha penalises slopes, and the intercept too if `penalize_intercept`.  Collinear systems: the least-norm solution, or nulls.
    """
    require(alpha >= 0, "alpha must not be negative")
    raw = lambda i, j: f"cross[{i}][{j}] + n * means[{i}] * means[{j}]"
    if not fit_intercept:
        size, u = k, square(k + 1, raw)
    elif penalize_intercept:
        size, u = k + 1, square(k + 2, lambda i, j: ("cast(n AS double)" if j == 0 else f"n * means[{j - 1}]") if i == 0 else raw(i - 1, j - 1))
    else:
        size, u = k, "cross"
    got = moments.where("n > 0").withColumn("__u", F.expr(u))
    got = got.withColumn("__p", F.expr(square(size + 1, lambda i, j: f"__u[{i}][{j}]" + (f" + {float(alpha)}D" if i == j < size else ""))))
    got = got.withColumn("__g", F.expr(swept("__p", "0", str(size - 1))))
    got = got.withColumn("__b", F.expr(f"transform(sequence(0, {size - 1}), i -> __g.m[i][{size}])")).withColumn("__full", F.expr("forall(__g.ok, x -> x)"))
    fitted = " + ".join(f"__b[{i}] * (2 * __u[{i}][{size}] - ({' + '.join(f'__b[{j}] * __u[{i}][{j}]' for j in range(size))}))" for i in range(size))
    got = got.withColumn("__rss", F.expr(f"__u[{size}][{size}] - ({fitted})"))
    slopes = "slice(__b, 2, {k})".format(k=k) if penalize_intercept and fit_intercept else "__b"
    if not fit_intercept:
        intercept = "0D"
    elif penalize_intercept:
        intercept = "__b[0]"
    else:
        intercept = f"means[{k}] - ({' + '.join(f'__b[{i}] * means[{i}]' for i in range(k))})"
    total = f"cross[{k}][{k}]"
    done = got.where("__full") if least_norm else got
    only = lambda c: c if least_norm else f"IF(__full, {c}, NULL)"
    out = done.selectExpr(*(f"`{c}`" for c in keep), f"{only(intercept)} AS intercept", f"{only(slopes)} AS coefficients", f"{only(f'IF({total} = 0, 0D, 1 - __rss / {total})')} AS r_squared", "n")
    if not least_norm:
        return out
    kinds = dict(moments.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n long", "intercept double, coefficients array<double>, r_squared double"])
    names = [*keep, "n"]
    rest = got.where("NOT __full").select(*(F.col(f"`{c}`") for c in keep), F.col("n").cast("long").alias("n"), "means", "cross")
    solved = rest.mapInPandas(_least_norm(names, alpha, fit_intercept, penalize_intercept), schema)
    return out.unionByName(solved.select(*(F.col(f"`{c}`") for c in keep), "intercept", "coefficients", "r_squared", F.col("n").cast(dict(out.dtypes)["n"]).alias("n")))


def fit(rows: DataFrame, by: list[str], x: list[str], y: str = "y", **settings) -> DataFrame:
    """A regression of y on the columns x over the complete rows of each group; settings and columns as in solve()."""
    require(len(x) > 0, "at least one column is required")
    return solve(cross_products(rows, by, [*x, y]), by, len(x), **settings)


def rolling_fit(rows: DataFrame, by: list[str], order: str, x: list[str], y: str, window: int, **settings) -> DataFrame:
    """A regression for every row on the `window` rows before it, where all of those are complete: by, order, y, x columns and
    what solve() gives, and the fitted value and residual of the row itself."""
    require(window > len(x), "window must exceed the number of columns")
    keep = [*by, order, y, *x]
    held = trailing_cross_products(rows.select(*keep), by, order, [*x, y], window).where(F.col("n") == window)
    got = solve(held, keep, len(x), **settings)
    fitted = predict(x)
    return got.withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted"))


def predict(x: list[str]) -> Column:
    """The fitted value of a row that has the columns x, intercept and coefficients."""
    return reduce(lambda a, b: a + b, (F.col("coefficients")[i] * F.col(f"`{c}`") for i, c in enumerate(x)), F.col("intercept"))
