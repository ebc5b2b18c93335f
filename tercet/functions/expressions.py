"""Column expressions used across operators; undefined results are null, never NaN or infinite."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def over(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0 or null."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def null_if_nan(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def rows(by: list[str] | str, order: list[str] | str, start: int, end: int) -> WindowSpec:
    """A frame of rows around the current one, in `order`, among the rows that agree on `by`."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(start, end)


def correlation(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson's correlation of complete pairs; null where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    c, s, t = (p.over(w) if w is not None else p for p in parts)
    return over(c, s * t)


def sigmoid(z: Column | str) -> Column:
    """1 / (1 + exp(-z)), by the branch whose exponential cannot overflow."""
    x = col(z)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_loss_term(y: Column | str, p: Column | str, eps: float = 1e-12) -> Column:
    """A row's share of the cross entropy, with p kept off 0 and 1."""
    q = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))
    return -(col(y) * F.log(q) + (1 - col(y)) * F.log(1 - q))


def gini(positive: Column | str, n: Column | str) -> Column:
    """Gini impurity of a node."""
    p = over(positive, n)
    return 2 * p * (1 - p)


def entropy(positive: Column | str, n: Column | str) -> Column:
    """Entropy of a node in bits."""
    p = over(positive, n)
    term = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(F.lit(0.0))
    return F.when(p.isNotNull(), term(p) + term(1 - p))


#: Two-sided normal quantiles by confidence.
NORMAL_QUANTILES = {0.80: 1.2815515655446004, 0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def wilson(successes: Column | str, n: Column | str, confidence: float = 0.90) -> tuple[Column, Column]:
    """Lower and upper bound of Wilson's score interval; null where n is not positive."""
    if confidence not in NORMAL_QUANTILES:
        raise ValueError(f"confidence must be one of {sorted(NORMAL_QUANTILES)}")
    z, k = F.lit(NORMAL_QUANTILES[confidence]), F.when(col(n) > 0, col(n).cast("double"))
    p = over(successes, k)
    centre, width = (p + z * z / (2 * k)) / (1 + z * z / k), z / (1 + z * z / k) * F.sqrt(p * (1 - p) / k + z * z / (4 * k * k))
    return F.greatest(F.lit(0.0), centre - width), F.least(F.lit(1.0), centre + width)


def adf_p_value(tau: Column | str) -> Column:
    """An approximate p-value of an ADF statistic: linear between the critical values, floored and capped beyond."""
    t = col(tau)
    c1, c5, c10 = -3.43, -2.86, -2.57  # fixed values: critical values at 1, 5 and 10 percent
    line = lambda a, pa, b, pb: F.lit(pa) + (t - a) * ((pb - pa) / (b - a))
    return F.when(t <= c1, F.greatest(F.lit(0.001), line(c1, 0.01, c5, 0.05))).when(t <= c5, line(c1, 0.01, c5, 0.05)).when(t <= c10, line(c5, 0.05, c10, 0.10)).otherwise(F.least(F.lit(0.995), line(c5, 0.05, c10, 0.10)))
