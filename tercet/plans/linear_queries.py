"""Queries of regressions on any number of hedges and of unit-root tests, and their SQL: elimination as a recursion over lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.operators import linear, stationarity
from tercet.operators.residuals import GROUP
from tercet.plans.frames import WINDOW, Frames, rounded
from tercet.plans.oracle import part, query, r
from tercet.sources import panel

QUERIES: dict = {}
SQL: dict[str, str] = {}
HEDGES = (1, 3, 5)


def register(name, build, sql: str, digits: int = 6) -> None:
    """As in market_queries."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(Frames(spark, sf_dir)), digits)
    SQL[name] = query(sql)


# Baskets: every symbol and the k symbols that follow it, in the order of names and around
part("c_names", "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS at, count(*) OVER () AS n FROM c_symbols")
for _k in HEDGES:
    part(f"c_basket_{_k}", f"""SELECT t.symbol AS target, p.date, p.log_price AS y, list(q.log_price ORDER BY h.step) AS x FROM c_names t, (SELECT unnest(range(1, {_k + 1})) AS step) h
  JOIN c_names s ON s.at = (t.at + h.step) % t.n JOIN c_panel p ON p.symbol = t.symbol JOIN c_panel q ON q.symbol = s.symbol AND q.date = p.date GROUP BY ALL HAVING count(*) = {_k}""")
    part(f"c_basket_w_{_k}", f"SELECT *, list(struct_pack(y := y, x := x)) OVER (PARTITION BY target ORDER BY date ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS w FROM c_basket_{_k}")


def eliminated(name: str, keys: str, rows: str, k: int, penalty: float = 0.0, free: int = 0) -> None:
    """Parts that end with `name`: keys, n and the matrix m after Gauss-Jordan elimination of the first k of the k + 1 entries of z,
    of `rows` with keys and z; all but the first `free` diagonal entries are penalised."""
    ridge = f" + CASE WHEN i = j AND i > {free} AND i <= {k} THEN {penalty} ELSE 0.0 END" if penalty else ""
    part(f"{name}_c", f"SELECT {keys}, i, j, sum(z[i] * z[j]){ridge} AS v, count(*) AS n FROM ({rows}), (SELECT unnest(range(1, {k + 2})) AS i), (SELECT unnest(range(1, {k + 2})) AS j) GROUP BY {keys}, i, j")
    part(f"{name}_m", f"SELECT {keys}, n, list(line ORDER BY i) AS m FROM (SELECT {keys}, n, i, list(v ORDER BY j) AS line FROM {name}_c GROUP BY {keys}, n, i) GROUP BY {keys}, n")
    part(f"{name}_e", f"""/*recursive*/ SELECT {keys}, n, 0 AS s, m FROM {name}_m UNION ALL SELECT {keys}, n, s + 1,
  list_transform(m, lambda line, i: CASE WHEN i = s + 1 THEN list_transform(line, lambda v: v / m[s + 1][s + 1]) ELSE list_transform(list_zip(line, m[s + 1]), lambda p: p[1] - line[s + 1] * p[2] / m[s + 1][s + 1]) END)
  FROM {name}_e WHERE s < {k}""")
    part(name, f"SELECT {keys}, n, m FROM {name}_e WHERE s = {k}")


#: Settings of the queries: name, penalty, intercept, penalised intercept.
FITS = (("ols", 0.0, True, False), ("ols_origin", 0.0, False, False), ("ridge", 2.5, True, False), ("ridge_whole", 2.5, True, True), ("ridge_origin", 2.5, False, False))
for _k in HEDGES:
    for _name, _alpha, _own, _all in FITS:
        _z = "list_concat([1.0], list_append(x, y))" if _own else "list_append(x, y)"
        eliminated(f"c_any_{_name}_{_k}", "target", f"SELECT target, {_z} AS z FROM c_basket_{_k}", _k + _own, _alpha, int(_own and not _all))


def _fits(f: Frames, names: tuple[str, ...]) -> DataFrame:
    """method, hedges, target, n, place (0: the intercept), coefficient."""
    out = []
    for k in HEDGES:
        rows = panel.baskets(f.panel, k)
        for name, alpha, own, whole in FITS:
            if name in names:
                got = linear.fit(rows, ["target"], [f"x{i + 1}" for i in range(k)], alpha=alpha, fit_intercept=own, penalize_intercept=whole)
                at = F.posexplode(F.concat(F.array("intercept"), "coefficients")).alias("place", "coefficient")
                out.append(got.select(F.lit(name).alias("method"), F.lit(k).alias("hedges"), "target", "n", at))
    return reduce(DataFrame.unionByName, out)


def _fits_sql(names: tuple[str, ...]) -> str:
    one = "SELECT '{name}' AS method, {k} AS hedges, target, n, place::INTEGER AS place, round({value}, 5) + 0.0 AS coefficient FROM c_any_{name}_{k}, (SELECT unnest(range({k} + 1)) AS place)"
    value = {True: "m[place + 1][{w}]", False: "CASE WHEN place = 0 THEN 0.0 ELSE m[greatest(place, 1)][{w}] END"}
    return " UNION ALL ".join(one.format(name=name, k=k, value=value[own].format(w=k + own + 1)) for k in HEDGES for name, _, own, _ in FITS if name in names)


register("rg1_ols_of_any_size", lambda f: _fits(f, ("ols", "ols_origin")), _fits_sql(("ols", "ols_origin")), 5)
register("rg6_ridge_of_any_size", lambda f: _fits(f, ("ridge", "ridge_whole", "ridge_origin")), _fits_sql(("ridge", "ridge_whole", "ridge_origin")), 5)
eliminated("c_any_rolling", "target, date, y, x", "SELECT target, date, y, x, list_concat([1.0], list_append(v.x, v.y)) AS z FROM (SELECT target, date, y, x, unnest(w) AS v FROM c_basket_w_3 WHERE len(w) = %d)" % WINDOW, 4)
register(
    "rg5_rolling_ols_of_three",
    lambda f: linear.rolling_fit(panel.baskets(f.panel, 3), ["target"], "date", ["x1", "x2", "x3"], "y", WINDOW).select("target", "date", "y", "intercept", *(F.col("coefficients")[i].alias(f"beta_{i + 1}") for i in range(3)), "fitted", "residual"),
    f"SELECT target, date, {r('y', 'b1 AS intercept', 'b2 AS beta_1', 'b3 AS beta_2', 'b4 AS beta_3', 'b1 + b2 * x[1] + b3 * x[2] + b4 * x[3] AS fitted', 'y - (b1 + b2 * x[1] + b3 * x[2] + b4 * x[3]) AS residual', digits=4)} FROM (SELECT *, m[1][5] AS b1, m[2][5] AS b2, m[3][5] AS b3, m[4][5] AS b4 FROM c_any_rolling)",
    4,
)


def adf_parts(name: str, source: str) -> None:
    """Parts that end with `name`: g, lag_used, n_obs, tau of the unit-root test of `source` (g, o, v), group by group in order of o."""
    tiny = stationarity.TINY
    part(f"{name}_v", f"SELECT g, row_number() OVER w AS rn, count(*) OVER (PARTITION BY g) AS total, lag(v) OVER w AS level, v - lag(v) OVER w AS d FROM ({source}) WHERE isfinite(v) WINDOW w AS (PARTITION BY g ORDER BY o)")
    part(f"{name}_t", f"SELECT *, level - avg(level) OVER (PARTITION BY g) AS centred, greatest(0, least(floor(12 * pow(total / 100, 0.25)), total - 4))::INTEGER AS top, list(d) OVER (PARTITION BY g ORDER BY rn ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS before FROM {name}_v WHERE total >= 20")
    part(f"{name}_z", f"SELECT g, top, list_concat(CASE WHEN top > 0 THEN list_reverse(before)[1:top] ELSE [] END, [centred, d]) AS z FROM {name}_t WHERE rn >= top + 2")
    part(f"{name}_c", f"SELECT g, top, i, j, sum(z[i] * z[j]) - sum(z[i]) * sum(z[j]) / count(*) AS v, count(*) AS n FROM (SELECT g, top, z, i, unnest(range(1, top + 3)) AS j FROM (SELECT *, unnest(range(1, top + 3)) AS i FROM {name}_z)) GROUP BY g, top, i, j")
    part(f"{name}_m", f"SELECT g, top, n, list(line ORDER BY i) AS m FROM (SELECT g, top, n, i, list(v ORDER BY j) AS line FROM {name}_c GROUP BY g, top, n, i) GROUP BY g, top, n")
    part(f"{name}_e", f"""/*recursive*/ SELECT g, top, n, m AS whole, 0 AS k, m FROM {name}_m UNION ALL SELECT g, top, n, whole, k + 1,
  CASE WHEN m[k + 1][k + 1] > {tiny} * whole[k + 1][k + 1] THEN list_transform(m, lambda line: list_transform(list_zip(line, m[k + 1]), lambda p: p[1] - line[k + 1] * p[2] / m[k + 1][k + 1])) ELSE m END FROM {name}_e WHERE k < top""")
    part(f"{name}_b", f"SELECT g, n, k, m[top + 1][top + 1] AS ll, m[top + 1][top + 2] AS ly, m[top + 1][top + 1] > {tiny} * whole[top + 1][top + 1] AS moves, m[top + 2][top + 2] - CASE WHEN m[top + 1][top + 1] > {tiny} * whole[top + 1][top + 1] THEN m[top + 1][top + 2] ** 2 / m[top + 1][top + 1] ELSE 0 END AS rss FROM {name}_e")
    part(name, f"SELECT g, k::INTEGER AS lag_used, n::INTEGER AS n_obs, CASE WHEN moves AND rss > 0 THEN ly / ll / sqrt(rss / (n - k - 2) / ll) END AS tau FROM {name}_b WHERE n - k - 2 > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY CASE WHEN rss > 0 THEN n * ln(rss / n) + 2 * (k + 2) END NULLS LAST, k) = 1")


P_VALUE = "CASE WHEN tau IS NULL THEN 1.0 WHEN tau <= -3.43 THEN greatest(0.001, 0.01 + (tau + 3.43) * 0.04 / 0.57) WHEN tau <= -2.86 THEN 0.01 + (tau + 3.43) * 0.04 / 0.57 WHEN tau <= -2.57 THEN 0.05 + (tau + 2.86) * 0.05 / 0.29 ELSE least(0.995, 0.05 + (tau + 2.86) * 0.05 / 0.29) END"
adf_parts("c_adf", "SELECT concat_ws('|', triplet_id, method) AS g, date AS o, residual AS v FROM c_resid")
part("c_adf_p", f"SELECT split_part(g, '|', 1) AS triplet_id, split_part(g, '|', 2) AS method, tau, lag_used, n_obs, {P_VALUE} AS p FROM c_adf")
part("c_adf_fdr", "SELECT *, coalesce(p <= (SELECT max(p) FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM c_adf_p) WHERE p <= k * 0.05 / n), false) AS fdr_reject FROM c_adf_p")
_TEST = f"triplet_id, method, {r('tau AS adf_statistic', 'p AS adf_p_value', digits=5)}, lag_used, n_obs, {', '.join(f'{v}::DOUBLE AS {k}' for k, v in stationarity.CRITICAL.items())}"
register("st1_adf", lambda f: stationarity.adf_by_group(f.residuals), f"SELECT {_TEST} FROM c_adf_p", 5)
register("st5_cointegration_report", lambda f: stationarity.cointegration_report(f.residuals), f"SELECT {_TEST}, fdr_reject FROM c_adf_fdr", 5)
register("st6_cointegration_gate", lambda f: stationarity.cointegration_gate(f.residuals, stationarity.cointegration_report(f.residuals)).groupBy(*GROUP).count(), "SELECT triplet_id, method, count(*) AS count FROM c_resid WHERE triplet_id IN (SELECT triplet_id FROM c_adf_fdr WHERE fdr_reject) GROUP BY triplet_id, method")
_TRIED = {k / 10: stationarity.fractional_weights(k / 10, 1e-3) for k in range(11)}
part("c_fractional", " UNION ALL ".join(
    f"SELECT symbol, date, log_price, {d}::DOUBLE AS d, CASE WHEN count(*) OVER w = {len(w)} THEN list_inner_product(list(log_price) OVER w, {list(reversed(w))}::DOUBLE[]) END AS v FROM c_panel WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {len(w) - 1} PRECEDING AND CURRENT ROW)"
    for d, w in _TRIED.items()
))
adf_parts("c_fadf", "SELECT concat_ws('|', symbol, d::VARCHAR) AS g, date AS o, v FROM c_fractional WHERE v IS NOT NULL")
part("c_fadf_p", f"SELECT split_part(g, '|', 1) AS symbol, split_part(g, '|', 2)::DOUBLE AS d, {P_VALUE} AS p FROM c_fadf WHERE tau IS NOT NULL")
register(
    "st9_minimum_stationary_d",
    lambda f: stationarity.minimum_stationary_d(f.panel, threshold=1e-3),
    f"SELECT s.symbol, b.d, {r('b.p AS adf_p_value', 'b.c AS correlation_with_level', digits=5)} FROM c_symbols s LEFT JOIN (SELECT * FROM (SELECT p.symbol, p.d, p.p, corr(f.log_price, f.v) AS c FROM c_fadf_p p JOIN c_fractional f ON f.symbol = p.symbol AND f.d = p.d AND f.v IS NOT NULL WHERE p.p <= 0.05 GROUP BY p.symbol, p.d, p.p) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d) = 1) b USING (symbol)",
    5,
)
