"""DuckDB SQL that the registered queries must agree with: named common table expressions, and a select on top of them."""

from __future__ import annotations

import re

import numpy as np

from tercet.operators.regimes import HMM, REGIMES, regime_labels, sticky

#: Common table expressions; each may use those above it.
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def r(*columns: str, digits: int = 6) -> str:
    """Select-list entries rounded as queries round; 'expr AS name' keeps its name."""
    out = []
    for c in columns:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"round({expr or name}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)


DATES = ("date", "event_date", "exit_date", "pnl_date", "train_start", "train_end", "first_clean_date", "last_clean_date")


def dates_as_text(select: str) -> str:
    """`select` with the dates of its outermost lists as text, as queries give them."""
    out, depth, at, in_list = [], 0, 0, False
    for m in re.finditer(r"'[^']*'|[()]|,|\bSELECT\b|\bFROM\b", select):
        t = m[0].upper()
        if t in "()":
            depth += 1 if t == "(" else -1
        elif depth == 0 and t in ("SELECT", "FROM", ","):
            item = select[at : m.start()]
            name = re.split(r"[\s.]", item.strip())[-1]
            if in_list and name in DATES:
                expr = re.sub(rf"\s+AS\s+{name}\s*$", "", item.strip())
                item = f" CAST({expr} AS VARCHAR) AS {name}{' ' if t == 'FROM' else ''}"
            out += [item, m[0]]
            at = m.end()
            in_list = t == "SELECT" or t == "," and in_list
    return "".join(out) + select[at:]


#: Parts that several others read: computed once.
SHARED = ("c_panel", "c_obs", "c_scored", "c_n", "c_events", "c_paths", "c_labels", "c_hmm_x", "c_hmm_f")


def query(select: str) -> str:
    """`select` with the common table expressions it needs."""
    select = dates_as_text(select)
    need: list[str] = []

    def visit(sql: str) -> None:
        for name in PARTS:
            if name not in need and PARTS[name] is not sql and re.search(rf"\b{name}\b", sql):
                visit(PARTS[name])
                need.append(name) if name not in need else None

    visit(select)
    recursive = "RECURSIVE " if any("/*recursive*/" in PARTS[n] for n in need) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({PARTS[n]})" for n in need) + f"\n{select}" if need else select


K = "triplet_id, target_symbol, hedge_symbol_1, hedge_symbol_2"
W = 60

part("c_raw", """SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_discount < 0.005 THEN NULL WHEN l_tax > 0.075 THEN 0.0 ELSE l_extendedprice / l_quantity END AS adj_close,
  l_quantity AS volume, 'lineitem' AS source, l_orderkey * 10 + l_linenumber AS ingest_seq FROM lineitem JOIN part ON l_partkey = p_partkey""")
part("c_clean", """SELECT symbol, date, adj_close, volume, source, CASE WHEN adj_close >= 0.01 THEN 'clean' ELSE 'invalid_price' END AS quality_flag FROM c_raw
  QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY ingest_seq DESC, adj_close DESC NULLS LAST, volume DESC NULLS LAST, source DESC) = 1""")
part("c_returns", """SELECT symbol, date, adj_close / lag(adj_close) OVER w - 1 AS simple_return, ln(adj_close) - ln(lag(adj_close) OVER w) AS log_return FROM c_clean WHERE quality_flag = 'clean'
  WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
part("c_panel0", """SELECT p_type AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS vwap, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING sum(l_quantity) > 0 AND sum(l_extendedprice) > 0""")
part("c_panel", """SELECT symbol, date, vwap, volume, 4.0 + sum(s) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS log_price
  FROM (SELECT *, ln(vwap) - avg(ln(vwap)) OVER (PARTITION BY symbol) AS s FROM c_panel0)""")
part("c_symbols", "SELECT DISTINCT symbol FROM c_panel")
part("c_triplets", """SELECT concat_ws('_', t.symbol, a.symbol, b.symbol) AS triplet_id, t.symbol AS target_symbol, a.symbol AS hedge_symbol_1, b.symbol AS hedge_symbol_2, 'theme_' || lower(substr(t.symbol, 1, 3)) AS theme
  FROM c_symbols t, c_symbols a, c_symbols b WHERE a.symbol < b.symbol AND t.symbol <> a.symbol AND t.symbol <> b.symbol""")
part("c_obs", f"""SELECT {K}, p.date, p.log_price AS y, a.log_price AS x1, b.log_price AS x2 FROM c_triplets JOIN c_panel p ON p.symbol = target_symbol
  JOIN c_panel a ON a.symbol = hedge_symbol_1 AND a.date = p.date JOIN c_panel b ON b.symbol = hedge_symbol_2 AND b.date = p.date""")
MOMENTS = "count(y){o} AS n, avg(y){o} AS my, avg(x1){o} AS m1, avg(x2){o} AS m2, var_pop(y){o} AS vy, var_pop(x1){o} AS v1, var_pop(x2){o} AS v2, covar_pop(x1, x2){o} AS c12, covar_pop(x1, y){o} AS c1y, covar_pop(x2, y){o} AS c2y"


def solved(alpha: str, keep: str, source: str) -> str:
    """alpha, beta_1, beta_2, r_squared from moments."""
    lam = f"({alpha} / n)"
    det = f"((v1 + {lam}) * (v2 + {lam}) - c12 * c12)"
    return f"""SELECT {keep}, my - beta_1 * m1 - beta_2 * m2 AS alpha, beta_1, beta_2,
  CASE WHEN vy = 0 THEN 0.0 ELSE 1 - (vy - 2 * (beta_1 * c1y + beta_2 * c2y) + beta_1 * beta_1 * v1 + beta_2 * beta_2 * v2 + 2 * beta_1 * beta_2 * c12) / nullif(vy, 0) END AS r_squared
  FROM (SELECT *, (c1y * (v2 + {lam}) - c2y * c12) / nullif({det}, 0) AS beta_1, (c2y * (v1 + {lam}) - c1y * c12) / nullif({det}, 0) AS beta_2 FROM {source})"""


part("c_full_m", f"SELECT {K}, {MOMENTS.format(o='')} FROM c_obs GROUP BY {K}")
part("c_full", solved("0.0", f"{K}, n", "c_full_m"))
part("c_ridge_full", solved("2.5", f"{K}, n", "c_full_m"))
part("c_rolled", f"""SELECT * FROM (SELECT {K}, date, y, x1, x2, {MOMENTS.format(o=' OVER w')}, min(date) OVER w AS train_start, max(date) OVER w AS train_end FROM c_obs
  WINDOW w AS (PARTITION BY triplet_id ORDER BY date ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING)) WHERE n = {W}""")
part("c_ols", solved("0.0", f"{K}, date, y, x1, x2, train_start, train_end", "c_rolled"))
part("c_ridge", solved("1.0", f"{K}, date, y, x1, x2, train_start, train_end", "c_rolled"))
part("c_numbered", "SELECT *, row_number() OVER (PARTITION BY triplet_id ORDER BY date) AS rn FROM c_obs")
part("c_first_m", f"SELECT triplet_id, {MOMENTS.format(o='')} FROM c_numbered WHERE rn <= {W} GROUP BY triplet_id HAVING count(*) = {W}")
part("c_first", solved("0.0", "triplet_id", "c_first_m"))
part("c_resid", f"""SELECT {K}, date, method, y AS actual_log_price, f AS fitted_log_price, y - f AS residual, {W} AS "window", ridge_alpha FROM (
  SELECT {K}, date, 'static_ols_initial_window' AS method, y, alpha + beta_1 * x1 + beta_2 * x2 AS f, CAST(NULL AS DOUBLE) AS ridge_alpha FROM c_numbered JOIN c_first USING (triplet_id) WHERE rn > {W}
  UNION ALL SELECT {K}, date, 'rolling_ols', y, alpha + beta_1 * x1 + beta_2 * x2, NULL FROM c_ols
  UNION ALL SELECT {K}, date, 'rolling_ridge', y, alpha + beta_1 * x1 + beta_2 * x2, 1.0 FROM c_ridge)""")
part("c_scored", """SELECT * EXCLUDE (n, m, s), CASE WHEN n >= 20 THEN (residual - m) / nullif(s, 0) END AS z_score FROM (SELECT *, count(residual) OVER w AS n, avg(residual) OVER w AS m, stddev_samp(residual) OVER w AS s FROM c_resid
  WINDOW w AS (PARTITION BY triplet_id, method ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))""")
part("c_n", "SELECT *, row_number() OVER (PARTITION BY triplet_id, method ORDER BY date) AS rn FROM c_scored")
part("c_events", f"""SELECT substr(sha1(concat_ws('|', triplet_id, method, strftime(date, '%Y-%m-%d'), side, printf('%.8f', z_score))), 1, 16) AS event_id, * EXCLUDE (date), date AS event_date FROM (
  SELECT {K}, method, date, CASE WHEN z_score > 0 THEN 'short_spread' ELSE 'long_spread' END AS side, z_score AS entry_z_score, abs(z_score) AS entry_abs_z, residual AS entry_residual, rn - 1 AS event_row, rn, z_score
  FROM (SELECT *, lag(abs(z_score)) OVER (PARTITION BY triplet_id, method ORDER BY date) AS b FROM c_n) WHERE abs(z_score) >= 2.0 AND b < 2.0)""")
part("c_paths", """SELECT triplet_id, method, rn, min(CASE WHEN z_score <= 0.5 THEN rn END) OVER h AS s_ok, min(CASE WHEN z_score >= 3.0 THEN rn END) OVER h AS s_st, min(CASE WHEN -z_score <= 0.5 THEN rn END) OVER h AS l_ok,
  min(CASE WHEN -z_score >= 3.0 THEN rn END) OVER h AS l_st, max(rn) OVER h AS last_rn FROM c_n WINDOW h AS (PARTITION BY triplet_id, method ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)""")
part("c_labels", """SELECT event_id, triplet_id, method, event_date, x.date AS exit_date, side, CAST(reason = 'reversion' AS INTEGER) AS label, CASE WHEN reason = 'reversion' THEN 'success' ELSE 'failure' END AS outcome, reason AS exit_reason,
  CAST(coalesce(x_rn - e.rn, 0) AS INTEGER) AS holding_period, entry_z_score, entry_abs_z, x.z_score AS exit_z_score, entry_residual, x.residual AS exit_residual, 2.0 AS entry_threshold, 0.5 AS exit_z, 3.0 AS stop_loss_z, 20 AS max_holding_period
  FROM (SELECT *, CASE WHEN last_rn IS NULL THEN 'no_forward_observations' WHEN ok IS NOT NULL AND (st IS NULL OR ok <= st) THEN 'reversion' WHEN st IS NOT NULL THEN 'stop_loss' ELSE 'max_holding_period' END AS reason,
    coalesce(least(ok, st), last_rn) AS x_rn FROM (SELECT c_events.*, CASE WHEN side = 'short_spread' THEN s_ok ELSE l_ok END AS ok, CASE WHEN side = 'short_spread' THEN s_st ELSE l_st END AS st, last_rn
    FROM c_events JOIN c_paths USING (triplet_id, method, rn))) e LEFT JOIN c_n x ON x.triplet_id = e.triplet_id AND x.method = e.method AND x.rn = e.x_rn""".replace("SELECT event_id, triplet_id, method, event_date, x.date", "SELECT event_id, e.triplet_id, e.method, event_date, x.date"))
part("c_spine", f"""SELECT {K}, d.date, p.log_price AS y, CASE WHEN weekofyear(d.date) % 10 <> 0 THEN a.log_price END AS x1, b.log_price AS x2 FROM c_triplets CROSS JOIN (SELECT DISTINCT date FROM c_panel) d
  LEFT JOIN c_panel p ON p.symbol = target_symbol AND p.date = d.date LEFT JOIN c_panel a ON a.symbol = hedge_symbol_1 AND a.date = d.date LEFT JOIN c_panel b ON b.symbol = hedge_symbol_2 AND b.date = d.date""")
part("c_kernel_m", f"""SELECT triplet_id, date, yy, xx1, xx2, y IS NOT NULL AS ok, count(*) OVER w AS held, {MOMENTS.format(o=' OVER w')} FROM (SELECT triplet_id, date, y AS yy, x1 AS xx1, x2 AS xx2, CASE WHEN x1 + x2 IS NOT NULL THEN y END AS y,
  CASE WHEN y + x2 IS NOT NULL THEN x1 END AS x1, CASE WHEN y + x1 IS NOT NULL THEN x2 END AS x2 FROM c_spine) WINDOW w AS (PARTITION BY triplet_id ORDER BY date ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING)""")
part("c_kernel_s", solved("0.0", "triplet_id, date, yy, xx1, xx2, ok AND n > 3 AND held = 60 AS good", "c_kernel_m"))
part("c_kernel", """SELECT triplet_id, date, CASE WHEN good THEN alpha END AS alpha, CASE WHEN good THEN beta_1 END AS beta_1, CASE WHEN good THEN beta_2 END AS beta_2,
  CASE WHEN good THEN alpha + beta_1 * xx1 + beta_2 * xx2 END AS fitted_log_price, CASE WHEN good THEN yy - (alpha + beta_1 * xx1 + beta_2 * xx2) END AS residual FROM c_kernel_s""")
CORR = "CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 AND stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 THEN covar_pop({a}, {b}) / (stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END)) END"
part("c_lagged", "SELECT *, lag(residual) OVER (PARTITION BY triplet_id, method ORDER BY date) AS l FROM c_resid")
part("c_summary", f"""SELECT triplet_id, method, count(*) AS n_obs, avg(residual) AS residual_mean, coalesce(stddev_samp(residual), 0) AS residual_std, avg(abs(residual)) AS residual_abs_mean, min(residual) AS residual_min,
  quantile_cont(residual, 0.05) AS residual_q05, quantile_cont(residual, 0.5) AS residual_median, quantile_cont(residual, 0.95) AS residual_q95, max(residual) AS residual_max, {CORR.format(a='residual', b='l')} AS autocorr_1
  FROM c_lagged GROUP BY triplet_id, method""")
SUMMARY = "residual_mean residual_std residual_abs_mean residual_min residual_q05 residual_median residual_q95 residual_max autocorr_1".split()

# The filter: one step of the recursion is one row further in every triplet
part("c_kalman", """/*recursive*/ SELECT triplet_id, 0::BIGINT AS rn, y AS a, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p13, 1.0::DOUBLE AS p22, 0.0::DOUBLE AS p23, 1.0::DOUBLE AS p33,
    0.0::DOUBLE AS a0, 0.0::DOUBLE AS b10, 0.0::DOUBLE AS b20, 0.0::DOUBLE AS inn, 1.0::DOUBLE AS s, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2, 0.0::DOUBLE AS g3 FROM c_numbered WHERE rn = 1
  UNION ALL SELECT triplet_id, rn, a0 + g1 * inn / s, b10 + g2 * inn / s, b20 + g3 * inn / s, q11 - g1 * g1 / s, p12 - g1 * g2 / s, p13 - g1 * g3 / s, q22 - g2 * g2 / s, p23 - g2 * g3 / s, q33 - g3 * g3 / s, a0, b10, b20, inn, s, g1, g2, g3
  FROM (SELECT *, g1 + x1 * g2 + x2 * g3 + 1e-4 AS s FROM (SELECT *, q11 + p12 * x1 + p13 * x2 AS g1, p12 + q22 * x1 + p23 * x2 AS g2, p13 + p23 * x1 + q33 * x2 AS g3 FROM (
    SELECT o.triplet_id, o.rn, o.x1, o.x2, k.a AS a0, k.b1 AS b10, k.b2 AS b20, k.p11 + 1e-5 AS q11, k.p12, k.p13, k.p22 + 1e-5 AS q22, k.p23, k.p33 + 1e-5 AS q33, o.y - (k.a + k.b1 * o.x1 + k.b2 * o.x2) AS inn
    FROM c_kalman k JOIN c_numbered o ON o.triplet_id = k.triplet_id AND o.rn = k.rn + 1)))""")
part("c_filtered", f"""SELECT {', '.join('o.' + c.strip() for c in K.split(','))}, o.date, 'kalman_random_walk' AS method, a AS alpha, b1 AS beta_1, b2 AS beta_2, a0 AS predicted_alpha, b10 AS predicted_beta_1, b20 AS predicted_beta_2, y AS actual_log_price, y - inn AS fitted_log_price, inn AS residual,
  s AS residual_variance, g1 / s AS kalman_gain_alpha, g2 / s AS kalman_gain_beta_1, g3 / s AS kalman_gain_beta_2, p11 + p22 + p33 AS state_cov_trace FROM c_kalman k JOIN c_numbered o USING (triplet_id, rn) WHERE rn > 0""")
part("c_both_resid", "SELECT triplet_id, method, date, residual FROM c_filtered UNION ALL SELECT triplet_id, method, date, residual FROM c_resid WHERE method <> 'static_ols_initial_window'")
part("c_both_lagged", "SELECT *, lag(residual) OVER (PARTITION BY triplet_id, method ORDER BY date) AS l FROM c_both_resid")
part("c_both_summary", PARTS["c_summary"].replace("c_lagged", "c_both_lagged"))

# Regimes of a given model: forward weights and best scores, then backward weights and the best path, a row further a step
REGIME = HMM(np.full(3, 1 / 3), sticky(3, 0.9), np.array([0.1, 1.5, -0.2]), np.array([0.4, 0.6, 5.0]))
_S, _N, _T = (1, 2, 3), regime_labels(REGIME.mean, REGIME.variance), REGIME.transition
_lowest = lambda *v: f"CASE WHEN {v[0]} >= {v[1]} AND {v[0]} >= {v[2]} THEN 0 WHEN {v[1]} >= {v[2]} THEN 1 ELSE 2 END"
_each = lambda text: ", ".join(text(i) for i in _S)
_option = lambda i, j: f"d{i} + ln({float(_T[i - 1, j - 1])!r}::DOUBLE)"
part("c_hmm_x", f"""SELECT triplet_id, method, date, z_score AS x, row_number() OVER (PARTITION BY triplet_id, method ORDER BY date, z_score) AS t, count(*) OVER (PARTITION BY triplet_id, method) AS n,
  {_each(lambda i: f"greatest(exp(-0.5 * (z_score - {float(REGIME.mean[i - 1])!r}) ** 2 / {float(REGIME.variance[i - 1])!r}) / sqrt(2 * pi() * {float(REGIME.variance[i - 1])!r}), 1e-300) AS e{i}")} FROM c_scored WHERE z_score IS NOT NULL""")
part("c_hmm_f", f"""/*recursive*/ SELECT triplet_id, method, t, n, {_each(lambda i: f"e{i}")}, (e1 + e2 + e3) / 3 AS s, {_each(lambda i: f"e{i} / (e1 + e2 + e3) AS a{i}")}, {_each(lambda i: f"ln(1 / 3) + ln(e{i}) AS d{i}")}, [0, 0, 0] AS back FROM c_hmm_x WHERE t = 1 AND n >= 9
  UNION ALL SELECT triplet_id, method, t, n, {_each(lambda i: f"e{i}")}, p1 + p2 + p3, {_each(lambda i: f"p{i} / (p1 + p2 + p3)")}, {_each(lambda j: f"greatest({_each(lambda i: _option(i, j))}) + ln(e{j})")}, [{_each(lambda j: _lowest(*(_option(i, j) for i in _S)))}]
  FROM (SELECT o.*, d1, d2, d3, {_each(lambda j: f"({' + '.join(f'a{i} * {float(_T[i - 1, j - 1])!r}' for i in _S)}) * o.e{j} AS p{j}")} FROM c_hmm_f f JOIN c_hmm_x o ON o.triplet_id = f.triplet_id AND o.method = f.method AND o.t = f.t + 1)""")
part("c_hmm_b", f"""/*recursive*/ SELECT *, {_each(lambda i: f"1.0::DOUBLE AS b{i}")}, {_lowest("d1", "d2", "d3")} AS path FROM c_hmm_f WHERE t = n
  UNION ALL SELECT f.*, {_each(lambda i: f"({' + '.join(f'{float(_T[i - 1, j - 1])!r} * b.e{j} * b.b{j}' for j in _S)}) / b.s")}, b.back[b.path + 1] FROM c_hmm_b b JOIN c_hmm_f f ON f.triplet_id = b.triplet_id AND f.method = b.method AND f.t = b.t - 1""")
part("c_regimes", f"""SELECT triplet_id, method, date, x AS feature_value, {_each(lambda i: f"g{i} AS state_{i - 1}_probability")}, {", ".join(f"g{_N.index(n) + 1} AS {n}_probability" for n in REGIMES)}, top AS most_likely_state, ({_N!r})[top + 1] AS most_likely_regime,
  path AS viterbi_state, ({_N!r})[path + 1] AS viterbi_regime, sum(ln(s)) OVER (PARTITION BY triplet_id, method) AS log_likelihood
  FROM (SELECT *, {_lowest("g1", "g2", "g3")} AS top FROM (SELECT b.*, o.date, o.x, {_each(lambda i: f"a{i} * b{i} / (a1 * b1 + a2 * b2 + a3 * b3) AS g{i}")} FROM c_hmm_b b JOIN c_hmm_x o USING (triplet_id, method, t)))""")

# Features
part("c_market", "SELECT symbol, date, vwap / lag(vwap) OVER (PARTITION BY symbol ORDER BY date) - 1 AS simple_return, log_price, volume FROM c_panel")
part("c_coef", """SELECT triplet_id, 'rolling_ols' AS method, date, beta_1, beta_2 FROM c_ols UNION ALL SELECT triplet_id, 'rolling_ridge', date, beta_1, beta_2 FROM c_ridge""")
part("c_resid_panel", """SELECT triplet_id, method, date, residual, z_score, ch AS residual_change, CASE WHEN count(ch) OVER w >= 5 THEN stddev_samp(ch) OVER w END AS residual_volatility,
  CASE WHEN count(residual) OVER w >= 5 AND stddev_pop(CASE WHEN l IS NOT NULL THEN residual END) OVER p > 0 AND stddev_pop(l) OVER p > 0 THEN covar_pop(residual, l) OVER p / (stddev_pop(CASE WHEN l IS NOT NULL THEN residual END) OVER p * stddev_pop(l) OVER p) END AS residual_autocorrelation,
  CASE WHEN count(residual) OVER w >= 5 AND covar_pop(ch, l) OVER p / nullif(var_pop(l) OVER p, 0) < 0 THEN -ln(2) / (covar_pop(ch, l) OVER p / nullif(var_pop(l) OVER p, 0)) END AS half_life_estimate,
  CASE WHEN count(q) OVER w >= 5 THEN 1 - sum((actual_log_price - fitted_log_price) ** 2) OVER w / nullif(sum(q) OVER w, 0) END AS rolling_r_squared
  FROM (SELECT *, (actual_log_price - my) ** 2 AS q FROM (SELECT *, residual - l AS ch, CASE WHEN count(actual_log_price) OVER w >= 5 THEN avg(actual_log_price) OVER w END AS my
    FROM (SELECT *, lag(residual) OVER (PARTITION BY triplet_id, method ORDER BY date) AS l FROM c_scored) WINDOW w AS (PARTITION BY triplet_id, method ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))
  WINDOW w AS (PARTITION BY triplet_id, method ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS (PARTITION BY triplet_id, method ORDER BY date ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)""")
part("c_coef_panel", """SELECT *, sqrt(beta_1_stability ** 2 + beta_2_stability ** 2) AS beta_stability FROM (SELECT triplet_id, method, date, beta_1, beta_2,
  CASE WHEN count(beta_1) OVER w >= 5 THEN stddev_samp(beta_1) OVER w END AS beta_1_stability, CASE WHEN count(beta_2) OVER w >= 5 THEN stddev_samp(beta_2) OVER w END AS beta_2_stability FROM c_coef
  WINDOW w AS (PARTITION BY triplet_id, method ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
part("c_grid", "SELECT s.symbol, d.date, simple_return, log_price, volume FROM c_symbols s CROSS JOIN (SELECT DISTINCT date FROM c_market) d LEFT JOIN c_market m ON m.symbol = s.symbol AND m.date = d.date")
part("c_symbol_panel", """SELECT symbol, date, rv AS return_volatility, lr AS last_return, CASE WHEN hi <> 0 THEN exp(px - hi) - 1 END AS recent_drawdown, px - ma AS distance_from_moving_average,
  CASE WHEN len(v) >= 2 AND list_aggregate(v[:-2], 'quantile_cont', 0.5) > 0 THEN v[-1] / list_aggregate(v[:-2], 'quantile_cont', 0.5) - 1 END AS volume_shock
  FROM (SELECT symbol, date, CASE WHEN count(simple_return) OVER w >= 2 THEN stddev_samp(simple_return) OVER w END AS rv, last_value(simple_return IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS lr,
    last_value(log_price IGNORE NULLS) OVER w AS px, max(log_price) OVER w AS hi, avg(log_price) OVER w AS ma, list_filter(list(volume) OVER w, lambda x: x IS NOT NULL) AS v FROM c_grid
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
part("c_pair_panel", """SELECT a, b, date, CASE WHEN n >= 3 AND sa > 0 AND sb > 0 THEN c / (sa * sb) END AS correlation, CASE WHEN n >= 5 AND sa > 0 AND sb > 0 THEN c / (sa * sb) END AS rolling FROM (
  SELECT a, b, date, count(CASE WHEN ra + rb IS NOT NULL THEN 1 END) OVER w AS n, covar_pop(ra, rb) OVER w AS c, stddev_pop(CASE WHEN rb IS NOT NULL THEN ra END) OVER w AS sa, stddev_pop(CASE WHEN ra IS NOT NULL THEN rb END) OVER w AS sb
  FROM (SELECT x.symbol AS a, y.symbol AS b, x.date, x.simple_return AS ra, y.simple_return AS rb FROM c_grid x JOIN c_grid y ON x.date = y.date AND x.symbol <> y.symbol)
  WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
part("c_stability", """SELECT target_symbol, hedge_symbol_1, hedge_symbol_2, date, CASE WHEN rn >= 7 AND count(m) OVER w >= 2 THEN stddev_samp(m) OVER w END AS correlation_stability FROM (
  SELECT target_symbol, hedge_symbol_1, hedge_symbol_2, p.date, coalesce((p.rolling + q.rolling) / 2, p.rolling, q.rolling) AS m, row_number() OVER (PARTITION BY target_symbol, hedge_symbol_1, hedge_symbol_2 ORDER BY p.date) AS rn
  FROM c_triplets JOIN c_pair_panel p ON p.a = target_symbol AND p.b = hedge_symbol_1 JOIN c_pair_panel q ON q.a = target_symbol AND q.b = hedge_symbol_2 AND q.date = p.date)
  WINDOW w AS (PARTITION BY target_symbol, hedge_symbol_1, hedge_symbol_2 ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
part("c_market_features", """SELECT e.event_id, t.return_volatility AS target_return_volatility, h.return_volatility AS anchor_1_return_volatility, k.return_volatility AS anchor_2_return_volatility, m.last_return AS market_return, h.last_return AS sector_return,
  p1.correlation AS target_anchor_1_correlation, p2.correlation AS target_anchor_2_correlation, p3.correlation AS anchor_correlation, s.correlation_stability, t.recent_drawdown, t.distance_from_moving_average, t.volume_shock
  FROM c_events e LEFT JOIN c_symbol_panel t ON t.symbol = e.target_symbol AND t.date = e.event_date LEFT JOIN c_symbol_panel h ON h.symbol = e.hedge_symbol_1 AND h.date = e.event_date LEFT JOIN c_symbol_panel k ON k.symbol = e.hedge_symbol_2 AND k.date = e.event_date
  LEFT JOIN c_symbol_panel m ON m.symbol = 'STANDARD' AND m.date = e.event_date LEFT JOIN c_pair_panel p1 ON p1.a = e.target_symbol AND p1.b = e.hedge_symbol_1 AND p1.date = e.event_date LEFT JOIN c_pair_panel p2 ON p2.a = e.target_symbol AND p2.b = e.hedge_symbol_2 AND p2.date = e.event_date
  LEFT JOIN c_pair_panel p3 ON p3.a = e.hedge_symbol_1 AND p3.b = e.hedge_symbol_2 AND p3.date = e.event_date LEFT JOIN c_stability s ON s.target_symbol = e.target_symbol AND s.hedge_symbol_1 = e.hedge_symbol_1 AND s.hedge_symbol_2 = e.hedge_symbol_2 AND s.date = e.event_date""")
part("c_matrix", """SELECT e.event_id, e.triplet_id, e.method, e.event_date, e.target_symbol, e.hedge_symbol_1, e.hedge_symbol_2, e.side, e.entry_z_score, e.entry_abs_z, r.z_score, r.residual, r.residual_change, r.residual_volatility, r.residual_autocorrelation,
  r.half_life_estimate, r.rolling_r_squared, c.beta_1, c.beta_2, c.beta_1_stability, c.beta_2_stability, c.beta_stability, m.* EXCLUDE (event_id), l.label, l.outcome, l.exit_reason, l.holding_period
  FROM c_events e LEFT JOIN c_resid_panel r ON r.triplet_id = e.triplet_id AND r.method = e.method AND r.date = e.event_date LEFT JOIN c_coef_panel c ON c.triplet_id = e.triplet_id AND c.method = e.method AND c.date = e.event_date
  LEFT JOIN c_market_features m ON m.event_id = e.event_id LEFT JOIN c_labels l ON l.event_id = e.event_id""")
# Predictions by a fixed score, and trades
part("c_preds0", """SELECT l.*, 1 / (1 + exp(-(0.4 + 0.9 * (2.5 - l.entry_abs_z) + 0.3 * (e.event_row % 5 - 2)))) AS predicted_reversion_probability, row_number() OVER (ORDER BY l.event_date, l.event_id) AS rn2, count(*) OVER () AS nn FROM c_labels l JOIN c_events e USING (event_id)""")
part("c_preds", """SELECT event_id, triplet_id, method, event_date, CASE WHEN rn2 <= greatest(1, floor(nn * 0.6)) THEN 'train' WHEN rn2 <= least(greatest(greatest(1, floor(nn * 0.6)) + 1, floor(nn * 0.8)), nn - 1) THEN 'validation' ELSE 'test' END AS split,
  predicted_reversion_probability, 0.5 AS classification_threshold, CAST(predicted_reversion_probability >= 0.5 AS INTEGER) AS predicted_label, label FROM c_preds0""")
part("c_traded", """SELECT l.*, p.predicted_reversion_probability, p.split, coalesce(exit_date, l.event_date) AS pnl_date, CASE WHEN side = 'short_spread' THEN entry_z_score - exit_z_score ELSE exit_z_score - entry_z_score END AS spread_pnl_units
  FROM c_labels l JOIN c_preds p USING (event_id) WHERE exit_z_score IS NOT NULL""")
part("c_sized", """SELECT t.*, strategy, CASE WHEN strategy = 'ml_probability_sized' THEN predicted_reversion_probability ELSE 1.0 END AS position_size FROM c_traded t, (SELECT unnest(['baseline_rule_based', 'ml_filtered', 'ml_probability_sized']) AS strategy)
  WHERE strategy = 'baseline_rule_based' OR predicted_reversion_probability > 0.5""")
part("c_trades", "SELECT *, position_size * spread_pnl_units AS gross_pnl, 0.05 * position_size AS transaction_cost, position_size * spread_pnl_units - 0.05 * position_size AS net_pnl, 2 * position_size AS turnover FROM c_sized")


def performance(source: str, keys: str, calendar: str = "") -> str:
    """The performance table over `keys`; Sharpe over the weekdays between the first and last date of `calendar` keys."""
    k = [c.strip() for c in keys.split(",")]
    cal = [c.strip() for c in calendar.split(",")] if calendar else []
    on = lambda a, b, cols: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols) or "true"
    span = f"SELECT {', '.join([*cal, 'min(pnl_date) AS lo', 'max(pnl_date) AS hi'])} FROM {source}" + (f" GROUP BY {', '.join(cal)}" if cal else "")
    return f"""SELECT {', '.join('s.' + c for c in k)}, s.trade_count, s.gross_pnl, s.net_pnl, s.average_net_pnl, s.median_net_pnl, s.win_rate, s.turnover, e.max_drawdown, h.sharpe
  FROM (SELECT {keys}, count(*) AS trade_count, sum(gross_pnl) AS gross_pnl, sum(net_pnl) AS net_pnl, avg(net_pnl) AS average_net_pnl, quantile_cont(net_pnl, 0.5) AS median_net_pnl, avg(CAST(net_pnl > 0 AS INTEGER)) AS win_rate, sum(turnover) AS turnover FROM {source} GROUP BY {keys}) s
  JOIN (SELECT {keys}, min(equity - peak) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY pnl_date ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT {keys}, pnl_date, sum(sum(net_pnl)) OVER (PARTITION BY {keys} ORDER BY pnl_date ROWS UNBOUNDED PRECEDING) AS equity FROM {source} GROUP BY {keys}, pnl_date)) GROUP BY {keys}) e ON {on('e', 's', k)}
  JOIN (SELECT {keys}, CASE WHEN count(*) >= 2 THEN sqrt(252) * avg(p) / nullif(stddev_samp(p), 0) END AS sharpe FROM (SELECT {', '.join('c.' + x for x in k)}, c.d, coalesce(sum(t.net_pnl), 0) AS p
    FROM (SELECT {', '.join('g.' + x for x in k)}, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (SELECT DISTINCT {keys} FROM {source}) g JOIN ({span}) z ON {on('g', 'z', cal)}) c
    LEFT JOIN {source} t ON t.pnl_date = c.d AND {on('t', 'c', k)} WHERE isodow(c.d) < 6 GROUP BY ALL) GROUP BY {keys}) h ON {on('h', 's', k)}"""


PERFORMANCE = "gross_pnl net_pnl average_net_pnl median_net_pnl win_rate turnover max_drawdown sharpe".split()
part("c_perf", performance("c_trades", "strategy"))
part("c_equity", """SELECT *, equity - running_peak AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS running_peak FROM (
  SELECT strategy, pnl_date AS date, sum(net_pnl) AS daily_pnl, sum(sum(net_pnl)) OVER (PARTITION BY strategy ORDER BY pnl_date ROWS UNBOUNDED PRECEDING) AS equity FROM c_trades GROUP BY strategy, pnl_date))""")
part("c_costs", """SELECT * FROM (VALUES ('zero_cost', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('low_cost', 0.005, 0.01, 0.005, 0.0), ('base_cost', 0.01, 0.025, 0.015, 0.0), ('high_cost', 0.02, 0.05, 0.03, 0.0), ('borrow', 0.01, 0.025, 0.015, 2.0))
  t(cost_scenario, commission_per_trade, bid_ask_spread_proxy, slippage, borrow)""")
part("c_repriced", """SELECT cost_scenario, strategy, event_id, pnl_date, position_size, gross_pnl, (commission_per_trade + bid_ask_spread_proxy + slippage + borrow / 1e4 * greatest(0, holding_period)) * position_size AS transaction_cost,
  gross_pnl - (commission_per_trade + bid_ask_spread_proxy + slippage + borrow / 1e4 * greatest(0, holding_period)) * position_size AS net_pnl, turnover FROM c_trades, c_costs""")
part("c_cost_perf", performance("c_repriced", "cost_scenario, strategy", "cost_scenario"))
part("c_rules", """SELECT * FROM (SELECT unnest([1.5, 2.0, 2.5]::DOUBLE[]) AS entry_threshold), (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS exit_threshold), (SELECT unnest([2.75, 3.0, 3.5]::DOUBLE[]) AS stop_loss_level), (SELECT unnest([10, 15, 20]) AS max_holding_period)""")
part("c_ruled", """SELECT *, CAST(good AS INTEGER) AS new_label, CASE WHEN good THEN 'reversion' WHEN stop THEN 'stop_loss' WHEN late THEN 'max_holding' ELSE 'no_reversion' END AS scenario_exit_reason FROM (SELECT *, toward <= exit_threshold AND NOT stop AND NOT late AS good FROM (
  SELECT *, toward >= stop_loss_level AS stop, holding_period > max_holding_period AS late FROM (SELECT t.* EXCLUDE (entry_threshold, max_holding_period), g.*, CASE WHEN side = 'short_spread' THEN exit_z_score ELSE -exit_z_score END AS toward FROM c_traded t, c_rules g WHERE abs(entry_z_score) >= g.entry_threshold)))""")
part("c_ruled_trades", """SELECT *, position_size * spread_pnl_units AS gross_pnl, position_size * spread_pnl_units - 0.05 * position_size AS net_pnl, 2 * position_size AS turnover FROM (SELECT t.*, strategy, CASE WHEN strategy = 'ml_probability_sized' THEN predicted_reversion_probability ELSE 1.0 END AS position_size
  FROM c_ruled t, (SELECT unnest(['baseline_rule_based', 'ml_filtered', 'ml_probability_sized']) AS strategy) WHERE strategy = 'baseline_rule_based' OR predicted_reversion_probability > 0.5)""")
RULE = "entry_threshold, exit_threshold, stop_loss_level, max_holding_period"
part("c_rule_perf", performance("c_ruled_trades", f"{RULE}, strategy", RULE))
