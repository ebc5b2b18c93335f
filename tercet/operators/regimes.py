"""Gaussian hidden Markov models of residual z-scores, and what regimes mean for trades.

A series is worked on in blocks, so that it may be of any length.  What a block of rows does to the state before it is a k x k matrix
of log weights, and blocks one after the other are a product of such matrices: over sums of probabilities for the forward and backward
passes, over maxima for the likeliest path.  Matrices are made block by block, put together in the order of blocks (a few numbers
each), and every block then runs the recursions between the states that it starts from and leads to.  A fit is rounds of this, a
round's sums added up series by series; a series of one block needs no exchange and is fitted where it lies.

Rows without a finite value take no part; series of fewer than three rows a state have no model and give no rows.  Rows of one date
are taken in the order of their values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.functions.expressions import over
from tercet.guards import require, require_columns
from tercet.operators import linear
from tercet.operators.ordered import quantiles, running
from tercet.sources.stages import stored

GROUP = ["triplet_id", "method"]
REGIMES = ("mean_reverting", "trending", "volatile_breakdown")

#: Rows of a series that one task works on.
BLOCK = 1024


@dataclass(frozen=True)
class HMMConfig:
    n_states: int = 3
    max_iter: int = 100
    tolerance: float = 1e-5
    variance_floor: float = 1e-6
    stickiness: float = 0.90

    def __post_init__(self) -> None:
        require(self.n_states > 1 and self.max_iter > 0 and self.tolerance > 0 and self.variance_floor > 0, "HMM settings must be positive")
        require(0 < self.stickiness < 1, "stickiness must be between 0 and 1")


@dataclass
class HMM:
    start: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    log_likelihood: float = float("nan")

    def numbers(self) -> list:
        """As the columns of MODEL."""
        return [self.start.tolist(), self.transition.ravel().tolist(), self.mean.tolist(), self.variance.tolist(), float(self.log_likelihood)]

    @staticmethod
    def read(row) -> HMM:
        k = len(row.start)
        return HMM(np.array(row.start, float), np.array(row.transition, float).reshape(k, k), np.array(row.mean, float), np.array(row.variance, float), row.log_likelihood)


#: Columns of a model.
MODEL = ["start array<double>", "transition array<double>", "mean array<double>", "variance array<double>", "log_likelihood double"]


def emissions(x: np.ndarray, mean: np.ndarray, variance: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Normal densities of values by state, kept off zero."""
    v = np.maximum(variance, floor)
    return np.maximum(np.exp(-0.5 * (x[:, None] - mean) ** 2 / v) / np.sqrt(2 * np.pi * v), 1e-300)


def forward(e: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Scaled forward probabilities, scales, log-likelihood; `start`: probabilities of the first row's state before its value."""
    a, scale = np.empty_like(e), np.empty(len(e))
    for t in range(len(e)):
        row = (start if t == 0 else a[t - 1] @ transition) * e[t]
        scale[t] = max(row.sum(), 1e-300)
        a[t] = row / scale[t]
    return a, scale, float(np.log(scale).sum())


def backward(e: np.ndarray, transition: np.ndarray, scale: np.ndarray, leave: np.ndarray | None = None) -> np.ndarray:
    """Scaled backward probabilities; `leave`: those of the last row, where rows follow it."""
    b = np.ones_like(e)
    if leave is not None:
        b[-1] = leave
    for t in range(len(e) - 2, -1, -1):
        b[t] = transition @ (e[t + 1] * b[t + 1]) / max(scale[t + 1], 1e-300)
    return b


def posterior(e: np.ndarray, m: HMM, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """State probabilities by row, forward and backward probabilities, log-likelihood.

    enter: probabilities of the state before the first row (None: the series begins here); leave: backward ones of the last row."""
    a, scale, ll = forward(e, m.start if enter is None else enter @ m.transition, m.transition)
    b = backward(e, m.transition, scale, leave)
    g = a * b
    return g / np.maximum(g.sum(1, keepdims=True), 1e-300), a, b, ll


def expected(x: np.ndarray, m: HMM, floor: float, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """What rows add to a fit: state weights, sums and squares of the distances to the means, transitions, first row, log-likelihood."""
    e = emissions(x, m.mean, m.variance, floor)
    g, a, b, ll = posterior(e, m, enter, leave)
    before, after = (a[:-1], e[1:] * b[1:]) if enter is None else (np.vstack([enter, a[:-1]]), e * b)
    xi = before[:, :, None] * m.transition * after[:, None, :]
    xi = (xi / np.maximum(xi.sum((1, 2), keepdims=True), 1e-300)).sum(0)
    away = x[:, None] - m.mean
    first = g[0] if enter is None else np.zeros(len(m.mean))
    return np.concatenate([g.sum(0), (g * away).sum(0), (g * away**2).sum(0), xi.ravel(), first, [ll]])


def improved(sums: np.ndarray, mean: np.ndarray, floor: float) -> HMM:
    """The next model of a fit, from the sums over all rows of a series and the means that they are distances to."""
    k = len(mean)
    weight, one, two, xi, first, ll = np.split(sums, np.cumsum([k, k, k, k * k, k]))
    safe = np.maximum(weight, 1e-12)
    centre = (mean * weight + one) / safe
    by = centre - mean
    xi = np.maximum(xi.reshape(k, k), 1e-12)
    return HMM(first / first.sum(), xi / xi.sum(1, keepdims=True), centre, np.maximum((two - 2 * by * one + by**2 * weight) / safe, floor), float(ll[0]))


def sticky(k: int, stickiness: float) -> np.ndarray:
    """Transitions that stay with one probability and leave to all other states alike."""
    return np.where(np.eye(k, dtype=bool), stickiness, (1 - stickiness) / (k - 1))


def spread(k: int) -> list[float]:
    """The quantiles that means start from."""
    return np.linspace(0.15, 0.85, k).tolist()


def fit(x: np.ndarray, config: HMMConfig = HMMConfig()) -> HMM:
    """Baum-Welch from means at spread quantiles and sticky transitions, until the log-likelihood settles."""
    k = config.n_states
    require(len(x) >= 3 * k, "at least three observations per state are required")
    m = HMM(np.full(k, 1 / k), sticky(k, config.stickiness), np.quantile(x, spread(k)), np.full(k, max(x.var(), config.variance_floor)))
    last = None
    for _ in range(config.max_iter):
        m = improved(expected(x, m, config.variance_floor), m.mean, config.variance_floor)
        if last is not None and abs(m.log_likelihood - last) < config.tolerance:
            break
        last = m.log_likelihood
    return m


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-300))


def likeliest(e: np.ndarray, m: HMM, enter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best scores that end in each state of the last row, and for each row and state the best state before it (the lowest of equals).

    enter: the best scores of the states before the first row (None: the series begins here)."""
    lt, le, back = _log(m.transition), _log(e), np.zeros(e.shape, int)
    score = enter
    for t in range(len(e)):
        if score is None:
            score = _log(m.start) + le[t]
            continue
        options = score[:, None] + lt
        back[t] = options.argmax(0)
        score = options.max(0) + le[t]
    return score, back


def traced(back: np.ndarray, end: np.ndarray | int) -> np.ndarray:
    """The states of all rows on the paths to `end`, a state or several."""
    path = np.empty((len(back), *np.shape(end)), int)
    path[-1] = end
    for t in range(len(back) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def viterbi(e: np.ndarray, m: HMM) -> np.ndarray:
    """The likeliest path; ties go to the lowest state."""
    score, back = likeliest(e, m)
    return traced(back, int(score.argmax()))


def element(e: np.ndarray, m: HMM, begins: bool, total: Callable = np.logaddexp.reduce) -> np.ndarray:
    """Log weights from each state before a block's rows to each state of its last row: totals over all ways, or with np.max the best.

    A block that begins a series starts from the states of its first row."""
    steps = _log(m.transition) + _log(e)[:, None, :]
    if begins:
        steps[0] = np.where(np.eye(len(m.start), dtype=bool), _log(e[0]), -np.inf)
    while len(steps) > 1:
        pairs = len(steps) // 2 * 2
        both = total(steps[0:pairs:2, :, :, None] + steps[1:pairs:2, None, :, :], axis=2)
        steps = np.concatenate([both, steps[pairs:]])
    return steps[0]


def chained(start: np.ndarray, elements: list[np.ndarray], best: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], float]:
    """By block: probabilities of the state before it, backward ones of its last row, best scores before it; and the log-likelihood."""
    now, ll, enter, score, scores = _log(start), 0.0, [], _log(start), []
    for forth, top in zip(elements, best, strict=True):
        enter.append(np.exp(now))
        scores.append(score)
        now = np.logaddexp.reduce(now[:, None] + forth, axis=0)
        size = np.logaddexp.reduce(now)
        now, ll = now - size, ll + float(size)
        score = (score[:, None] + top).max(0)
    leave, then = [], np.zeros(len(start))
    for forth in reversed(elements):
        leave.append(np.exp(then))
        then = np.logaddexp.reduce(forth + then, axis=1)
        then = then - then.max()
    return enter, leave[::-1], scores, ll


def regime_labels(mean: np.ndarray, variance: np.ndarray) -> list[str]:
    """Of three states: the most variable breaks down, of the others the one nearest zero reverts; else state_i."""
    names = [f"state_{i}" for i in range(len(mean))]
    if len(mean) != 3:
        return names
    wild = int(np.argmax(variance))
    rest = sorted((i for i in range(3) if i != wild), key=lambda i: (abs(mean[i]), i))
    for i, name in zip((wild, *rest), ("volatile_breakdown", "mean_reverting", "trending"), strict=True):
        names[i] = name
    return names


class _Series:
    """The rows of all series in blocks, a row of arrays each: by columns, block, last (the series' last block), day, x."""

    def __init__(self, df: DataFrame, value: str, config: HMMConfig, by: list[str], block: int):
        require_columns(df, [*by, "date", value])
        require(block > 0, "a block must have rows")
        self.config, self.by = config, by
        self.keys = [f"`{f.name}` {f.dataType.simpleString()}" for c in by for f in df.schema if f.name == c]
        whole = df.where(linear.complete([value])).select(*by, "date", F.col(value).cast("double").alias("x"))
        rows = running(whole, by, ["date", "x"], {"rank": F.lit(1)}, {"total": "rank"}).where(F.col("total") >= 3 * config.n_states)
        cells = rows.select(*by, F.floor((F.col("rank") - 1) / block).alias("block"), F.floor((F.col("total") - 1) / block).alias("last"), F.struct("rank", F.unix_date("date").alias("day"), "x").alias("row"))
        packed = cells.groupBy(*by, "block", "last").agg(F.array_sort(F.collect_list("row")).alias("rows"))
        self.blocks = stored(packed.select(*by, "block", "last", F.col("rows.day").alias("day"), F.col("rows.x").alias("x")))

    def _beside(self, left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
        """`left` with the row of `right` of the same series (and `more`), nulls being a series, too."""
        on = [*self.by, *more]
        named = right.withColumnsRenamed({c: f"__{c}" for c in on})
        return left.join(named, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on)), how).drop(*(f"__{c}" for c in on))

    def _each(self, df: DataFrame, build: Callable, columns: list[str]) -> DataFrame:
        """by columns and what `build` makes of every row."""
        by, schema = self.by, [*self.keys, *columns]
        names = [*by, *(c.split()[0] for c in columns)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                made = ([*key, *build(row)] for key, row in zip(pdf[by].itertuples(index=False, name=None), pdf.drop(columns=by).itertuples(index=False), strict=True))
                yield pd.DataFrame(made, columns=names)

        return df.mapInPandas(run, ", ".join(schema))

    def _chain(self, df: DataFrame, build: Callable, columns: list[str]) -> DataFrame:
        """by columns and the rows that `build` makes of each series' blocks in their order."""
        by, schema = self.by, [*self.keys, *columns]
        names = [*by, *(c.split()[0] for c in columns)]

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[*key, *row] for row in build(pdf.sort_values("block", ignore_index=True))], columns=names)

        return df.groupBy(*by).applyInPandas(run, ", ".join(schema))

    def given(self, model: HMM) -> DataFrame:
        """`model` for every series."""
        start, transition, mean, variance, ll = model.numbers()
        arrays = {"start": start, "transition": transition, "mean": mean, "variance": variance}
        return self.blocks.where("block = 0").select(*self.by, *(F.array(*map(F.lit, v)).alias(c) for c, v in arrays.items()), F.lit(ll).alias("log_likelihood"))

    def fitted(self) -> DataFrame:
        """by columns and MODEL, a row a series."""
        config = self.config
        short = self._each(self.blocks.where("last = 0"), lambda r: fit(np.array(r.x), config).numbers(), MODEL)
        long = self.blocks.where("last > 0")
        return short if long.isEmpty() else stored(short.unionByName(self._rounds(long)))

    def _rounds(self, long: DataFrame) -> DataFrame:
        """Models of series of several blocks; each round starts at a stage table, so nothing is done again after a loss."""
        config, k = self.config, self.config.n_states
        values = long.select(*self.by, F.explode("x").alias("x"))
        at = {f"q{i}": q for i, q in enumerate(spread(k))}
        wide = values.groupBy(*self.by).agg(F.greatest(F.var_pop("x"), F.lit(config.variance_floor)).alias("wide"))
        begin = self._beside(quantiles(values, self.by, "x", at), wide)
        same = lambda v: F.array(*(F.lit(float(p)) for p in np.ravel(v)))
        none = F.lit(None).cast("double")
        now = stored(begin.select(*self.by, same(np.full(k, 1 / k)).alias("start"), same(sticky(k, config.stickiness)).alias("transition"), F.array(*at).alias("mean"), F.array_repeat("wide", k).alias("variance"), none.alias("log_likelihood"), F.lit(False).alias("settled")))
        for _ in range(config.max_iter):
            now = stored(self._round(long, now.where("not settled")).unionByName(now.where("settled")))
            if now.where("not settled").isEmpty():
                break
        return now.drop("settled")

    def _round(self, long: DataFrame, models: DataFrame) -> DataFrame:
        config = self.config
        both = self._beside(long, models)

        def added(r) -> list:
            m = HMM.read(r)
            got = expected(np.array(r.x), m, config.variance_floor, None if r.block == 0 else np.array(r.enter), np.array(r.leave))
            return [r.block, got.tolist(), m.mean.tolist(), r.log_likelihood]

        def next_model(pdf: pd.DataFrame) -> Iterator[list]:
            m = improved(np.sum(np.array(pdf["sums"].tolist()), axis=0), np.array(pdf["mean"].iloc[0]), config.variance_floor)
            last = pdf["before"].iloc[0]
            yield [*m.numbers(), bool(pd.notna(last) and abs(m.log_likelihood - last) < config.tolerance)]

        ends = self._ends(both)
        sums = self._each(self._beside(both, ends.select(*self.by, "block", "enter", "leave"), "block"), added, ["block long", "sums array<double>", "mean array<double>", "before double"])
        return self._chain(sums, next_model, [*MODEL, "settled boolean"])

    def _ends(self, both: DataFrame) -> DataFrame:
        """by columns, block, enter, leave, score, total: what each block stands between, and the series' log-likelihood."""
        floor = self.config.variance_floor

        def made(r) -> list:
            m = HMM.read(r)
            e = emissions(np.array(r.x), m.mean, m.variance, floor)
            return [r.block, m.start.tolist(), element(e, m, r.block == 0).ravel().tolist(), element(e, m, r.block == 0, np.max).ravel().tolist()]

        def joined(pdf: pd.DataFrame) -> Iterator[list]:
            start = np.array(pdf["start"].iloc[0])
            square = lambda c: [np.array(v).reshape(len(start), -1) for v in pdf[c]]
            enter, leave, scores, ll = chained(start, square("forth"), square("best"))
            for b, *arrays in zip(pdf["block"], enter, leave, scores, strict=True):
                yield [b, *(v.tolist() for v in arrays), ll]

        parts = self._each(both, made, ["block long", "start array<double>", "forth array<double>", "best array<double>"])
        return self._chain(parts, joined, ["block long", "enter array<double>", "leave array<double>", "score array<double>", "total double"])

    def decoded(self, models: DataFrame) -> DataFrame:
        """by columns, day, x, p0 and on, names, top, path and log_likelihood of every row."""
        by, k, floor = self.by, self.config.n_states, self.config.variance_floor
        both = self._beside(self.blocks, models)
        ends = stored(self._ends(both.where("last > 0")))

        def entered(r) -> list:
            m = HMM.read(r)
            score, back = likeliest(emissions(np.array(r.x), m.mean, m.variance, floor), m, None if r.block == 0 else np.array(r.score))
            return [r.block, back[0][traced(back, np.arange(k))[0]].tolist(), int(score.argmax())]

        def ended(pdf: pd.DataFrame) -> list:
            end, out = int(pdf["highest"].iloc[-1]), []
            for b, entry in zip(pdf["block"][::-1], pdf["entry"][::-1], strict=True):
                out.append([b, end])
                end = int(entry[end])
            return out

        def rows(r) -> list:
            m, x = HMM.read(r), np.array(r.x)
            e = emissions(x, m.mean, m.variance, floor)
            alone = r.leave is None
            g, _, _, ll = posterior(e, m, None if r.block == 0 else np.array(r.enter), None if alone else np.array(r.leave))
            score, back = likeliest(e, m, None if r.block == 0 else np.array(r.score))
            path = traced(back, int(score.argmax() if alone else r.end))
            return [r.day, x, *g.T, g.argmax(1), path, regime_labels(m.mean, m.variance), ll if alone else r.total]

        states = [f"p{i}" for i in range(k)]
        entries = self._each(self._beside(both, ends, "block"), entered, ["block long", "entry array<int>", "highest int"])
        last = self._chain(entries, ended, ["block long", "end int"])
        full = self._beside(self._beside(both, ends, "block", how="left"), last, "block", how="left")
        columns = ["day array<int>", "x array<double>", *(f"{p} array<double>" for p in states), "top array<int>", "path array<int>", "names array<string>", "ll double"]
        arrays = self._each(full, rows, columns)
        each = F.explode(F.arrays_zip("day", "x", *states, "top", "path")).alias("row")
        return arrays.select(*by, "names", F.col("ll").alias("log_likelihood"), each).select(*by, "names", "log_likelihood", "row.*")


def regime_probabilities(df: DataFrame, value: str = "z_score", config: HMMConfig = HMMConfig(), by: list[str] | None = None, model: HMM | None = None, block: int = BLOCK) -> DataFrame:
    """by columns, date, feature_value, state probabilities, the probability of each named regime, the likeliest regime
    by row and on the Viterbi path, log_likelihood.  by=['triplet_id'] mixes methods, as one series by date.

    model: parameters for all series (None: each series' own fit); `block` rows of a series to a task."""
    by = by or GROUP
    require(model is None or len(model.mean) == config.n_states, "the model must have n_states states")
    series = _Series(df, value, config, by, block)
    got = series.decoded(series.given(model) if model is not None else stored(series.fitted()))
    states = [f"p{i}" for i in range(config.n_states)]
    place = lambda name: F.array_position("names", name)
    named = [F.when(place(n) > 0, F.get(F.array(*states), (place(n) - 1).cast("int"))).alias(f"{n}_probability") for n in REGIMES]
    name = lambda c: F.get("names", F.col(c))
    return got.select(
        *by, F.date_from_unix_date("day").alias("date"), F.col("x").alias("feature_value"), *(F.col(p).alias(f"state_{i}_probability") for i, p in enumerate(states)), *named, F.col("top").alias("most_likely_state"),
        name("top").alias("most_likely_regime"), F.col("path").alias("viterbi_state"), name("path").alias("viterbi_regime"), "log_likelihood",
    )


def regime_parameters(df: DataFrame, value: str = "z_score", config: HMMConfig = HMMConfig(), by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """by columns, state, regime_label, mean, variance, start_probability, transition_to_state_i, log_likelihood."""
    by = by or GROUP
    k = config.n_states
    series = _Series(df, value, config, by, block)
    named = series._each(series.fitted(), lambda r: [*HMM.read(r).numbers(), regime_labels(np.array(r.mean), np.array(r.variance))], [*MODEL, "names array<string>"])
    at = lambda c: F.get(c, F.col("state"))
    return named.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        *by, "state", at("names").alias("regime_label"), at("mean").alias("mean"), at("variance").alias("variance"), at("start").alias("start_probability"),
        *(F.get("transition", F.col("state") * k + i).alias(f"transition_to_state_{i}") for i in range(k)), "log_likelihood",
    )


def trade_filter(events: DataFrame, regimes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Events with their day's mean_reverting_probability and allowed_by_regime_filter; unknown days are not allowed."""
    keys = ["triplet_id"] + (["method"] if "method" in regimes.columns and "method" in events.columns else [])
    day = regimes.select(*keys, F.col("date").alias("event_date"), "mean_reverting_probability", "most_likely_regime", "viterbi_regime")
    got = events.join(day, [*keys, "event_date"], "left")
    return got.withColumn("allowed_by_regime_filter", F.coalesce(F.col("mean_reverting_probability") > threshold, F.lit(False)))


def performance_by_regime(trades: DataFrame, threshold: float = 0.6) -> DataFrame:
    """strategy, regime_bucket (above or below the threshold), counts, rates and PnL."""
    bucket = F.when(F.coalesce(F.col("mean_reverting_probability") > threshold, F.lit(False)), "above_threshold").otherwise("below_threshold")
    return trades.withColumn("regime_bucket", bucket).groupBy("strategy", "regime_bucket").agg(
        F.count("*").alias("trade_count"), F.avg("mean_reverting_probability").alias("average_mean_reverting_probability"), over(F.sum("label"), F.count("label")).alias("success_rate"),
        F.sum("net_pnl").alias("net_pnl"), F.avg("net_pnl").alias("average_net_pnl"), F.sum("turnover").alias("turnover"), F.lit(threshold).alias("regime_probability_threshold"),
    )
