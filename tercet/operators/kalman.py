"""Hedge ratios that follow a random walk, by a Kalman filter over each triplet's complete rows.

A series is filtered in blocks, so that it may be of any length.  What a block of rows does to any state before it is one element
of an associative operation; elements are made block by block, put together in the order of blocks (a few numbers each), and then
every block runs the recursion from the state that it starts with.  A series of one block takes the last step only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.guards import require, require_columns
from tercet.operators import linear
from tercet.operators.hedges import KEYS
from tercet.operators.ordered import running
from tercet.operators.residuals import compare_stability


@dataclass(frozen=True)
class KalmanConfig:
    """process_noise: a number, three of them, or a 3 x 3 matrix; initial_window None starts without a fit."""

    process_noise: float | tuple = 1e-5
    measurement_noise: float = 1e-4
    initial_covariance: float = 1.0
    initial_window: int | None = None

    def __post_init__(self) -> None:
        require(self.measurement_noise > 0, "measurement_noise must be positive")
        require(self.initial_covariance > 0, "initial_covariance must be positive")
        require(self.initial_window is None or self.initial_window > 2, "initial_window must exceed the number of hedges")
        noise_matrix(self.process_noise)


def noise_matrix(noise) -> np.ndarray:
    """Process noise as a 3 x 3 matrix."""
    a = np.asarray(noise, float)
    require(bool((np.diag(a) if a.ndim == 2 else a).min() >= 0), "process noise must not be negative")
    require(a.shape in ((), (3,), (3, 3)), "process noise must be a number, 3 numbers or a 3 x 3 matrix")
    return np.eye(3) * a if a.ndim == 0 else np.diag(a) if a.ndim == 1 else a


def predict(state: np.ndarray, covariance: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A random walk's next state and covariance."""
    return state.copy(), covariance + noise


def update(state: np.ndarray, covariance: np.ndarray, y: float, h: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, float, float, np.ndarray]:
    """Filtered state and covariance (Joseph form), innovation, its variance, gain."""
    require(r > 0, "measurement noise must be positive")
    innovation = y - h @ state
    ph = covariance @ h
    s = float(h @ ph + r)
    gain = ph / s
    keep = np.eye(len(state)) - np.outer(gain, h)
    p = keep @ covariance @ keep.T + r * np.outer(gain, gain)
    return state + gain * innovation, (p + p.T) / 2, float(innovation), s, gain


NUMBERS = ["alpha", "beta_1", "beta_2", "predicted_alpha", "predicted_beta_1", "predicted_beta_2", "actual_log_price", "fitted_log_price", "residual", "residual_variance", "kalman_gain_alpha", "kalman_gain_beta_1", "kalman_gain_beta_2", "state_cov_trace"]
STATES = [*KEYS, "date", "method", *NUMBERS[:6], *NUMBERS[10:], "process_noise", "measurement_noise", "initial_window"]
RESIDUALS = [*KEYS, "date", "method", *NUMBERS[6:10], "process_noise", "measurement_noise", "initial_window"]


def run_filter(y: np.ndarray, x: np.ndarray, config: KalmanConfig, state: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """NUMBERS of every row, from the state before the first."""
    q, out = noise_matrix(config.process_noise), []
    for t in range(len(y)):
        h = np.array([1.0, *x[t]])
        before, covariance = predict(state, covariance, q)
        state, covariance, innovation, s, gain = update(before, covariance, y[t], h, config.measurement_noise)
        out.append([*state, *before, y[t], h @ before, innovation, s, *gain, np.trace(covariance)])
    return np.array(out).reshape(-1, len(NUMBERS))


@dataclass(frozen=True)
class Element:
    """What rows do to the state before them: given that state, the one after them is normal with mean a @ state + b and covariance
    c; and the rows' own likelihood of that state has information vector eta and matrix j."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    eta: np.ndarray
    j: np.ndarray

    @staticmethod
    def of(y: float, h: np.ndarray, q: np.ndarray, r: float) -> Element:
        """One row."""
        s = float(h @ q @ h + r)
        gain = q @ h / s
        keep = np.eye(len(h)) - np.outer(gain, h)
        return Element(keep, gain * y, keep @ q, h * y / s, np.outer(h, h) / s)

    def then(self, later: Element) -> Element:
        """These rows, and then those of `later`."""
        one = np.eye(len(self.b))
        forth = np.linalg.solve((one + self.c @ later.j).T, later.a.T).T
        back = np.linalg.solve((one + later.j @ self.c).T, self.a).T
        return Element(forth @ self.a, forth @ (self.b + self.c @ later.eta) + later.b, forth @ self.c @ later.a.T + later.c, back @ (later.eta - later.j @ self.b) + self.eta, back @ later.j @ self.a + self.j)

    def after(self, state: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after these rows, from the one before them."""
        forth = np.linalg.solve((np.eye(len(state)) + covariance @ self.j).T, self.a.T).T
        c = forth @ covariance @ self.a.T + self.c
        return forth @ (state + covariance @ self.eta) + self.b, (c + c.T) / 2

    def numbers(self) -> list[float]:
        return np.concatenate([v.ravel() for v in (self.a, self.b, self.c, self.eta, self.j)]).tolist()

    @staticmethod
    def read(v: np.ndarray) -> Element:
        a, b, c, eta, j = np.split(np.asarray(v, float), [9, 12, 21, 24])
        return Element(a.reshape(3, 3), b, c.reshape(3, 3), eta, j.reshape(3, 3))


def element(y: np.ndarray, x: np.ndarray, config: KalmanConfig) -> Element:
    """All rows of a block."""
    q = noise_matrix(config.process_noise)
    steps = (Element.of(y[t], np.array([1.0, *x[t]]), q, config.measurement_noise) for t in range(len(y)))
    return reduce(Element.then, steps)


#: Rows of a series that one task filters.
BLOCK = 4096


def _starts(rows: DataFrame, config: KalmanConfig, initial_state: tuple | None) -> DataFrame:
    """triplet_id, state: what each series starts with: given, a fit of its first rows, or the first target alone."""
    if initial_state is not None:
        return rows.where("rank = 1").select("triplet_id", F.array(*(F.lit(float(v)) for v in initial_state)).alias("state"))
    alone = rows.where("rank = 1").select("triplet_id", F.array("y", F.lit(0.0), F.lit(0.0)).alias("alone"))
    if config.initial_window is None:
        return alone.withColumnRenamed("alone", "state")
    first = rows.where((F.col("rank") <= config.initial_window) & (F.col("total") > config.initial_window))
    fits = linear.fit(first, ["triplet_id"], ["x1", "x2"]).select("triplet_id", F.concat(F.array("intercept"), "coefficients").alias("fit"))
    return alone.join(fits, "triplet_id", "left").select("triplet_id", F.coalesce("fit", "alone").alias("state"))


def kalman_regression(obs: DataFrame, config: KalmanConfig = KalmanConfig(), initial_state: tuple | None = None, block: int = BLOCK) -> DataFrame:
    """KEYS, date, method, NUMBERS and the settings for every filtered row of every triplet; `block` rows to a task."""
    require_columns(obs, [*KEYS, "date", "y", "x1", "x2"])
    whole = obs.where(linear.complete(["y", "x1", "x2"])).select(*KEYS, "date", "y", "x1", "x2")
    rows = running(whole, ["triplet_id"], ["date"], {"rank": F.lit(1)}, {"total": "rank"})
    skip = F.lit(0) if initial_state is not None or config.initial_window is None else F.when(F.col("total") > config.initial_window, config.initial_window).otherwise(0)
    rows = rows.withColumn("at", F.col("rank") - 1 - skip)
    starts = _starts(rows, config, initial_state)
    rows = rows.where("at >= 0").withColumn("block", F.floor(F.col("at") / block)).withColumn("last", F.floor((F.col("total") - skip - 1) / block))

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        got = element(pdf["y"].to_numpy(float), pdf[["x1", "x2"]].to_numpy(float), config)
        return pd.DataFrame([(pdf["triplet_id"].iloc[0], pdf["block"].iloc[0], got.numbers())], columns=["triplet_id", "block", "element"])

    def chained(starts: pd.DataFrame, elements: pd.DataFrame) -> pd.DataFrame:
        out = []
        for triplet, state in zip(starts["triplet_id"], starts["state"], strict=True):
            now = np.array(state, float), np.eye(3) * config.initial_covariance
            out.append((triplet, 0, now[0].tolist(), now[1].ravel().tolist()))
            for k, v in elements.sort_values("block")[["block", "element"]].itertuples(index=False):
                now = Element.read(v).after(*now)
                out.append((triplet, int(k) + 1, now[0].tolist(), now[1].ravel().tolist()))
        return pd.DataFrame(out, columns=["triplet_id", "block", "state", "covariance"])

    def filtered(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[*KEYS, "date", *NUMBERS])
        pdf = pdf.sort_values("at", ignore_index=True)
        state, covariance = np.array(start["state"].iloc[0], float), np.array(start["covariance"].iloc[0], float).reshape(3, 3)
        numbers = run_filter(pdf["y"].to_numpy(float), pdf[["x1", "x2"]].to_numpy(float), config, state, covariance)
        return pd.concat([pdf[[*KEYS, "date"]], pd.DataFrame(numbers, columns=NUMBERS)], axis=1)

    elements = rows.where("block < last").select("triplet_id", "block", "at", "y", "x1", "x2").groupBy("triplet_id", "block").applyInPandas(composed, "triplet_id string, block long, element array<double>")
    states = starts.groupBy("triplet_id").cogroup(elements.groupBy("triplet_id")).applyInPandas(chained, "triplet_id string, block long, state array<double>, covariance array<double>")
    schema = ", ".join([*(f"{k} string" for k in KEYS), "date date", *(f"{c} double" for c in NUMBERS)])
    got = rows.select(*KEYS, "date", "block", "at", "y", "x1", "x2").groupBy("triplet_id", "block").cogroup(states.groupBy("triplet_id", "block")).applyInPandas(filtered, schema)
    noise = float(np.diag(noise_matrix(config.process_noise)).mean())
    return got.select("*", F.lit("kalman_random_walk").alias("method"), F.lit(noise).alias("process_noise"), F.lit(config.measurement_noise).alias("measurement_noise"), F.lit(config.initial_window).cast("int").alias("initial_window"))


def states_and_residuals(filtered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables that filtered rows are stored as."""
    return filtered.select(*STATES), filtered.select(*RESIDUALS)


def compare_with_rolling(filtered: DataFrame, rolling: DataFrame) -> DataFrame:
    """Residual summaries of the filter beside those of rolling OLS and ridge."""
    both = filtered.select(*KEYS, "date", "method", "residual").unionByName(rolling.where("method in ('rolling_ols', 'rolling_ridge')").select(*KEYS, "date", "method", "residual"))
    return compare_stability(both)
