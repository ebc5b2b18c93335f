"""Checks on inputs.  Missing columns and bad parameters fail when a plan is made; values are checked while it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MissingColumns(KeyError):
    """A frame lacks columns that an operator needs."""


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...] | set[str]) -> DataFrame:
    """`df`, if it has all `columns`."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return df


def require(condition: bool, message: str) -> None:
    """A ValueError unless `condition` holds."""
    if not condition:
        raise ValueError(message)


def assert_rows(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """`df`; running it fails with `message` at a row where `condition` is not true."""
    first = df.columns[0]
    checked = F.when(F.coalesce(condition, F.lit(False)), F.col(f"`{first}`")).otherwise(F.raise_error(F.lit(message)).cast(df.schema[0].dataType))
    return df.select(checked.alias(first), *(F.col(f"`{c}`") for c in df.columns[1:]))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df`; running it fails at a null, NaN or infinite value in `columns`."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return assert_rows(df, ok, f"values of {columns} must be finite")


def probabilities(df: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """`df`; labels must be 0 or 1, probabilities from 0 to 1, the threshold between 0 and 1."""
    require(0.0 < threshold < 1.0, "threshold must be between 0 and 1")
    return assert_rows(df, F.col(label).isin(0, 1) & F.col(probability).between(0.0, 1.0), "labels must be 0 or 1 and probabilities within [0, 1]")
