"""Typed stores against what a small table by key would hold."""

import datetime as dt
import os

import pytest

from tercet.sources import typed

SPECS = {
    "parts": typed.Spec({"part": "string", "weight": "double"}, ("part",)),
    "stock": typed.Spec({"part": "string", "day": "date", "count": "int", "share": "double"}, ("part", "day"), ("count",), {"part": "parts"}, {"count": (0, None), "share": (0.0, 1.0)}),
}
DAY = "2024-01-01"


@pytest.fixture()
def catalog(spark):
    c = typed.TypedCatalog(spark, f"typed_test_{os.getpid()}", SPECS)
    yield c
    for t in c.tables():
        spark.sql(f"DROP TABLE {c.database}.{t}")
    spark.sql(f"DROP DATABASE {c.database}")


def outcomes(df):
    return {r.outcome: r.rows for r in df.collect()}


def test_merge(spark, catalog):
    assert outcomes(catalog.merge(spark.createDataFrame([("a", 1.5), ("b", None), (None, 2.0)], "part string, weight double"), "parts")) == {"added": 2, "replaced": 0, "missing part": 1}
    rows = [("a", DAY, "3", 0.5, 1), ("a", "2024-01-02", "4", None, 1), ("b", DAY, "x", 0.5, 1), ("b", "soon", "3", 0.5, 1), ("b", DAY, "-1", 0.5, 1), ("b", DAY, "1", 1.5, 1), ("b", DAY, "1", float("nan"), 1), ("z", DAY, "1", 0.5, 1), ("b", "2024-01-03", None, 0.5, 1), ("b", "2024-01-05", "1", 0.1, 1), ("b", "2024-01-05", "2", 0.1, 1)]
    schema = "part string, day string, count string, share double, other int"
    assert outcomes(catalog.merge(spark.createDataFrame(rows, schema), "stock")) == {"added": 2, "replaced": 0, "type count": 1, "type day": 1, "range count": 1, "range share": 2, "reference part": 1, "missing count": 1, "repeated key": 2}
    assert catalog.table("stock").dtypes == [("part", "string"), ("day", "date"), ("count", "int"), ("share", "double")]
    again = spark.createDataFrame([("a", DAY, 9), ("b", DAY, 7)], "part string, day string, count long")
    assert outcomes(catalog.merge(again, "stock")) == {"added": 1, "replaced": 1}
    held = {(r.part, r.day.isoformat()): (r["count"], r.share) for r in catalog.table("stock").collect()}
    assert held == {("a", DAY): (9, None), ("a", "2024-01-02"): (4, None), ("b", DAY): (7, None)}
    assert outcomes(catalog.merge(again.limit(0), "stock")) == {"added": 0, "replaced": 0} and catalog.table("stock").count() == 3
    assert catalog.tables() == ["parts", "stock"]


def test_specs():
    assert all(other in typed.SPECS and len(typed.SPECS[other].key) == 1 for s in typed.SPECS.values() for other in s.references.values())
    with pytest.raises(ValueError, match="not columns"):
        typed.Spec({"a": "int"}, ("b",))
    with pytest.raises(ValueError, match="key"):
        typed.Spec({"a": "int"}, ())
    assert dt.date.fromisoformat(DAY)
