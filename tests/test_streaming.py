"""The stream of crossings against the batch operators."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tercet.operators import residuals
from tercet.streaming.residuals import crossings


def test_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=90)
    rows = [(t, "m", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float(v) * (1 + (t == "b"))) for t in ("a", "b") for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "triplet_id string, method string, ts timestamp, residual double")
    for lo in range(0, 90, 30):
        frame.where((F.dayofyear("ts") > lo) & (F.dayofyear("ts") <= lo + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = crossings(stream, 20, 10, delay="365 days").writeStream.format("memory").queryName("crossings_out").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.triplet_id, r.ts): r.z_score for r in spark.table("crossings_out").collect()}
    want = residuals.z_score(frame, 20, 10, order="ts").collect()
    assert len(got) == len(want) == 180
    for r in want:
        z = got[r.triplet_id, r.ts]
        assert (z is None) == (r.z_score is None) and (z is None or abs(z - r.z_score) < 1e-9)


def test_stream_in_any_order_equals_batch(spark, tmp_path):
    """With waiting, rows that come within the delay, micro-batch by micro-batch in disorder, give the batch results."""
    x = np.random.default_rng(4).normal(size=120)
    rows = [("a", "m", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float(v), (k // 10) * 10 + (k * 7) % 23) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "triplet_id string, method string, ts timestamp, residual double, arrival int")
    for n, lo in enumerate(range(0, 150, 15)):
        part = frame.where((F.col("arrival") >= lo) & (F.col("arrival") < lo + 15)).drop("arrival")
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    data = spark.read.parquet(str(tmp_path / "in")).drop("n")
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = crossings(stream, 20, 10, delay="40 days", wait=True).writeStream.format("memory").queryName("crossings_waited").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.ts: r.z_score for r in spark.table("crossings_waited").collect()}
    want = {r.ts: r.z_score for r in residuals.z_score(frame, 20, 10, order="ts").collect()}
    assert len(got) > 60  # the last ones wait for a watermark that never comes
    for ts, z in got.items():
        assert (z is None) == (want[ts] is None) and (z is None or abs(z - want[ts]) < 1e-9)
