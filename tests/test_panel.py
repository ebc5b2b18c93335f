"""The weekly panel does not depend on the order of order lines, and is right to the last digits."""

import numpy as np

from tercet.sources import panel


def test_weekly_panel_in_any_order_of_lines(spark, sf, tmp_path):
    line, part = panel.table(spark, sf, "lineitem"), panel.table(spark, sf, "part")
    got = []
    for k, order in enumerate(("l_orderkey, l_linenumber", "l_extendedprice", "l_extendedprice desc")):
        line.orderBy(*(panel.F.expr(c.split()[0]).desc() if "desc" in c else panel.F.expr(c) for c in order.split(", "))).coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        part.write.parquet(f"{tmp_path}/{k}/part.parquet")
        got.append(sorted(map(tuple, panel.weekly_panel(spark, f"{tmp_path}/{k}").collect())))
    assert got[0] and got[0] == got[1] == got[2]

    cents = line.join(part, line.l_partkey == part.p_partkey).groupBy(panel.F.col("p_type").alias("symbol"), panel.F.to_date(panel.F.date_trunc("week", "l_shipdate")).alias("date"))
    sums = cents.agg(panel.F.sum(panel.F.round(panel.F.col("l_extendedprice") * 100).cast("long")), panel.F.sum(panel.F.col("l_quantity").cast("long"))).collect()
    for symbol in {r[0] for r in sums}:
        rows = sorted((r[1], r[2], r[3]) for r in sums if r[0] == symbol)
        logs = np.log(np.array([np.longdouble(c) / 100 / np.longdouble(q) for _, c, q in rows]))
        want = 4 + np.cumsum(logs - logs.mean())
        mine = [r[4] for r in got[0] if r[0] == symbol]
        assert len(mine) == len(want) and np.abs(np.array(mine) - want).max() < 4e-14


def test_split_for_sums_holds_odd_values(spark):
    whole, rest = panel.split_for_sums("x")
    values = [0.1, -2.7, 1e300, float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", (whole + rest).alias("y")).collect()
    assert all(r.x == r.y for r in rows)
