"""Running sums in an order, without a task that has a whole group: the base of ranks, curves and exact quantiles.

Rows are dealt by ranges of (group, order), whose bounds Spark samples; sums run within each range, and the sums of a group's
earlier ranges, a row for each, are added.  A group may hold any share of the rows, since a range does not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.sources.stages import stored


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """`df` with each of `sums` summed over the rows of the same `by` up to and with this one, in `order`.

    Rows that are equal in `order` come one after another, in any sequence.  totals: new column by name of a sum, the sum over the
    whole group.  Nulls in `by` are a group; null summands count as 0.
    """
    own = df.withColumns({f"__own_{k}": F.coalesce(c, F.lit(0)) for k, c in sums.items()})
    dealt = stored(own.repartitionByRange(*by, *order).withColumn("__piece", F.spark_partition_id()))
    pieces = dealt.groupBy(*by, "__piece").agg(*(F.sum(f"__own_{k}").alias(f"__sum_{k}") for k in sums))
    group = by or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__piece").alias("__at"), *(F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums),
                          *(F.sum(f"__sum_{k}").over(Window.partitionBy(*group)).alias(name) for name, k in (totals or {}).items()))
    inside = Window.partitionBy(*by, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = dealt.withColumns({f"__in_{k}": F.sum(f"__own_{k}").over(inside) for k in sums})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__piece") == F.col("__at"))
    return got.join(parts, same).select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"__in_{k}") + F.col(f"__before_{k}")).alias(k) for k in sums), *(totals or {}))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by columns and the exact quantile of `value` for each name of `shares`, between neighbours in proportion to their distance.

    Equal to Spark's percentile(); nulls do not count, and groups without values have nulls.  Values are counted before they are
    ordered; of each group only the neighbours of its quantiles go on, two rows each at most.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = running(per, by, ["__v"], {"__upto": F.col("__n")}, {"__all": "__upto"})
    at = {k: (F.col("__all") - 1) * F.lit(float(q)) for k, q in shares.items()}
    holds = lambda place: (F.col("__upto") - F.col("__n") <= place) & (place < F.col("__upto"))
    low, high = ({k: F.max(F.when(holds(f(p)), F.col("__v"))) for k, p in at.items()} for f in (F.floor, F.ceil))
    near = reduce(lambda a, b: a | b, [holds(f(p)) for p in at.values() for f in (F.floor, F.ceil)])
    got = placed.where(near).groupBy(*by).agg(*(low[k].alias(f"__low_{k}") for k in shares), *(high[k].alias(f"__high_{k}") for k in shares), F.max("__all").alias("__all"))
    share = {k: at[k] - F.floor(at[k]) for k in shares}
    out = got.select(*by, *((F.col(f"__low_{k}") * (1 - share[k]) + F.col(f"__high_{k}") * share[k]).alias(k) for k in shares))
    if not by:
        return out.agg(*(F.max(k).alias(k) for k in shares))  # a row also where there are no values
    keys = df.select(*by).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by])
    return keys.join(out.select(*(F.col(c).alias(f"__by_{c}") for c in by), *shares), same, "left").select(*by, *shares)


def carried(df: DataFrame, by: list[str], order: list[str], what: str, out: str) -> DataFrame:
    """`df` with `out`: the last value of `what` that is not null in rows of the same `by` up to and with this one, in `order`.

    As in running(), no task holds a group: a range adds the last value of a group's earlier ranges.
    """
    dealt = stored(df.repartitionByRange(*by, *order).withColumn("__piece", F.spark_partition_id()))
    there = F.when(F.col(what).isNotNull(), F.struct(*order))
    pieces = dealt.groupBy(*by, "__piece").agg(F.max_by(what, there).alias("__last"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__piece").alias("__at"), F.last("__last", True).over(before).alias("__before"))
    inside = Window.partitionBy(*by, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = dealt.withColumn("__in", F.last(what, True).over(inside))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__piece") == F.col("__at"))
    return got.join(parts, same).select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce("__in", "__before").alias(out))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, columns: list[str], within: str | None = None) -> DataFrame:
    """`left` with `columns` of the last row of `right` with the same `by` that is not later than it, and its time as `as_of`.

    Times may be dates or timestamps, on either side.  Of rows of `right` at one time the greatest by `columns` counts; rows without
    a time are seen by none and see none; nulls in `by` are a key.  within: an interval ('7 days'), beyond which nothing is seen.
    """
    clock = lambda c: F.col(f"`{c}`").cast("timestamp")
    seen = F.struct(F.col(f"`{right_time}`").alias("as_of"), *(F.col(f"`{c}`") for c in columns))
    rows = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    ours = left.select(*by, clock(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__seen"), rows.alias("__row"))
    theirs = right.where(F.col(right_time).isNotNull()).select(*by, clock(right_time).alias("__t"), F.lit(0).alias("__side"), seen.alias("__seen"), F.lit(None).alias("__row"))
    both = theirs.unionByName(ours)
    got = carried(both, by, ["__t", "__side", "__seen"], "__seen", "__found").where("__side = 1")
    near = F.col("__t").isNotNull()
    if within is not None:
        near = near & (F.col("__found.as_of").cast("timestamp") >= F.col("__t") - F.expr(f"INTERVAL {within}"))
    found = F.when(near, F.col("__found"))
    return got.select("__row.*", found.alias("__found")).select(*(F.col(f"`{c}`") for c in left.columns), "__found.*")
