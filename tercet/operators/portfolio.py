"""Equity, calendar-correct Sharpe ratios, drawdowns, confidence intervals, sizing, clusters and benchmarks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.functions.expressions import null_if_nan, over, wilson
from tercet.guards import require, require_columns
from tercet.operators.ordered import running
from tercet.sources.stages import dealt, stored


def equity_curve(trades: DataFrame, by: list[str] | None = None, date: str = "pnl_date", pnl: str = "net_pnl") -> DataFrame:
    """by columns (default strategy), date, daily_pnl, equity, running_peak (from the first equity on), drawdown."""
    by = by or ["strategy"]
    daily = require_columns(trades, [*by, date, pnl]).groupBy(*by, F.col(date).alias("date")).agg(F.sum(pnl).alias("daily_pnl"))
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    got = daily.withColumn("equity", F.sum("daily_pnl").over(w)).withColumn("running_peak", F.max("equity").over(w))
    return got.withColumn("drawdown", F.col("equity") - F.col("running_peak"))


def sharpe(mean: Column, std: Column, n: Column, periods: int = 252) -> Column:
    """The annualised ratio; null with fewer than two values or no spread."""
    return F.when(n >= 2, over(mean * math.sqrt(periods), std))


def _path_summary(trades: DataFrame, by: list[str], calendar_by: list[str] | None, date: str, pnl: str = "net_pnl", periods: int = 252) -> DataFrame:
    """by columns, max_drawdown, sharpe: both from one daily aggregate.

    The calendar is all weekdays from the first to the last date of its group, with 0 on days without trades.  Sums and
    squares over days with trades suffice, as the other days add zeros: no calendar rows are made.
    """
    # weekdays between two dates, both included: from whole weeks and the rest
    upto = lambda d: (F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.least(F.lit(5), F.pmod(F.datediff(d, F.lit("1970-01-05").cast("date")), F.lit(7)) + 1)).cast("long")
    p = F.when(F.weekday("date") < 5, F.col("daily_pnl"))
    per = equity_curve(trades, by, date, pnl).groupBy(*by).agg(
        F.min("drawdown").alias("max_drawdown"), F.coalesce(F.sum(p), F.lit(0.0)).alias("__s"), F.coalesce(F.sum(p * p), F.lit(0.0)).alias("__q"), F.min("date").alias("__lo"), F.max("date").alias("__hi")
    )
    group = Window.partitionBy(*(calendar_by or [F.lit(0)]))  # rows are groups of trades by now, as many as strategies and scenarios
    n = upto(F.max("__hi").over(group)) - upto(F.date_sub(F.min("__lo").over(group), 1))
    per = per.withColumn("__n", n)
    mean = over("__s", "__n")
    std = F.sqrt(F.greatest(F.lit(0.0), over(F.col("__q") - F.col("__n") * mean * mean, F.col("__n") - 1)))
    return per.select(*by, "max_drawdown", sharpe(mean, std, F.col("__n"), periods).alias("sharpe"))


def calendar_pnl(trades: DataFrame, by: list[str] | None = None, date: str = "pnl_date", pnl: str = "net_pnl") -> DataFrame:
    """by columns, date, daily_pnl: every weekday from the first to the last date of all trades, 0 without trades."""
    by = by or ["strategy"]
    daily = trades.groupBy(*by, F.col(date).alias("date")).agg(F.sum(pnl).alias("daily_pnl"))
    span = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = daily.select(*by).distinct().crossJoin(F.broadcast(span)).select(*by, F.explode(F.sequence("lo", "hi")).alias("date")).where(F.weekday("date") < 5)  # span is one row
    return days.join(daily, [*by, "date"], "left").select(*by, "date", F.coalesce("daily_pnl", F.lit(0.0)).alias("daily_pnl"))


def calendar_sharpe(trades: DataFrame, by: list[str], calendar_by: list[str] | None = None, date: str = "pnl_date", pnl: str = "net_pnl", periods: int = 252) -> DataFrame:
    """by columns and sharpe over all weekdays from the first to the last date of the calendar's group, 0 on days
    without trades; results dated on weekends do not count."""
    return _path_summary(trades, by, calendar_by, date, pnl, periods).drop("max_drawdown")


def performance(trades: DataFrame, by: list[str] | None = None, calendar_by: list[str] | None = None, date: str = "pnl_date") -> DataFrame:
    """by columns, trade_count, gross_pnl, net_pnl, average_net_pnl, median_net_pnl, win_rate, turnover, max_drawdown, sharpe."""
    by = by or ["strategy"]
    net = F.col("net_pnl")
    s = trades.groupBy(*by).agg(
        F.count("*").alias("trade_count"), F.sum("gross_pnl").alias("gross_pnl"), F.sum(net).alias("net_pnl"), F.avg(net).alias("average_net_pnl"), F.percentile(net, F.lit(0.5)).alias("median_net_pnl"),
        F.avg((net > 0).cast("int")).alias("win_rate"), F.sum("turnover").alias("turnover"),
    )
    return s.join(_path_summary(trades, by, calendar_by, date), by, "left")


def daily_table(trades: DataFrame) -> DataFrame:
    """date, strategy, gross_pnl, transaction_cost, net_pnl, turnover, equity, running_peak, drawdown."""
    sums = trades.groupBy("strategy", F.col("pnl_date").alias("date")).agg(*(F.sum(c).alias(c) for c in ("gross_pnl", "transaction_cost", "net_pnl", "turnover")))
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    got = sums.withColumn("equity", F.sum("net_pnl").over(w)).withColumn("running_peak", F.max("equity").over(w))
    return got.withColumn("drawdown", F.col("equity") - F.col("running_peak"))


def performance_table(trades: DataFrame, model_run_id: str | None = None) -> DataFrame:
    """performance() with total_net_pnl, the run, and the first and last date of each strategy."""
    period = trades.groupBy("strategy").agg(F.min("pnl_date").alias("period_start"), F.max("pnl_date").alias("period_end"))
    got = performance(trades).join(period, "strategy").withColumn("model_run_id", F.lit(model_run_id).cast("string"))
    return got.withColumn("total_net_pnl", F.col("net_pnl"))


def confidence_table(trades: DataFrame, confidence: float = 0.90, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """strategy, metric, method, point_estimate, ci_low, ci_high, confidence, n_trades: Wilson's interval of the win rate
    and the bootstrap interval of the mean."""
    w = wilson_intervals(trades, confidence=confidence)
    b = bootstrap_interval(trades, "mean_pnl", resamples, confidence, seed)
    out = lambda metric, method, rate: [F.lit(metric).alias("metric"), F.lit(method).alias("method"), F.col(rate).alias("point_estimate"), "ci_low", "ci_high", F.lit(confidence).alias("confidence"), F.col("n").alias("n_trades")]
    return w.select("strategy", *out("win_rate", "wilson_score", "rate")).union(b.select("strategy", *out("mean_pnl", "percentile_bootstrap", "estimate")))


def ordered(summary: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows in the given order of strategies, others after them by name."""
    place = F.coalesce(*(F.when(F.col("strategy") == s, F.lit(k)) for k, s in enumerate(order)), F.lit(len(order)))
    return summary.orderBy(place, "strategy")


def wilson_intervals(trades: DataFrame, by: list[str] | None = None, confidence: float = 0.90) -> DataFrame:
    """by columns, successes, n, rate, ci_low, ci_high, confidence of the share of winning trades."""
    by = by or ["strategy"]
    g = trades.groupBy(*by).agg(F.count_if(F.col("net_pnl") > 0).alias("successes"), F.count("*").alias("n"))
    low, high = wilson("successes", "n", confidence)
    return g.select(*by, "successes", "n", over("successes", "n").alias("rate"), low.alias("ci_low"), high.alias("ci_high"), F.lit(confidence).alias("confidence"))


def draws(rows: DataFrame, by: list[str], resamples: int, seed: int, count: Column, size: Column) -> DataFrame:
    """by, resample, draw, at: `count` whole numbers from 0 to `size` - 1 for each resample of each row of `rows`.

    A draw is a number of its own: 32 bits of the MD5 of seed, resample and draw, so that any task, and any other engine, makes the
    same ones.  One MD5 gives four draws.  Resamples are dealt out before they are drawn: few rows become many.
    """
    each = rows.select(*by, count.alias("count"), size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    each = dealt(each.where("count > 0"), *by, "resample").withColumn("four", F.explode(F.expr("sequence(0L, floor((count - 1) / 4))")))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("resample").cast("string"), F.col("four").cast("string")).cast("binary"))
    each = each.withColumn("digest", digest).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    bits = F.conv(F.substring(F.col("digest"), F.col("k") * 8 + 1, F.lit(8)), 16, 10).cast("double")
    got = each.select(*by, "resample", (F.col("four") * 4 + F.col("k")).alias("draw"), "count", F.floor(bits / 4294967296.0 * F.col("size")).alias("at"))
    return got.where("draw < count").drop("count")


def bootstrap_interval(trades: DataFrame, metric: str = "mean_pnl", resamples: int = 2000, confidence: float = 0.90, seed: int = 0, by: str = "strategy", pnl: str = "net_pnl", order: list[str] | None = None) -> DataFrame:
    """by, metric, estimate, ci_low, ci_high, n: trades of each group, resampled one by one, as many as it has; see draws().

    Metrics are win_rate and mean_pnl.  Trades are numbered in ranges and joined to the draws of their numbers; no task holds a
    group.  Numbered trades are a stage table: Spark knows its size, and where it is small draws are summed where they are made.
    Groups with fewer than two trades have no interval.
    """
    require(metric in ("win_rate", "mean_pnl"), "metric must be win_rate or mean_pnl")
    keys = [c for c in (order or ["pnl_date", "event_id"]) if c in trades.columns]
    value = F.when(F.col(pnl) > 0, 1.0).otherwise(0.0) if metric == "win_rate" else F.col(pnl)
    values = trades.where(null_if_nan(pnl).isNotNull()).select(by, value.alias("x"), *keys)
    numbered = stored(running(values, [by], keys or ["x"], {"rank": F.lit(1)}).select(by, (F.col("rank") - 1).alias("at"), "x"))
    totals = numbered.groupBy(by).agg(F.avg("x").alias("estimate"), F.count("*").alias("n"))
    drawn = draws(totals.where("n > 1"), [by], resamples, seed, F.col("n"), F.col("n"))
    picked = drawn.join(numbered, [by, "at"], "left")  # every number is there; Spark takes draws for few, and would broadcast them
    means = picked.groupBy(by, "resample").agg(F.avg("x").alias("mean"))
    return _with_interval(totals, means, "mean", metric, confidence, by)


def _with_interval(totals: DataFrame, values: DataFrame, value: str, metric: str, confidence: float, by: str) -> DataFrame:
    """The percentile interval of `value` beside each group's estimate; there are as many values as resamples."""
    tail = (1 - confidence) / 2
    ends = values.groupBy(by).agg(F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("ends"))
    got = totals.join(ends, by, "left")
    return got.select(by, F.lit(metric).alias("metric"), "estimate", F.col("ends")[0].alias("ci_low"), F.col("ends")[1].alias("ci_high"), "n")


_NOTHING = "named_struct('s', 0D, 'q', 0D, 'top', cast('-Infinity' AS double), 'low', cast('Infinity' AS double), 'fall', 0D)"


def _summed(values: str) -> str:
    """SQL: of an array of daily results its sum, sum of squares, highest and lowest point of the running sum, and deepest fall."""
    top = "greatest(a.top, a.s + x)"
    step = f"named_struct('s', a.s + x, 'q', a.q + x * x, 'top', {top}, 'low', least(a.low, a.s + x), 'fall', least(a.fall, a.s + x - {top}))"
    return f"aggregate({values}, {_NOTHING}, (a, x) -> {step})"


def _joined(parts: str) -> str:
    """SQL: the same of stretches put one after another."""
    step = "named_struct('s', a.s + b.s, 'q', a.q + b.q, 'top', greatest(a.top, a.s + b.top), 'low', least(a.low, a.s + b.low), 'fall', least(a.fall, b.fall, a.s + b.low - a.top))"
    return f"aggregate({parts}, {_NOTHING}, (a, b) -> {step})"


def block_bootstrap_interval(daily: DataFrame, metric: str = "max_drawdown", block: int = 20, resamples: int = 1000, confidence: float = 0.90, seed: int = 0, by: str = "strategy") -> DataFrame:
    """As bootstrap_interval(), of a path of daily_pnl resampled in moving blocks; null for paths shorter than a block or 10.

    Metrics are max_drawdown (from the first equity on) and the annualised sharpe.  A stretch of days is known by five numbers,
    which put together give those of a path: a resample is as many rows as it has blocks, and its days are never laid out.  The
    last block of a path is cut to the path's length.
    """
    require(metric in ("max_drawdown", "sharpe"), "metric must be max_drawdown or sharpe")
    days = daily.where(null_if_nan("daily_pnl").isNotNull()).select(by, "date", F.col("daily_pnl").alias("x"))
    days = running(days, [by], ["date"], {"rank": F.lit(1)}, {"n": "rank"}).select(by, (F.col("rank") - 1).alias("at"), "x", "n")
    pieces = F.ceil(F.col("n") / block)
    ahead = Window.partitionBy(by).orderBy("at").rowsBetween(0, block - 1)
    held = days.withColumn("xs", F.collect_list("x").over(ahead)).withColumn("part", (F.col("n") - (pieces - 1) * block).cast("int"))
    held = stored(held.select(by, "at", "n", F.expr(_summed("xs")).alias("whole"), F.expr(_summed("slice(xs, 1, part)")).alias("cut")))
    lengths = held.groupBy(by).agg(F.max("n").alias("n")).withColumn("pieces", pieces)
    drawn = draws(lengths.where(F.col("n") >= max(10, block)), [by], resamples, seed, F.col("pieces"), F.col("n") - block + 1).select(by, "resample", "draw", "at")
    itself = lengths.select(by, F.lit(-1).alias("resample"), F.explode(F.expr("sequence(0L, pieces - 1)")).alias("draw")).select("*", (F.col("draw") * block).alias("at"))
    last = F.ceil(F.col("n") / block) - 1
    rows = drawn.unionByName(itself).join(held, [by, "at"]).select(by, "resample", "n", "draw", F.when(F.col("draw") == last, F.col("cut")).otherwise(F.col("whole")).alias("p"))
    paths = rows.groupBy(by, "resample", "n").agg(F.expr(_joined("transform(array_sort(collect_list(struct(draw, p))), y -> y.p)")).alias("p"))
    variance = (F.col("p.q") - F.col("p.s") * F.col("p.s") / F.col("n")) / (F.col("n") - 1)
    sharpe = F.when((F.col("n") > 1) & (variance > 1e-14 * F.col("p.q") / F.col("n")), math.sqrt(252) * F.col("p.s") / F.col("n") / F.sqrt(variance))
    paths = stored(paths.select(by, "resample", "n", (F.col("p.fall") if metric == "max_drawdown" else sharpe).alias("value")))
    estimate = paths.where("resample = -1").select(by, F.when(F.col("n") > 1, F.col("value")).alias("estimate"), "n")
    return _with_interval(estimate, paths.where("resample >= 0"), "value", metric, confidence, by)


def volatility_target(volatility: Column | str, target: float = 0.02, cap: float = 3.0, floor: float = 1e-6) -> Column:
    """target / volatility, from 0 to `cap`."""
    v = F.col(volatility) if isinstance(volatility, str) else volatility
    return F.least(F.lit(cap), F.greatest(F.lit(0.0), F.lit(target) / F.greatest(v, F.lit(floor))))


def apply_volatility_targeting(trades: DataFrame, volatility: str, target: float = 0.02, cost: float = 0.05, cap: float = 3.0) -> DataFrame:
    """Trades resized and repriced."""
    got = trades.withColumn("position_size", volatility_target(volatility, target, cap)).withColumn("gross_pnl", F.col("position_size") * F.col("spread_pnl_units"))
    got = got.withColumn("transaction_cost", cost * F.abs("position_size")).withColumn("net_pnl", F.col("gross_pnl") - F.col("transaction_cost"))
    return got.withColumn("turnover", 2 * F.abs("position_size"))


def buy_and_hold(prices: DataFrame, value: str = "adj_close") -> DataFrame:
    """date, daily_return, cumulative_return of equal weights in the symbols that have a return on a date."""
    r = over(value, F.lag(value).over(Window.partitionBy("symbol").orderBy("date"))) - 1
    daily = prices.withColumn("__r", r).where("__r is not null").groupBy("date").agg(F.avg("__r").alias("daily_return"), F.lit(0).alias("__one"))
    w = Window.partitionBy("__one").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    return daily.select("date", "daily_return", (F.exp(F.sum(F.log1p("daily_return")).over(w)) - 1).alias("cumulative_return"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: the least node that each node of `edges` (a, b) reaches; an edge from a node to itself makes it a node.

    Each round every node takes the least root next to it, roots pass on the least that theirs have seen, and all jump to their
    root's root: rounds grow with the logarithm of a chain's length.  An error, not a wrong result, where `most` do not suffice.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    for _ in range(most):
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        seen = label.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("least"))
        hooks = seen.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("hook"))
        hooked = stored(seen.join(hooks, F.col("root") == F.col("r")).select("node", F.col("root").alias("was"), F.least("least", "hook").alias("root")))
        up = hooked.select(F.col("node").alias("r"), F.col("root").alias("further"))
        label = stored(hooked.join(up, F.col("root") == F.col("r")).select("node", "was", F.least("root", "further").alias("root")))
        if label.where("root <> was").isEmpty():
            return label.select("node", "root")
        label = label.select("node", "root")
    raise RuntimeError("components did not settle")


def shared_leg_clusters(triplets: DataFrame) -> DataFrame:
    """cluster_id (from 0, by least member), triplets, cluster_size, shared_legs, independent_bet.

    Triplets that share a hedge leg are one cluster, also through others: the components of the legs, of which there are as many
    as symbols, with an edge between the legs of a triplet.  Legs shared by all members are listed, or all legs where none is; a
    cluster of one lists none.  Ids with fewer than three parts are left out.
    """
    parts = F.split("triplet_id", "_")
    t = triplets.select("triplet_id").distinct().where(F.size(parts) >= 3)
    held = t.select("triplet_id", F.array_distinct(F.slice(parts, 2, 1000)).alias("own"))
    legs = stored(held.select("triplet_id", F.explode("own").alias("leg"), F.array_min("own").alias("least")))
    roots = components(legs.select(F.col("least").alias("a"), F.col("leg").alias("b")).distinct())
    joined = legs.where("leg = least").join(roots, F.col("leg") == F.col("node"))
    first = joined.groupBy("root").agg(F.min("triplet_id").alias("c"))
    label = stored(joined.join(first, "root").select("triplet_id", "c"))
    sizes = label.groupBy("c").agg(F.count("*").alias("cluster_size"), F.array_sort(F.collect_list("triplet_id")).alias("triplets"))
    by_leg = legs.join(label, "triplet_id").groupBy("c", "leg").agg(F.count_distinct("triplet_id").alias("k")).join(sizes.select("c", "cluster_size"), "c")
    both = by_leg.groupBy("c").agg(F.array_sort(F.collect_list(F.when(F.col("k") == F.col("cluster_size"), F.col("leg")))).alias("shared"), F.array_sort(F.collect_list("leg")).alias("legs"))
    got = sizes.join(both, "c").withColumn("one", F.lit(0))
    chosen = F.when(F.col("cluster_size") == 1, F.array().cast("array<string>")).when(F.size("shared") > 0, F.col("shared")).otherwise(F.col("legs"))
    return got.select((F.row_number().over(Window.partitionBy("one").orderBy("c")) - 1).alias("cluster_id"), "triplets", "cluster_size", chosen.alias("shared_legs"), (F.col("cluster_size") == 1).alias("independent_bet"))
