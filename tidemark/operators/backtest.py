"""Rebalanced strategies as plans without loops.

Between two rebalances units are fixed, so a strategy's growth since the last one is the weighted sum of its assets'
price ratios to that day's close; its value is the product of the growth of all finished stretches and of the running
one. All strategies are one plan, with the strategy in every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config

def by():
    return W.partitionBy("strategy").orderBy("date")


#: Days of a block of a strategy's dates.
BLOCK_DAYS = 365


def block() -> Column:
    return F.floor(F.unix_date("date") / BLOCK_DAYS)


def month_end_dates(dates: DataFrame) -> DataFrame:
    """Dates that are the last day of their calendar month; months whose last day isn't there are skipped."""
    return dates.select("date").distinct().filter(F.last_day("date") == F.col("date"))


def previous_dates(dates: DataFrame) -> DataFrame:
    """The last date there is in each calendar month."""
    return dates.groupBy(F.trunc("date", "MM").alias("_month")).agg(F.max("date").alias("date")).select("date")


def normalised(weights: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Weights of known assets made to sum to one; strategies without a positive sum go."""
    known = weights.join(prices.select("asset").distinct(), "asset", "left_semi")
    total = F.sum("weight").over(W.partitionBy(*keys))
    return known.withColumn("_total", total).filter("_total > 0").withColumn("weight", F.col("weight") / F.col("_total")).drop("_total")


def segments(dates: DataFrame, names: DataFrame, rebalances: DataFrame) -> DataFrame:
    """strategy, start, end, opening: a row for each stretch between rebalances. A stretch holds the dates after its start
    up to its end; the opening one holds its start, the first date, too. Rebalances at other dates are left out."""
    marks = rebalances.select(*(c for c in ("strategy", "date") if c in rebalances.columns)).distinct().join(dates, "date", "left_semi")
    marks = marks.join(names, "strategy", "left_semi") if "strategy" in marks.columns else marks.crossJoin(names)
    span = dates.agg(F.min("date").alias("start"), F.max("date").alias("_last"))
    opening = names.crossJoin(F.broadcast(span)).withColumn("opening", F.lit(True))  # one row
    starts = opening.unionByName(marks.select("strategy", F.col("date").alias("start"), F.lit(False).alias("opening")), allowMissingColumns=True)
    of = W.partitionBy("strategy")  # a row a rebalance
    end = F.coalesce(F.lead("start").over(of.orderBy("start", F.desc("opening"))), F.max("_last").over(of))
    return starts.select("strategy", "start", end.alias("end"), "opening")


def rebalanced(prices: DataFrame, weights: DataFrame, rebalances: DataFrame, initial: float = config.INITIAL_INVESTMENT, ruin: float = 0.01) -> DataFrame:
    """strategy, date, value and ret. weights: strategy, asset, weight and, where they change, date: those of a date hold
    from its close (the first date's also before). rebalances: date, or strategy and date. From the date on which the
    value is at most ruin of the initial one, later values are zero. Prices must be positive at every date.

    A stretch meets its dates by the months that it spans, the day before comes from the asset's own series, and losses are
    followed within blocks of time and from one row a block: no strategy's dates are sorted in one task."""
    dates = prices.select("date").distinct()
    spans = segments(dates, weights.select("strategy").distinct(), rebalances)
    held = weights.withColumnRenamed("date", "start")
    base = prices.select(F.col("date").alias("start"), "asset", F.col("price").alias("base"))
    units = spans.join(held, [c for c in ("strategy", "start") if c in held.columns]).join(base, ["start", "asset"])
    units = units.withColumn("_month", F.explode(F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("interval 1 month"))))
    own = W.partitionBy("asset").orderBy("date")
    paths = prices.select("date", "asset", "price", F.lag("price").over(own).alias("was"), F.lag("date").over(own).alias("day_before"), F.trunc("date", "MM").cast("date").alias("_month"))
    inside = (F.col("date") > F.col("start")) | (F.col("opening") & (F.col("date") == F.col("start")))
    grown = units.join(paths, ["asset", "_month"]).filter(inside & (F.col("date") <= F.col("end")))
    growth = grown.groupBy("strategy", "start", "opening", "date").agg(
        F.sum(F.col("weight") * F.col("price") / F.col("base")).alias("growth"), F.sum(F.col("weight") * F.col("was") / F.col("base")).alias("before"), F.max("day_before").alias("day_before")
    )
    # at a rebalance's close the units are bought anew: the next day grows from one
    new = ~F.col("opening") & (F.col("day_before") == F.col("start"))
    growth = growth.withColumn("before", F.when(new, 1.0).otherwise(F.col("before"))).withColumn("_block", block())
    at = ["strategy", "start", "opening", "_block"]
    blocks = growth.groupBy(*at).agg(F.max_by("growth", "date").alias("_end"), F.min("growth").alias("_low"), F.min("before").alias("_low_before"))
    order = W.partitionBy("strategy").orderBy("start", F.desc("opening"), "_block")  # a row a stretch and block
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    following = F.lead(F.struct("start", "opening")).over(order)
    blocks = blocks.withColumn("_end", F.when(F.coalesce(following != F.struct("start", "opening"), F.lit(True)), F.col("_end")))
    blocks = blocks.withColumn("done", F.coalesce(F.product("_end").over(earlier), F.lit(1.0)))
    least, least_before = F.min(F.col("done") * F.col("_low")).over(earlier), F.min(F.col("done") * F.col("_low_before")).over(earlier)
    carried = blocks.select(*at, "done", least.alias("_least"), least_before.alias("_least_before"))
    within = W.partitionBy(*at).orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    valued = growth.withColumns({"_low": F.min("growth").over(within), "_low_before": F.min("before").over(within)}).join(carried, at)
    over, was_over = (F.coalesce(F.least(f"_least{k}", F.col("done") * F.col(f"_low{k}")) <= ruin, F.lit(False)) for k in ("", "_before"))
    change = F.when(was_over | ~(F.coalesce("before", F.lit(0.0)) > 0), 0.0).when(over, -1.0).otherwise(F.col("growth") / F.col("before") - 1)
    value = F.when(over, 0.0).otherwise(initial * F.col("done") * F.col("growth"))
    return valued.select("strategy", "date", value.alias("value"), change.alias("ret"))


def highest(values: DataFrame, column: str, name: str) -> DataFrame:
    """values with the greatest value of column up to each date: within blocks of time, and from one row a block of those
    before."""
    blocks = values.withColumn("_block", block())
    within = W.partitionBy("strategy", "_block").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("strategy").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    tops = blocks.groupBy("strategy", "_block").agg(F.max(column).alias("_top"))
    carried = tops.select("strategy", "_block", F.max("_top").over(before).alias("_carried"))
    return blocks.withColumn("_own", F.max(column).over(within)).join(carried, ["strategy", "_block"]).withColumn(name, F.greatest("_own", "_carried")).drop("_block", "_own", "_carried")


def backtest_metrics(values: DataFrame, rf: float = config.RISK_FREE_RATE) -> DataFrame:
    """total_return, annual_return (over calendar years, a tenth at least), annual_vol, sharpe, max_drawdown, final_value.

    Blocks of time are summed up alone and merged, a row a block: in a block the level falls either from a peak of its own
    or from the greatest level before it, and the lowest point of both is known from the block's lowest level."""
    within = W.partitionBy("strategy", "_block").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    levels = values.withColumn("_block", block()).withColumn("_level", F.product(1 + F.col("ret")).over(within))
    levels = levels.withColumn("_dd", F.try_divide("_level", F.max("_level").over(within)) - 1)
    blocks = levels.groupBy("strategy", "_block").agg(
        F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"), F.min("date").alias("d0"), F.max("date").alias("d1"),
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.var_pop("ret").alias("spread"),
        F.max_by("_level", "date").alias("whole"), F.max("_level").alias("top"), F.min("_level").alias("low"), F.min("_dd").alias("dd"),
    )
    all_of, before = W.partitionBy("strategy"), W.partitionBy("strategy").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    merged = blocks.withColumns({"_start": F.coalesce(F.product("whole").over(before), F.lit(1.0)), "_mean": F.sum(F.col("n") * F.col("mean")).over(all_of) / F.sum("n").over(all_of)})
    merged = merged.withColumn("_peak", F.max(F.col("_start") * F.col("top")).over(before))
    fall = F.least("dd", F.try_divide(F.col("_start") * F.col("low"), F.col("_peak")) - 1)
    spread = F.sum(F.col("n") * (F.col("spread") + F.pow(F.col("mean") - F.col("_mean"), 2)))
    base = merged.groupBy("strategy").agg(
        F.min_by("first", "d0").alias("first"), F.max_by("last", "d1").alias("final_value"), F.datediff(F.max("d1"), F.min("d0")).alias("days"),
        F.sqrt(252.0 * F.try_divide(spread, F.nullif(F.sum("n") - 1, F.lit(0)))).alias("annual_vol"), F.min(fall).alias("max_drawdown"),
    )
    total = F.col("final_value") / F.col("first") - 1
    years = F.greatest(F.col("days") / config.CALENDAR_DAYS, F.lit(0.1))
    annual = F.pow(1 + total, 1 / years) - 1
    return base.select("strategy", total.alias("total_return"), annual.alias("annual_return"), "annual_vol", F.try_divide(annual - rf, F.col("annual_vol")).alias("sharpe"), "max_drawdown", "final_value")


def rolling_metrics(values: DataFrame, rows: int = 252) -> DataFrame:
    """date, strategy and rolling yearly return, volatility and their ratio over full windows."""
    w = by().rowsBetween(1 - rows, 0)
    full = F.count("ret").over(w) == rows
    rolled = values.withColumns({"rolling_return": F.when(full, F.avg("ret").over(w) * 252), "rolling_vol": F.when(full, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252.0)))})
    return rolled.filter("rolling_vol IS NOT NULL").select("strategy", "date", "rolling_return", "rolling_vol", F.try_divide("rolling_return", "rolling_vol").alias("rolling_sharpe"))


def growth_of_one(values: DataFrame) -> DataFrame:
    first = values.groupBy("strategy").agg(F.min_by("value", "date").alias("_first"))
    return values.join(first, "strategy").select("strategy", "date", F.try_divide("value", "_first").alias("growth"))


def strategy_drawdowns(values: DataFrame) -> DataFrame:
    return highest(values, "value", "_top").select("strategy", "date", (F.try_divide("value", "_top") - 1).alias("drawdown"))


def monthly_heatmap(values: DataFrame) -> DataFrame:
    """strategy, year and a column a month (m1 to m12) of compounded returns."""
    months = values.withColumn("_month", F.month("date")).groupBy("strategy", F.year("date").alias("year")).pivot("_month", list(range(1, 13))).agg(F.product(1 + F.col("ret")) - 1)
    return months.select("strategy", "year", *(F.col(str(m)).alias(f"m{m}") for m in range(1, 13)))


def allocation_shares(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """strategy, date, asset, share of value for units bought once at the first date."""
    first = prices.groupBy("asset").agg(F.min_by("price", "date").alias("p0"))
    values = prices.join(first, "asset").join(weights, "asset").withColumn("value", F.col("weight") * F.col("price") / F.col("p0"))
    return values.select("strategy", "date", "asset", F.try_divide("value", F.sum("value").over(W.partitionBy("strategy", "date"))).alias("share"))


def momentum_weights(returns: DataFrame, rebalances: DataFrame, rows: int = 126, top: int = 3) -> DataFrame:
    """strategy momentum, date, asset, weight: at each rebalance date the top assets by mean return over the rows before
    it, equal parts; with a shorter history all assets."""
    w = W.partitionBy("asset").orderBy("date").rowsBetween(-rows, -1)
    past = returns.withColumns({"mean": F.avg("ret").over(w), "n": F.count("ret").over(w)}).join(rebalances.select("date"), "date", "left_semi")
    place = F.row_number().over(W.partitionBy("date").orderBy(F.desc_nulls_last("mean"), "asset"))
    chosen = past.withColumn("place", place).filter((F.col("n") < rows) | (F.col("place") <= top))
    return chosen.select(F.lit("momentum").alias("strategy"), "date", "asset", (F.lit(1.0) / F.count("*").over(W.partitionBy("date"))).alias("weight"))


def callback_weights(returns: DataFrame, rebalances: DataFrame, fn, rows: int = 252, strategy: str = "callback") -> DataFrame:
    """strategy, date, asset, weight from fn(history, date) -> {asset: weight}, where history is the wide frame of the
    rows before a rebalance date. Each date is a group of its own, bounded by rows and assets."""
    import pandas as pd

    dates = returns.select("date").distinct().withColumn("i", F.row_number().over(W.orderBy("date")))  # a row a date
    numbered = returns.join(dates, "date")
    # a return belongs to the windows of the next rows rebalance dates: an equi-join on the date's number, exploded
    marks = dates.join(rebalances.select("date"), "date", "left_semi").select(F.col("date").alias("at"), F.explode(F.sequence(F.greatest(F.col("i") - rows, F.lit(1)), F.col("i") - 1)).alias("i"))
    windows = numbered.join(marks.filter("i > 0"), "i").select("at", "date", "asset", "ret")

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["at"].iloc[0]
        got = fn(pdf.pivot(index="date", columns="asset", values="ret").sort_index(), at) or {}
        total = sum(got.values())
        rows_ = [(strategy, at, k, v / total) for k, v in sorted(got.items())] if total > 0 else []
        return pd.DataFrame(rows_, columns=["strategy", "date", "asset", "weight"])

    return windows.groupBy("at").applyInPandas(call, "strategy string, date date, asset string, weight double")


def as_of(left: DataFrame, right: DataFrame, key: str = "strategy", value: str = "weight", days: int = 30) -> DataFrame:
    """left (key, date) with the last value of right (key, date, value) at or before each date; a null value of right
    changes nothing.

    Time is cut into buckets of days. Rows are sorted within key and bucket only, so one key is shared by as many tasks
    as it has buckets; what a bucket starts with is carried on from the last of each bucket before, a row a bucket."""
    both = left.select(key, "date").withColumn("_left", F.lit(1)).unionByName(right.select(key, "date", value), allowMissingColumns=True)
    both = both.withColumn("_bucket", F.floor(F.unix_date("date") / days))
    within = W.partitionBy(key, "_bucket").orderBy("date", F.col("_left").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    lasts = both.groupBy(key, "_bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date"))).alias("_own"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # a row a bucket
    carried = lasts.select(key, "_bucket", F.last("_own", True).over(before).alias("_carried"))
    found = both.withColumn("_last", F.last(value, True).over(within)).filter("_left = 1").join(carried, [key, "_bucket"])
    return found.select(key, "date", F.coalesce("_last", "_carried").alias(value))


def derived_factor(macro: DataFrame, kind: str, rows: int = 252) -> DataFrame:
    """date, factor, value: the change over rows in per cent (pct_change_yoy), as a difference (diff_yoy), or the
    rolling z_score."""
    w = W.partitionBy("factor").orderBy("date")
    if kind == "z_score":
        over = w.rowsBetween(1 - rows, 0)
        value = F.when(F.count("value").over(over) == rows, F.try_divide(F.col("value") - F.avg("value").over(over), F.stddev_samp("value").over(over)))
    elif kind == "diff_yoy":
        value = F.col("value") - F.lag("value", rows).over(w)
    elif kind == "pct_change_yoy":
        value = (F.try_divide(F.col("value"), F.lag("value", rows).over(w)) - 1) * 100
    else:
        raise ValueError(f"no transformation {kind}")
    return macro.select("date", "factor", value.alias("value"))


def signals(macro: DataFrame, rules: DataFrame) -> DataFrame:
    """date, factor, signal: 1 above the factor's threshold, else -1."""
    limits = rules.select("factor", "threshold").distinct()
    return macro.join(limits, "factor").filter("value IS NOT NULL").select("date", "factor", F.when(F.col("value") > F.col("threshold"), 1).otherwise(-1).alias("signal"))


def macro_weights(macro: DataFrame, rules: DataFrame) -> DataFrame:
    """strategy macro, date, asset, weight: on each date the known factor of the least priority decides, by rules
    (priority, factor, threshold, side, asset, weight; side above or below)."""
    limits = rules.select("priority", "factor", "threshold").distinct()
    known = macro.filter("value IS NOT NULL").join(limits, "factor")
    first = F.row_number().over(W.partitionBy("date").orderBy("priority"))
    side: Column = F.when(F.col("value") > F.col("threshold"), "above").otherwise("below")
    chosen = known.withColumn("_first", first).filter("_first = 1").select("date", "priority", side.alias("side"))
    picked = chosen.join(rules.select("priority", "side", "asset", "weight"), ["priority", "side"])
    return picked.select(F.lit("macro").alias("strategy"), "date", "asset", F.try_divide("weight", F.sum("weight").over(W.partitionBy("date"))).alias("weight"))


def month_starts(dates: DataFrame) -> DataFrame:
    """The first date there is in each month, but for the first month's."""
    firsts = dates.groupBy(F.trunc("date", "MM").alias("_month")).agg(F.min("date").alias("date"))
    begin = dates.agg(F.min("date").alias("_begin"))
    return firsts.crossJoin(begin).filter("date > _begin").select("date")  # one row


def clipped_returns(values: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """values with ret within sigmas deviations of its strategy's mean."""
    spread = values.groupBy("strategy").agg(F.avg("ret").alias("_mean"), (sigmas * F.stddev_samp("ret")).alias("_width"))
    low, high = F.col("_mean") - F.col("_width"), F.col("_mean") + F.col("_width")
    return values.join(spread, "strategy").withColumn("ret", F.greatest(F.least("ret", high), low)).drop("_mean", "_width")


def compared(metrics: DataFrame, benchmark: str) -> DataFrame:
    """metrics with calmar, excess total return over the benchmark strategy, and place by sharpe."""
    other = metrics.filter(F.col("strategy") == benchmark).select(F.col("total_return").alias("_bench"))
    joined = metrics.join(F.broadcast(other), how="cross")  # one row
    return joined.select(
        "strategy", "total_return", "sharpe", F.try_divide("annual_return", F.abs("max_drawdown")).alias("calmar"), (F.col("total_return") - F.col("_bench")).alias("excess_return"),
        F.row_number().over(W.orderBy(F.desc_nulls_last("sharpe"), "strategy")).alias("place"),
    )
