"""Figures of trade tables: one row for each key, year or month.

Drawdowns and streaks need the order of trades and are windows over a key; all else combines before the
shuffle. Where a figure has no meaning (no trades on a side, no losses) it is NULL; a profit factor without
losses is NULL too, with ``never_lost`` beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import ratio


def factor(x: Column) -> Column:
    """Gains over losses."""
    return F.sum(F.greatest(x, F.lit(0.0))) / F.nullif(F.sum(F.greatest(-x, F.lit(0.0))), F.lit(0.0))


def with_path(trades: DataFrame, keys: list[str], order: list[str], pnl: str = "net_usd") -> DataFrame:
    """``dd``, the fall from the highest sum so far (0 at first), and ``lost_in_row``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    losing = (F.col(pnl) < 0).cast("int")
    one = trades.withColumns({"_eq": F.sum(pnl).over(w), "_island": F.sum(1 - losing).over(w)})
    run = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumns({"dd": F.greatest(F.max("_eq").over(w), F.lit(0.0)) - F.col("_eq"), "lost_in_row": F.sum(losing).over(run)}).drop("_eq", "_island")


def _core(net: str = "net_usd", gross: str = "gross_usd") -> list[Column]:
    win = F.col(net) > 0
    return [
        F.count("*").alias("trades"), F.count_if(win).alias("wins"), (F.count_if(win) / F.count("*")).alias("win_rate"), factor(F.col(net)).alias("profit_factor"), F.sum(gross).alias("gross_pnl"),
        F.sum(net).alias("net_pnl"), F.avg(net).alias("avg_trade"), F.max("dd").alias("max_dd_usd"), F.count_if(F.col("side") == 1).alias("long_trades"), F.count_if(F.col("side") == -1).alias("short_trades"),
    ]


def day_of(session: str = "sday") -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.col(session))


def by_period(trades: DataFrame, keys: list[str], order: list[str], period: str) -> DataFrame:
    """Metrics of each key's year (2024) or month (202403)."""
    label = F.year(day_of()) if period == "year" else F.year(day_of()) * 100 + F.month(day_of())
    marked = trades.withColumn(period, label)
    return with_path(marked, [*keys, period], order).groupBy(*keys, period).agg(*_core())


def yearly(trades: DataFrame, keys: list[str], order: list[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """Every year of a key from its first to its last (or those given), years without trades as zeros."""
    made = by_period(trades, keys, order, "year")
    bounds = made.groupBy(*keys).agg(F.coalesce(F.lit(first), F.min("year")).alias("a"), F.coalesce(F.lit(last), F.max("year")).alias("b"))
    every = bounds.select(*keys, F.explode(F.sequence("a", "b")).alias("year"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("trades", "wins", "gross_pnl", "net_pnl", "max_dd_usd", "long_trades", "short_trades")}
    return every.join(made, [*keys, "year"], "left").withColumns(zero)


def rolling_12m(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Net and trades of the last twelve calendar months, months without trades included."""
    no = F.floor(F.col("month") / 100) * 12 + F.col("month") % 100 - 1
    one = monthly.withColumn("no", no)
    every = one.groupBy(*keys).agg(F.min("no").alias("a"), F.max("no").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("no"))
    w = Window.partitionBy(*keys).orderBy("no").rowsBetween(-11, 0)
    filled = every.join(one.select(*keys, "no", "net_pnl", "trades"), [*keys, "no"], "left")
    month = (F.floor(F.col("no") / 12) * 100 + F.col("no") % 12 + 1).cast("int").alias("month")
    return filled.select(*keys, month, F.sum(F.coalesce("net_pnl", F.lit(0.0))).over(w).alias("net_12m"), F.sum(F.coalesce("trades", F.lit(0))).over(w).alias("trades_12m"))


def summary(trades: DataFrame, keys: list[str], order: list[str], years: Column, tradable_bars: Column) -> DataFrame:
    """The whole summary of each key's trade table. ``years`` and ``tradable_bars`` describe the period, as
    columns of ``trades`` that are constant in a key."""
    net, gross, side = F.col("net_usd"), F.col("gross_usd"), F.col("side")
    rank = Window.partitionBy(*keys).orderBy(F.desc("net_usd"), *order)
    seen = with_path(trades, keys, order).withColumns({"_years": F.greatest(years, F.lit(1e-9)), "_bars": F.greatest(tradable_bars, F.lit(1)), "_rank": F.row_number().over(rank), "_n": F.count("*").over(Window.partitionBy(*keys)), "_pts": net / F.col("point_value")})
    win, lose = net > 0, net < 0
    only = lambda c, x: F.when(c, x)
    one = seen.groupBy(*keys).agg(
        *_core(), F.count_if(lose).alias("losses"), F.sum(F.greatest(net, F.lit(0.0))).alias("gross_profit"), F.sum(F.greatest(-net, F.lit(0.0))).alias("gross_loss"), factor(gross).alias("profit_factor_gross"),
        factor(F.col("stress_usd")).alias("profit_factor_stress"), F.sum("stress_usd").alias("stress_net_pnl"), F.sum("moderate_usd").alias("moderate_net_pnl"), F.sum(gross - net).alias("total_cost_usd"),
        F.avg(only(win, net)).alias("avg_winner"), F.avg(only(lose, net)).alias("avg_loser"), F.max(net).alias("best_trade"), F.min(net).alias("worst_trade"), F.max("lost_in_row").alias("longest_losing_streak"),
        F.avg("_pts").alias("expectancy_pts"), F.avg("points").alias("gross_expectancy_pts"), (F.max("dd") / F.first("point_value")).alias("max_dd_pts"), F.avg(gross).alias("breakeven_cost_per_trade"),
        F.avg("hold_min").alias("avg_hold_min"), F.median("hold_min").alias("median_hold_min"), (F.sum("hold_min") / F.first("_bars")).alias("exposure"), (F.count("*") / F.first("_years")).alias("trades_per_year"),
        (F.sum(net) / F.first("_years")).alias("annual_net_pnl"), F.coalesce(F.sum(only(side == 1, net)), F.lit(0.0)).alias("long_pnl"), F.coalesce(F.sum(only(side == -1, net)), F.lit(0.0)).alias("short_pnl"),
        F.avg("mae").alias("avg_mae_pts"), F.avg("mfe").alias("avg_mfe_pts"), F.count_if(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous_bars"),
        F.sum(only(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.01)), net)).alias("top1pct_trades_pnl"), F.avg("initial_risk").alias("avg_risk_pts"), F.median("initial_risk").alias("median_risk_pts"),
        F.avg(F.col("initial_risk") * F.col("point_value")).alias("avg_risk_usd"), F.avg("r_multiple").alias("avg_r"), F.avg(only(win, F.col("gross_r"))).alias("avg_winner_r"), F.avg(only(lose, F.col("gross_r"))).alias("avg_loser_r"),
    ).withColumns({
        "win_loss_ratio": F.col("avg_winner") / -F.col("avg_loser"), "observed_breakeven_winrate": ratio(-F.col("avg_loser"), F.col("avg_winner") - F.col("avg_loser")), "never_lost": (F.col("losses") == 0) & (F.col("wins") > 0),
    })
    spans = None
    for label in ("month", "year"):
        period = F.year(day_of()) if label == "year" else F.year(day_of()) * 100 + F.month(day_of())
        sums = trades.groupBy(*keys, period.alias("_p")).agg(F.sum("net_usd").alias("s"))
        made = sums.groupBy(*keys).agg(F.count_if(F.col("s") > 0).alias(f"positive_{label}s"), F.count_if(F.col("s") < 0).alias(f"negative_{label}s"), F.max("s").alias(f"best_{label}_net"))
        spans = made if spans is None else spans.join(made, keys)
    return one.join(spans, keys)
