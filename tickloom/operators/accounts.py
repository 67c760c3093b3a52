"""Position sizes in whole contracts, costs, daily stops and account evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.sequential import by_group

MONEY = "decimal(18,4)"
#: Multiples of commission and slippage by scenario (fixed values).
SCENARIOS = (("gross", 0.0, 0.0), ("moderate", 1.0, 0.5), ("baseline", 1.0, 1.0), ("stress", 1.0, 2.0))


def stop_ticks(distance: Column, tick: Column) -> Column:
    """Whole ticks, rounded up, in exact decimals."""
    return F.ceil(F.round(distance, 6).cast("decimal(18,6)") / tick.cast("decimal(18,6)"))


def round_trip_cents(commission: Column, slippage_ticks: Column, tick: Column, point: Column, extra: Column, commission_times: Column | float = 1.0, slippage_times: Column | float = 1.0) -> Column:
    """Commission, slippage on both sides and extras in cents."""
    c, s = (F.lit(x) if isinstance(x, float) else x for x in (commission_times, slippage_times))
    usd = commission * c + 2 * slippage_ticks * tick * point * s + F.coalesce(extra, F.lit(0.0)) * c
    return F.round(F.round(usd, 6) * 100, 0).cast("bigint")


def fixed_dollar(budget_cents: int, ticks: Column, tick: Column, point: Column, cost_cents: Column, most: int = 50, at_least_one: bool = False) -> Column:
    """Contracts whose stop loss with costs stays within the budget: floor, at most ``most``; 0 is a skip."""
    each = F.round(F.round(ticks * tick * point, 6) * 100, 0).cast("bigint") + cost_cents
    n = F.least(F.lit(most), F.floor(F.lit(budget_cents) / F.nullif(each, F.lit(0))).cast("bigint"))
    return F.when(each.isNotNull(), F.greatest(n, F.lit(1)) if at_least_one else n)


def daily_policy(trades: DataFrame, keys: list[str], order: str, r: str = "r", stop_at: float | None = -2.0, target_at: float | None = 3.0, most: int | None = None) -> DataFrame:
    """Trades of a day until the running sum has reached the stop or the target, or ``most`` are taken.

    ``taken`` is true for the trade that reaches it and false after."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = trades.withColumns({"run": F.sum(r).over(run), "no": F.row_number().over(Window.partitionBy(*keys).orderBy(order))})
    hit = F.lit(False)
    if stop_at is not None:
        hit = hit | (F.col("run") <= stop_at + 1e-9)
    if target_at is not None:
        hit = hit | (F.col("run") >= target_at - 1e-9)
    marked = total.withColumn("hit", hit)
    over = F.coalesce(F.max("hit").over(before), F.lit(False))
    keep = ~over if most is None else ~over & (F.col("no") <= most)
    return marked.withColumn("taken", keep).drop("hit", "no")


@dataclass(frozen=True)
class Profile:
    """An evaluation account in R-scaled dollars; ``mode`` is static, eod or intraday."""

    start: float = 50_000.0
    target: float = 3_000.0
    max_loss: float = 2_000.0
    mode: str = "eod"
    lock: float | None = 50_000.0
    daily_limit: float | None = 1_000.0
    min_days: int = 5
    consistency: float | None = 0.5
    max_days: int = 60


def evaluate(profile: Profile, pnl: np.ndarray, worst: np.ndarray, first: int) -> tuple[str, int, float, float]:
    """Outcome, days used, final balance and least distance to the floor of an account started at day ``first``.

    Each day: the intraday low first (touching the floor fails, whatever the daily limit), then a daily
    loss ends the day at its limit, then the realised balance, then the trailing floor, then the pass test.
    """
    balance = high = profile.start
    floor, room, best, days, gained = profile.start - profile.max_loss, profile.max_loss, 0.0, 0, 0.0

    def trail(level: float) -> float:
        new = max(floor, level - profile.max_loss)
        return new if profile.lock is None else min(new, max(floor, profile.lock))

    for i in range(first, min(len(pnl), first + profile.max_days)):
        day, low = float(pnl[i]), float(min(worst[i], pnl[i], 0.0))
        room = min(room, balance + low - floor)
        if balance + low <= floor:
            return "fail", i - first + 1, floor, room
        if profile.daily_limit is not None and low <= -profile.daily_limit:
            day = -profile.daily_limit
        if profile.mode == "intraday":
            floor = trail(max(high, balance + max(day, 0.0)))
        balance += day
        high = max(high, balance)
        if profile.mode == "eod":
            floor = trail(high)
        if balance <= floor:
            return "fail", i - first + 1, balance, min(room, 0.0)
        days += day != 0
        best, gained = max(best, day), balance - profile.start
        if gained >= profile.target and days >= profile.min_days and (profile.consistency is None or best <= profile.consistency * gained):
            return "pass", i - first + 1, balance, room
    return "open", min(len(pnl), first + profile.max_days) - first, balance, room


STARTS = "entity string, start int, outcome string, days int, balance double, room double"


def _starts(g: dict[str, np.ndarray], profile: Profile, unit: float, every: int) -> dict[str, np.ndarray] | None:
    pnl = g["r"] * unit
    firsts = np.arange(0, max(0, len(pnl) - profile.min_days + 1), every)
    if not len(firsts):
        return None
    worst = np.minimum(g["worst"] * unit if "worst" in g else pnl, 0.0)
    got = [evaluate(profile, pnl, worst, int(f)) for f in firsts]
    outcome, days, balance, room = zip(*got, strict=True)
    return {"entity": np.full(len(got), g["entity"][0], object), "start": g["day"][firsts], "outcome": np.array(outcome, object), "days": np.array(days), "balance": np.array(balance), "room": np.array(room)}


def rolling_accounts(days: DataFrame, profile: Profile = Profile(), unit: float = 500.0, every: int = 1) -> DataFrame:  # noqa: B008
    """An evaluation started at every ``every``-th day of each entity's dense stream (entity, day, r), with
    ``worst``, the lowest mark of the day in R, where there is such a column; else the day's own loss."""
    return by_group(days.select("entity", "day", "r", *(["worst"] if "worst" in days.columns else [])), partial(_starts, profile=profile, unit=unit, every=every), STARTS, keys=("entity",), order=("day",))
