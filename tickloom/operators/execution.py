"""From signals and a policy to trades: window masks, the one-position backtest and the trade table.

A signal at a bar's close fills at the next bar's open if that bar may be entered. A stop or target is checked
from the entry bar on; a gap through the stop fills at the open, a target at its price and only if the bar
trades ``through`` beyond it; where both are reached in one bar and the open doesn't decide, the policy does.
A position ends at the hold's last close, at a flat bar's close, or at the open after an opposite signal.
Positions never leave their group of session and contract.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.accounts import SCENARIOS, round_trip_cents
from tickloom.operators.sequential import by_group
from tickloom.operators.windows import Rolling

R = Rolling()
TRADES = "instrument string, sday int, entry_tmin bigint, exit_tmin bigint, side int, entry_px double, exit_px double, points double, reason string, ambiguous boolean, mae double, mfe double, initial_risk double"


def window_masks(bars: DataFrame, entry_start: int, entry_end: int, flat_at: int) -> DataFrame:
    """``entry_ok``: a position may open at this bar's open; ``flat_bar``: none may be left at its close."""
    sm, nxt = F.col("sm"), R.lead(F.col("sm"))
    entry = R.lag(sm).isNotNull() & (sm >= entry_start) & (sm < entry_end) & (sm < flat_at)
    flat = nxt.isNull() | (nxt >= flat_at) | (sm >= flat_at)
    return bars.withColumns({"entry_ok": F.coalesce(entry, F.lit(False)), "flat_bar": F.coalesce(flat, F.lit(True))})


def candidate_entries(bars: DataFrame) -> DataFrame:
    """Bars that may be entered and follow a ``long`` or ``short`` signal."""
    signal = F.coalesce("long", F.lit(False)) | F.coalesce("short", F.lit(False))
    return bars.withColumn("_signal", R.lag(signal)).where("entry_ok and _signal").drop("_signal")


def backtest(g: dict[str, np.ndarray], *, direction: str = "both", hold: int | None = None, exit_on_opposite: bool = False, pessimistic: bool = True, through: float = 0.25, levels: bool = False, require_stop: bool = False, require_target: bool = False) -> dict[str, np.ndarray] | None:
    """Trades of one group. ``stop`` and ``target`` of the signal bar are distances, or prices with ``levels``;
    NaN means none, or no entry where one is required. Each position's end is searched from its entry on, so a bar is looked at once for a trade."""
    o, h, l, c, t = (g[k] for k in ("o", "h", "l", "c", "tmin"))  # noqa: E741
    n = len(o)
    long, short = g["long"].astype(bool) & (direction != "short"), g["short"].astype(bool) & (direction != "long")
    both_long, both_short = g["long"].astype(bool), g["short"].astype(bool)
    can = np.flatnonzero(g["entry_ok"][1:].astype(bool) & (long[:-1] ^ short[:-1])) + 1
    flat = g["flat_bar"].astype(bool).copy()
    flat[-1] = True
    free, rows = 0, []
    for i in can.tolist():
        if i < free:
            continue
        side, price = (1 if long[i - 1] else -1), o[i]
        want_stop, want_goal = g["stop"][i - 1], g["target"][i - 1]
        if (require_stop and want_stop != want_stop) or (require_target and want_goal != want_goal):
            continue
        if levels:
            stop, goal = want_stop, want_goal
            if side * (price - stop) <= 0 or side * (goal - price) <= 0:
                continue
        else:
            if want_stop <= 0 or want_goal <= 0:
                continue
            stop, goal = price - side * want_stop, price + side * want_goal
        low, high = (l[i:], h[i:]) if side > 0 else (h[i:], l[i:])
        closing = flat[i:] | (t[i:] - t[i] >= hold - 1 if hold else False)
        touched, won = side * (low - stop) <= 0, side * (high - goal) >= through
        opposite = (both_short if side > 0 else both_long)[i:] if exit_on_opposite else np.zeros(n - i, bool)
        ends = touched | won | closing | np.r_[False, opposite[:-1] & ~closing[:-1]]
        k = int(ends.argmax())
        x, unclear, whole = i + k, False, k + 1
        if k and opposite[k - 1]:
            fill, why, whole = o[x], "opposite_signal", k
        elif touched[k] or won[k]:
            whole = k
            if touched[k] and k and side * (o[x] - stop) <= 0:
                fill, why = o[x], "stop"
            elif won[k] and k and side * (o[x] - goal) >= through:
                fill, why = goal, "target"
            else:
                unclear = bool(touched[k] and won[k])
                fill, why = (stop, "stop") if touched[k] and (pessimistic or not won[k]) else (goal, "target")
        else:
            fill, why = c[x], "time" if hold and t[x] - t[i] >= hold - 1 else "session_end"
        gained = side * (fill - price)
        worst = max(0.0, float((side * (price - low[:whole])).max(initial=0.0)))
        best = max(0.0, float((side * (high[:whole] - price)).max(initial=0.0)))
        if why not in ("time", "session_end"):
            worst, best = max(worst, -gained), max(best, gained)
        rows.append((t[i], t[x], side, price, fill, gained, why, unclear, worst, best, abs(price - stop)))
        free = x if why == "opposite_signal" else x + 1
    if not rows:
        return None
    names = ("entry_tmin", "exit_tmin", "side", "entry_px", "exit_px", "points", "reason", "ambiguous", "mae", "mfe", "initial_risk")
    out = {k: np.array(v, object if k == "reason" else None) for k, v in zip(names, zip(*rows, strict=True), strict=True)}
    return out | {"instrument": np.full(len(rows), g["instrument"][0], object), "sday": np.full(len(rows), g["sday"][0])}


def run_signals(bars: DataFrame, **policy) -> DataFrame:
    """``bars`` with entry_ok, flat_bar, long, short, stop and target; see ``backtest`` for the policy."""
    held = bars.select("instrument", "sday", "seg", "tmin", "o", "h", "l", "c", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("entry_ok", "flat_bar", "long", "short")], F.col("stop").cast("double").alias("stop"), F.col("target").cast("double").alias("target"))
    return by_group(held, partial(backtest, **policy), TRADES)


def trade_table(trades: DataFrame, costs: DataFrame, contracts: Column | int = 1) -> DataFrame:
    """Trades with dollars before and after the costs of each scenario, R and minutes held.

    ``trades`` has instrument, entry_tmin, exit_tmin, side, points, initial_risk and reason. All exits but
    those at an open are at the end of their bar. R is NULL without a risk."""
    priced = trades.join(costs.select("instrument", "tick_size", "point_value", "commission_round_trip", "slippage_ticks_per_side", "extra"), "instrument")
    cents = {name: round_trip_cents(F.col("commission_round_trip"), F.col("slippage_ticks_per_side"), F.col("tick_size"), F.col("point_value"), F.col("extra"), c, s) / 100 for name, c, s in SCENARIOS if name != "gross"}
    q = F.lit(contracts) if isinstance(contracts, int) else contracts
    gross = F.col("points") * F.col("point_value")
    made = priced.withColumns({"contracts": q, "gross_usd": q * gross, "net_usd": q * (gross - cents["baseline"]), "stress_usd": q * (gross - cents["stress"]), "moderate_usd": q * (gross - cents["moderate"])})
    risk = F.when(F.col("initial_risk") > 0, F.col("initial_risk"))
    ends = F.col("exit_tmin") + F.when(F.col("reason") == "opposite_signal", 0).otherwise(1)
    return made.withColumns({"hold_min": (ends - F.col("entry_tmin")).cast("double"), "r_multiple": F.col("net_usd") / F.col("contracts") / F.col("point_value") / risk, "gross_r": F.col("points") / risk}).drop("tick_size", "commission_round_trip", "slippage_ticks_per_side", "extra")
