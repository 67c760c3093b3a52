"""Trades on bars: exit outcomes of every decision bar, greedy selection, managed positions.

Conventions: a signal at a bar's close enters at the next bar's open; a bar that touches stop and
target stops (pessimistic); a gap through the stop fills at the open, but not on the entry bar; a
target is a limit order that fills at its price, and only if the bar trades at least one tick
beyond it; time exits at the close of the bar that ends the hold; a position is flat at the close of
the last bar before 16:00 and of its group's last bar. Positions never leave their group of session
and contract, so all is exact per group.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sequential import by_group

#: 16:00 in session minutes.
FLAT_SM = 1320
#: (exit id, stop multiple, hold in minutes, target in R); the fixed 14 templates.
EXITS = tuple((f"S{s}_{name}", float(s), hold, target) for s in (1, 2) for name, hold, target in (("T15", 15, None), ("T30", 30, None), ("T60", 60, None), ("T120", 120, None), ("EOD", None, None), ("R2", None, 2.0), ("R3", None, 3.0)))
OUTCOME = "instrument string, sday int, tmin bigint, exit_id string, dir int, pnl double, exit_tmin bigint, reason string"


def stop_distance(raw: Column, tick: Column | float) -> Column:
    """raw rounded up to ticks; NULL below one tick."""
    tick = F.lit(tick) if isinstance(tick, float) else tick
    d = F.ceil(raw / tick - 1e-9) * tick
    return F.when(d >= tick, d)


def first_where(hit: np.ndarray) -> np.ndarray:
    """Column of the first true value in each row; the number of columns where there is none."""
    at = hit.argmax(axis=1)
    at[~hit[np.arange(len(at)), at]] = hit.shape[1]
    return at


def flat_bars(sm: np.ndarray, flat_sm: int = FLAT_SM) -> np.ndarray:
    """Bars at whose close no position may be left: before or from the flat time, and the last."""
    flat = np.asarray(sm) >= flat_sm
    flat[:-1] |= flat[1:]
    flat[-1] = True
    return flat


def first_exits(g: dict[str, np.ndarray], exits: tuple = EXITS, rows_at_once: int = 256) -> dict[str, np.ndarray] | None:
    """Every decision bar of a group with each exit and direction.

    The first bar that reaches a level is found once for each stop and each target, over all entries
    together, and combined with the first flat bar and the bar that ends the hold, both by search.
    """
    n = len(g["tmin"])
    every = np.flatnonzero(g["is_dec"].astype(bool) & (np.arange(n) < n - 1) & ~np.isnan(g["scale"]))
    if not len(every):
        return None
    o, h, l, c, t = (g[k] for k in ("o", "h", "l", "c", "tmin"))  # noqa: E741
    flat_at = np.flatnonzero(flat_bars(np.nan_to_num(g["sm"])))
    rows = []
    for at in (every[i : i + rows_at_once] for i in range(0, len(every), rows_at_once)):
        entry, first = at + 1, at[0] + 1
        flat = flat_at[np.searchsorted(flat_at, entry)]
        last = int(flat.max()) + 1
        seen = np.arange(first, last)[None, :] >= entry[:, None]
        low, high, tick, price = l[None, first:last], h[None, first:last], g["tick"][at], o[entry]
        stops: dict[tuple, tuple] = {}
        goals: dict[tuple, tuple] = {}
        for name, multiple, hold, target in exits:
            stop = np.ceil(multiple * math.sqrt(10) * g["scale"][at] / tick - 1e-9) * tick
            timed = np.searchsorted(t, t[entry] + hold - 1) if hold else np.full(len(at), n)
            for side in (1, -1):
                adverse, good = (low, high) if side > 0 else (high, low)
                if (multiple, side) not in stops:
                    floor = price - side * stop
                    stops[multiple, side] = floor, first + first_where(seen & (side * (adverse - floor[:, None]) <= 0))
                floor, stopped = stops[multiple, side]
                goal, won = np.full(len(at), np.nan), np.full(len(at), n)
                if target:
                    if (multiple, side, target) not in goals:
                        goal = price + side * stop * target
                        goals[multiple, side, target] = goal, first + first_where(seen & (side * (good - goal[:, None]) >= tick[:, None]))
                    goal, won = goals[multiple, side, target]
                close = np.minimum(timed, flat)
                end = np.minimum(np.minimum(stopped, won), close)
                opened, later = o[end], end > entry
                gap = later & (side * (opened - floor) <= 0)
                gap_won = later & (won == end) & (side * (opened - goal) >= tick)
                cases = [gap, gap_won, stopped == end, won == end, timed == end]
                fill = np.select(cases, [opened, goal, floor, goal, c[end]], c[end])
                why = np.select(cases, ["gap_stop", "target", "stop", "target", "time"], "flat").astype(object)
                keep = np.flatnonzero(stop >= tick)
                rows.append((name, side, at[keep], (side * (fill - price))[keep], t[end][keep], why[keep]))
    idx = np.concatenate([r[2] for r in rows])
    return {
        "instrument": g["instrument"][idx], "sday": g["sday"][idx], "tmin": t[idx], "exit_id": np.concatenate([np.full(len(r[2]), r[0], object) for r in rows]),
        "dir": np.concatenate([np.full(len(r[2]), r[1]) for r in rows]), "pnl": np.concatenate([r[3] for r in rows]), "exit_tmin": np.concatenate([r[4] for r in rows]), "reason": np.concatenate([r[5] for r in rows]),
    }


def outcomes(bars: DataFrame, exits: tuple = EXITS) -> DataFrame:
    """``bars`` with is_dec, scale and tick; one row for each (decision bar, exit, direction)."""
    return by_group(bars.select("instrument", "sday", "seg", "tmin", "sm", "o", "h", "l", "c", "is_dec", "scale", "tick"), partial(first_exits, exits=exits), OUTCOME)


def greedy(events: DataFrame, keys: list[str], start: str = "tmin", end: str = "exit_tmin", keep: tuple[str, ...] = ("pnl",)) -> DataFrame:
    """One position at a time: an event is taken if its start is not before the last taken exit.

    Events with a NULL end or NULL first kept value are skipped and take no slot. Each (keys) group,
    which must be bounded (one candidate and session), is folded in the JVM.
    """
    item = F.struct(F.col(start).alias("t"), F.col(end).alias("e"), *[F.col(k) for k in keep])
    grouped = events.where(F.col(end).isNotNull() & F.col(keep[0]).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("all"))
    first = F.slice("all", 1, 0)
    taken = F.aggregate(
        "all",
        F.struct(F.lit(-(2**62)).alias("free"), first.alias("got")),
        lambda a, x: F.when(x["t"] >= a["free"], F.struct(x["e"].alias("free"), F.concat(a["got"], F.array(x)).alias("got"))).otherwise(a),
        lambda a: a["got"],
    )
    return grouped.select(*keys, F.posexplode(taken).alias("trade_no", "x")).select(*keys, "trade_no", F.col("x.t").alias(start), F.col("x.e").alias(end), *[F.col(f"x.{k}").alias(k) for k in keep])


MANAGED = "template string, instrument string, sday int, entry_tmin bigint, exit_tmin bigint, side int, risk double, r double, reason string, mae double, mfe double"
#: The management templates: break-even, partial, trailing and target in R, the hold in minutes.
TEMPLATES = {"target": {"target_r": 2.0, "hold": 60}, "breakeven": {"target_r": 3.0, "breakeven_r": 1.0}, "partial": {"partial_r": 1.0, "target_r": 2.0}, "trail": {"trail_r": 1.5, "hold": 120}}


def managed(g: dict[str, np.ndarray], *, target_r: float | None = None, hold: int | None = None, breakeven_r: float | None = None, partial_r: float | None = None, trail_r: float | None = None, through: float = 0.25, least_risk: float = 0.25, mechanism: bool = False) -> dict[str, np.ndarray] | None:
    """Positions of one group from ``signal`` (-1, 0, 1 at a bar's close) and ``risk`` (stop distance).

    At each bar, in this order: mechanism exit at the open if the last completed ``state`` (the signal
    if there is none) is not the side; gap stop, gap target and gap partial at the open (limit orders
    need ``through`` beyond their price, at the open as inside a bar); stop; partial; target; hold or
    flat bar at the close. Break-even and trailing move the stop from the next bar on; once on, a trail
    stays on. A later signal is taken only if its entry bar is after the last exit bar.
    """
    o, h, l, c, t = (g[k].tolist() for k in ("o", "h", "l", "c", "tmin"))  # noqa: E741
    signal, risks, n, busy, rows = g["signal"].tolist(), g["risk"].tolist(), len(t), -1, []
    state = g["state"].tolist() if "state" in g else signal
    flat = flat_bars(np.nan_to_num(g["sm"])).tolist() if "sm" in g else [False] * (n - 1) + [True]
    for s in np.flatnonzero(np.nan_to_num(g["signal"][:-1])).tolist():
        side, risk, e = signal[s], risks[s], s + 1
        if not risk >= least_risk or e <= busy:
            continue
        price = o[e]
        stop, goal = price - side * risk, None if target_r is None else price + side * risk * target_r
        part = None if partial_r is None else price + side * risk * partial_r
        size = 1 if part is None else 2
        units, banked, best, worst, trailing = size, 0.0, price, price, False
        for i in range(e, n):
            done = why = None
            low, high = (l[i], h[i]) if side > 0 else (h[i], l[i])
            beyond = lambda at, order: order is not None and side * (at - order) >= through
            if i > e and mechanism and state[i - 1] != side:
                done, why = o[i], "mechanism"
            elif i > e and side * (o[i] - stop) <= 0:
                done, why = o[i], "gap_stop"
            else:
                if i > e and units == size and part is not None and (beyond(o[i], goal) or beyond(o[i], part)):
                    banked, units = banked + side * (part - price), units - 1
                if i > e and beyond(o[i], goal):
                    done, why = goal, "gap_target"
                elif side * (low - stop) <= 0:
                    done, why = stop, "stop"
                else:
                    if units == size and beyond(high, part):
                        banked, units = banked + side * (part - price), units - 1
                    if beyond(high, goal):
                        done, why = goal, "target"
                    elif flat[i] or (hold is not None and t[i] - t[e] >= hold - 1):
                        done, why = c[i], "flat" if flat[i] else "time"
            if done is None:
                best, worst = (max(best, high), min(worst, low)) if side > 0 else (min(best, high), max(worst, low))
                gained = side * (best - price) / risk
                if breakeven_r is not None and gained >= breakeven_r:
                    stop = max(stop, price) if side > 0 else min(stop, price)
                trailing = trailing or (trail_r is not None and gained >= trail_r)
                if trailing:
                    moved = best - side * trail_r * risk
                    stop = max(stop, moved) if side > 0 else min(stop, moved)
                continue
            points = (banked + units * side * (done - price)) / size
            edge = done if side * (done - worst) < 0 else worst
            top = done if side * (done - best) > 0 else best
            rows.append((t[e], t[i], side, risk, points / risk, why, max(0.0, side * (price - edge)) / risk, max(0.0, side * (top - price)) / risk))
            busy = i
            break
    if not rows:
        return None
    cols = list(zip(*rows, strict=True))
    names = ("entry_tmin", "exit_tmin", "side", "risk", "r", "reason", "mae", "mfe")
    out = {k: np.array(v, object if k == "reason" else None) for k, v in zip(names, cols, strict=True)}
    return out | {"instrument": np.full(len(rows), g["instrument"][0], object), "sday": np.full(len(rows), g["sday"][0])}


def managed_all(g: dict[str, np.ndarray], templates: dict[str, dict]) -> dict[str, np.ndarray] | None:
    made = [(name, got) for name, template in templates.items() if (got := managed(g, **template)) is not None]
    if not made:
        return None
    out = {k: np.concatenate([got[k] for _, got in made]) for k in made[0][1]}
    return out | {"template": np.concatenate([np.full(len(got["r"]), name, object) for name, got in made])}


def managed_trades(bars: DataFrame, templates: dict[str, dict] = TEMPLATES) -> DataFrame:
    """``bars`` with signal and risk (and state, for mechanism exits); the trades of all templates from one pass."""
    extra = ["state"] if "state" in bars.columns else []
    return by_group(bars.select("instrument", "sday", "seg", "tmin", "sm", "o", "h", "l", "c", "signal", "risk", *extra), partial(managed_all, templates=templates), MANAGED)


def spec_metrics(trades: DataFrame, keys: list[str], *, cost: Column, stress: Column, year: Column, shadow: Column | float = 0.0, periods: tuple[int, int] = (2012, 2015)) -> DataFrame:
    """The evaluator's figures of each key's trades (r, risk, entry_tmin): net and stress R after costs in
    points, expectancy, profit factor (NULL without losses), drawdown, active years, sums and counts
    of three periods of years, and the mean excess over a shadow R."""
    order = Window.partitionBy(*keys).orderBy("entry_tmin").rowsBetween(Window.unboundedPreceding, 0)
    net = trades.withColumns({"_net": F.col("r") - cost / F.col("risk"), "_stress": F.col("r") - stress / F.col("risk"), "_year": year, "_shadow": F.lit(shadow) if isinstance(shadow, float) else shadow})
    eq = net.withColumn("_eq", F.sum("_net").over(order)).withColumn("_dd", F.greatest(F.max("_eq").over(order), F.lit(0.0)) - F.col("_eq"))
    period = F.when(F.col("_year") <= periods[0], 1).when(F.col("_year") <= periods[1], 2).otherwise(3)
    gain, loss = F.sum(F.greatest("_net", F.lit(0.0))), F.sum(F.greatest(-F.col("_net"), F.lit(0.0)))
    parts = [x for k in (1, 2, 3) for x in (F.sum(F.when(period == k, F.col("_net")).otherwise(0.0)).alias(f"net_r_{k}"), F.sum((period == k).cast("bigint")).alias(f"trades_{k}"))]
    return eq.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.sum("_net").alias("net_r"), F.sum("_stress").alias("stress_net_r"), F.avg("_net").alias("expectancy_r"), (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"),
        F.max("_dd").alias("max_drawdown_r"), F.count_distinct("_year").alias("active_years"), *parts, F.avg(F.col("_net") - F.col("_shadow")).alias("matched_excess_r"),
    )


def excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Worst and best excursion in points between entry and exit of trades (instrument, sday, entry_tmin, exit_tmin, side, price)."""
    b = bars.select("instrument", "sday", F.col("tmin").alias("t"), "h", "l")
    on = (trades.instrument == b.instrument) & (trades.sday == b.sday) & (b.t >= trades.entry_tmin) & (b.t <= trades.exit_tmin)
    j = trades.join(b, on).select(trades["*"], "h", "l")
    return j.groupBy("instrument", "sday", "entry_tmin", "side", "price").agg(
        F.greatest(F.lit(0.0), F.max(F.when(F.col("side") > 0, F.col("price") - F.col("l")).otherwise(F.col("h") - F.col("price")))).alias("mae"),
        F.greatest(F.lit(0.0), F.max(F.when(F.col("side") > 0, F.col("h") - F.col("price")).otherwise(F.col("price") - F.col("l")))).alias("mfe"),
    )


def trade_metrics(trades: DataFrame, keys: list[str], pnl: str = "pnl", order: str = "trade_no") -> DataFrame:
    """Counts, sums, profit factor, drawdown and the longest losing streak of each key's trades in order.

    Sums are added in the trades' order, so a total that lies at a half of the last place shown doesn't depend on tasks."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(pnl)
    sums = {"_eq": x, "_ss": x * x, "_gain": F.greatest(x, F.lit(0.0)), "_loss": F.greatest(-x, F.lit(0.0))}
    eq = trades.withColumns({k: F.sum(v).over(w) for k, v in sums.items()}).withColumn("_lose", (x < 0).cast("int"))
    eq = eq.withColumn("_dd", F.greatest(F.max("_eq").over(w), F.lit(0.0)) - F.col("_eq")).withColumn("_island", F.sum(1 - F.col("_lose")).over(w))
    last = F.max(F.struct(F.col(order).alias("_at"), *sums)).alias("_last")
    streaks = eq.groupBy(*keys, "_island").agg(F.sum("_lose").alias("_streak"), F.count("*").alias("_k"), F.sum((x > 0).cast("int")).alias("_win"), last, F.max("_dd").alias("_dd"))
    total = streaks.groupBy(*keys).agg(F.sum("_k").alias("n"), F.sum("_win").alias("_wins"), F.max("_last").alias("_last"), F.max("_dd").alias("max_drawdown"), F.max("_streak").alias("losing_streak"))
    total = total.withColumns({"total": F.col("_last._eq"), "_sumsq": F.col("_last._ss"), "_gain": F.col("_last._gain"), "_loss": F.col("_last._loss")})
    var = (F.col("_sumsq") - F.col("total") * F.col("total") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return total.select(
        *keys, "n", "total", (F.col("total") / F.col("n")).alias("mean"), (F.col("_wins") / F.col("n")).alias("win_rate"),
        F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")).alias("profit_factor"), ((F.col("_loss") == 0) & (F.col("_gain") > 0)).alias("never_lost"),
        F.when(var > 1e-12, F.col("total") / F.col("n") / F.sqrt(var / F.col("n"))).alias("t_stat"), "max_drawdown", "losing_streak",
    )


#: Direction variants: with (1) or against (-1) the trigger, after triggers of either sign (0) or of one.
VARIANTS = (("cont_both", 1, 0), ("rev_both", -1, 0), ("cont_long", 1, 1), ("cont_short", 1, -1), ("rev_long", -1, -1), ("rev_short", -1, 1))


def rule_events(triggers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every trigger event (instrument, tmin, trigger_id, sign) under each variant with each exit's outcome.

    A trade goes with or against the sign; variants of one side keep the events that trade it."""
    taken = F.filter(F.array(*[F.struct(F.lit(n).alias("variant"), (F.lit(way) * F.col("sign")).cast("int").alias("dir"), F.lit(only).alias("only")) for n, way, only in VARIANTS]), lambda v: (v["only"] == 0) | (v["only"] == F.col("sign")))
    each = triggers.select("instrument", "tmin", "trigger_id", F.explode(taken).alias("v")).select("instrument", "tmin", "trigger_id", "v.variant", "v.dir")
    return each.join(outcomes, ["instrument", "tmin", "dir"])


def rule_stats(events: DataFrame, cost: Column, keys: tuple[str, ...] = ("instrument", "trigger_id", "variant", "exit_id")) -> DataFrame:
    """Statistics of each rule's trades, one position at a time, after ``cost`` in points."""
    net = greedy(events.withColumn("net", F.col("pnl") - cost), [*keys, "sday"], keep=("net",))
    w = Window.partitionBy(*keys).orderBy("tmin").rowsBetween(Window.unboundedPreceding, 0)
    eq = net.withColumn("eq", F.sum("net").over(w)).withColumn("dd", F.greatest(F.max("eq").over(w), F.lit(0.0)) - F.col("eq"))
    x = F.col("net")
    return eq.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sum"), F.sum(x * x).alias("sumsq"), F.count_if(x > 0).alias("wins"), F.sum(F.greatest(x, F.lit(0.0))).alias("sumpos"), F.sum(F.least(x, F.lit(0.0))).alias("sumneg"), F.max("dd").alias("maxdd"))
