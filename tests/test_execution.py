"""The backtest against a bar-by-bar account, and the trade table's arithmetic."""

import numpy as np
from tickloom.operators import execution as x


def slow(g, hold, exit_on_opposite, through=0.25):
    """One pass over all bars with the position as state, from the rules alone."""
    out, pos, leave = [], None, False
    n = len(g["o"])
    for i in range(1, n):
        o, h, l, c = (g[k][i] for k in "ohlc")  # noqa: E741
        if pos and leave:
            out.append((pos["t"], g["tmin"][i], pos["s"], o, "opposite_signal", max(pos["mae"], -pos["s"] * (o - pos["p"])), max(pos["mfe"], pos["s"] * (o - pos["p"]))))
            pos, leave = None, False
        if not pos and g["entry_ok"][i] and g["long"][i - 1] != g["short"][i - 1] and g["stop"][i - 1] > 0 and g["target"][i - 1] > 0:
            s = 1 if g["long"][i - 1] else -1
            pos = {"t": g["tmin"][i], "i": i, "s": s, "p": o, "stop": o - s * g["stop"][i - 1], "goal": o + s * g["target"][i - 1], "mae": 0.0, "mfe": 0.0}
        if not pos:
            continue
        s, p = pos["s"], pos["p"]
        low, high = (l, h) if s > 0 else (h, l)
        hit, won = s * (low - pos["stop"]) <= 0, s * (high - pos["goal"]) >= through
        if hit or won:
            if i > pos["i"] and s * (o - pos["stop"]) <= 0:
                fill, why = o, "stop"
            elif i > pos["i"] and s * (o - pos["goal"]) >= through:
                fill, why = pos["goal"], "target"
            else:
                fill, why = (pos["stop"], "stop") if hit else (pos["goal"], "target")
            out.append((pos["t"], g["tmin"][i], s, fill, why, max(pos["mae"], -s * (fill - p)), max(pos["mfe"], s * (fill - p))))
            pos = None
            continue
        pos["mae"], pos["mfe"] = max(pos["mae"], s * (p - low)), max(pos["mfe"], s * (high - p))
        timed = g["tmin"][i] - pos["t"] >= hold - 1
        if timed or g["flat_bar"][i] or i == n - 1:
            out.append((pos["t"], g["tmin"][i], s, c, "time" if timed else "session_end", pos["mae"], pos["mfe"]))
            pos = None
        elif exit_on_opposite and (g["short"] if s > 0 else g["long"])[i]:
            leave = True
    return out


def test_against_the_slow_account():
    reasons = set()
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n = 160
        c = 100 + np.cumsum(rng.integers(-4, 5, n)) * 0.25
        o = np.r_[c[0], c[:-1]] + rng.integers(-6, 7, n) * 0.25 * (rng.random(n) < 0.3)
        g = {"instrument": np.full(n, "A", object), "sday": np.zeros(n, int), "tmin": np.arange(n) + 500, "o": o, "h": np.maximum(o, c) + rng.integers(0, 3, n) * 0.25, "l": np.minimum(o, c) - rng.integers(0, 3, n) * 0.25, "c": c, "long": rng.random(n) < 0.2, "short": rng.random(n) < 0.2, "entry_ok": rng.random(n) < 0.9, "flat_bar": rng.random(n) < 0.02, "stop": rng.integers(1, 12, n) * 0.25, "target": rng.integers(1, 16, n) * 0.25}
        got = x.backtest(g, hold=12, exit_on_opposite=seed % 2 == 0)
        rows = list(zip(*(got[k].tolist() for k in ("entry_tmin", "exit_tmin", "side", "exit_px", "reason", "mae", "mfe")), strict=True))
        assert rows == slow(g, 12, seed % 2 == 0)
        reasons |= set(got["reason"])
    assert reasons == {"stop", "target", "time", "session_end", "opposite_signal"}


def test_conflicts_levels_and_policies():
    n = 6
    base = {"instrument": np.full(n, "A", object), "sday": np.zeros(n, int), "tmin": np.arange(n), "o": np.full(n, 100.0), "h": np.full(n, 103.0), "l": np.full(n, 97.0), "c": np.full(n, 100.0), "entry_ok": np.ones(n, bool), "flat_bar": np.zeros(n, bool), "stop": np.full(n, 2.0), "target": np.full(n, 2.0)}
    one = np.arange(n) == 1
    assert x.backtest(base | {"long": one, "short": one}) is None
    got = x.backtest(base | {"long": one, "short": ~one & False})
    assert got["reason"][0] == "stop" and got["ambiguous"][0] and got["exit_px"][0] == 98.0
    assert x.backtest(base | {"long": one, "short": one & False}, pessimistic=False)["reason"][0] == "target"
    assert x.backtest(base | {"long": one, "short": one & False, "stop": np.full(n, 101.0), "target": np.full(n, 104.0)}, levels=True) is None
    assert x.backtest(base | {"long": one, "short": one & False, "stop": np.full(n, np.nan)}, require_stop=True) is None
    assert x.backtest(base | {"long": one, "short": one & False}, direction="short") is None


def test_trade_table(spark):
    trades = spark.createDataFrame([("A", 10, 14, 1, 2.0, 1.0, "time"), ("A", 20, 20, -1, -1.0, None, "opposite_signal")], "instrument string, entry_tmin bigint, exit_tmin bigint, side int, points double, initial_risk double, reason string")
    costs = spark.createDataFrame([("A", 0.25, 20.0, 4.0, 1.0, None)], "instrument string, tick_size double, point_value double, commission_round_trip double, slippage_ticks_per_side double, extra double")
    a, b = x.trade_table(trades, costs).orderBy("entry_tmin").collect()
    assert (a.gross_usd, a.net_usd, a.stress_usd, a.moderate_usd, a.hold_min) == (40.0, 26.0, 16.0, 31.0, 5.0) and abs(a.r_multiple - 1.3) < 1e-12
    assert b.r_multiple is None and b.hold_min == 0.0
