"""Exact hand cases of the position kernel and the fold."""

import numpy as np
from tickloom.operators import simulate as s
from tickloom.operators.sequential import cusum, ewm


def group(o, h, l, c, signal, risk=1.0):  # noqa: E741
    n = len(o)
    return {"tmin": np.arange(n), "o": np.array(o, float), "h": np.array(h, float), "l": np.array(l, float), "c": np.array(c, float), "signal": np.array(signal, float), "risk": np.full(n, risk), "instrument": np.full(n, "A", object), "sday": np.zeros(n, int)}


def one(*args, **template):
    got = s.managed(group(*args), **template)
    return {k: v[0] for k, v in got.items()}


FLAT = [100.0] * 4


def test_stop_beats_target():
    t = one(FLAT, [100, 103, 100, 100], [100, 98, 100, 100], FLAT, [1, 0, 0, 0], target_r=1.0)
    assert (t["r"], t["exit_tmin"], t["reason"]) == (-1.0, 1, "stop")


def test_break_even_from_the_next_bar():
    t = one(FLAT, [100, 101.5, 100, 100], [100, 99.5, 99.5, 100], FLAT, [1, 0, 0, 0], breakeven_r=1.0)
    assert (t["r"], t["exit_tmin"]) == (0.0, 2)


def test_partial():
    assert one(FLAT, [100, 101.5, 100, 100], [100, 99.5, 98.5, 100], FLAT, [1, 0, 0, 0], partial_r=1.0)["r"] == 0.0


def test_trail():
    t = one([100, 100, 102, 102], [100, 102.5, 102, 102], [100, 99.5, 100.5, 100.5], [100, 102, 101, 101], [1, 0, 0, 0], trail_r=1.0)
    assert (t["r"], t["exit_tmin"]) == (1.5, 2)


def test_mechanism_exit():
    t = one([100, 100, 101, 102, 102], [102] * 5, [99.5] * 5, [100, 101, 102, 102, 102], [1, 1, 0, 0, 0], mechanism=True)
    assert (t["exit_tmin"], t["reason"]) == (3, "mechanism")


def test_later_entry_only_after_the_exit_bar():
    got = s.managed(group([100.0] * 8, [100.2] * 8, [99.9] * 8, [100.0] * 8, [1, 1, 1, 1, 0, 0, 0, 0]), hold=2)
    assert got["entry_tmin"].tolist() == [1, 3] and got["exit_tmin"].tolist() == [2, 4]


def test_greedy_fold(spark):
    rows = [("a", 0, 5, 1.0), ("a", 3, 4, 9.0), ("a", 5, 9, 2.0), ("a", 9, None, 1.0), ("a", 9, 12, None), ("a", 10, 11, 3.0), ("b", 1, 2, -1.0)]
    df = spark.createDataFrame(rows, "k string, tmin bigint, exit_tmin bigint, pnl double")
    got = [(r.k, r.trade_no, r.tmin, r.pnl) for r in s.greedy(df, ["k"]).orderBy("k", "trade_no").collect()]
    assert got == [("a", 0, 0, 1.0), ("a", 1, 5, 2.0), ("a", 2, 10, 3.0), ("b", 0, 1, -1.0)]


def test_metrics(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, -2.0, -1.0, 3.0])] + [("b", 0, 1.0)], "k string, trade_no int, pnl double")
    got = {r.k: r for r in s.trade_metrics(df, ["k"]).collect()}
    assert (got["a"].n, got["a"].total, got["a"].max_drawdown, got["a"].losing_streak) == (4, 1.0, 3.0, 2)
    assert abs(got["a"].profit_factor - 4 / 3) < 1e-12 and got["b"].profit_factor is None and got["b"].never_lost


def test_outcomes_rising_market():
    n = 60
    c = 1000.0 + np.arange(n)
    g = {"instrument": np.full(n, "A", object), "sday": np.zeros(n, int), "tmin": np.arange(n), "o": np.r_[c[0], c[:-1]], "h": c + 0.25, "l": np.r_[c[0], c[:-1]] - 0.25, "c": c, "is_dec": np.arange(n) < n - 1, "scale": np.full(n, 1.0), "tick": np.full(n, 0.25), "sm": 930 + np.arange(n)}
    out = s.first_exits(g, tuple(e for e in s.EXITS if e[0] == "S1_T15"))
    long = {t: (p, e) for t, p, e, d in zip(out["tmin"], out["pnl"], out["exit_tmin"], out["dir"], strict=True) if d == 1}
    assert long[10] == (15.0, 25) and long[57] == (2.0, 59)


def brute_exit(g, t, multiple, hold, target, side):
    """One entry, bar by bar, from the rules alone."""
    n, e = len(g["tmin"]), t + 1
    tick = g["tick"][t]
    stop = np.ceil(multiple * np.sqrt(10) * g["scale"][t] / tick - 1e-9) * tick
    price = g["o"][e]
    floor, goal = price - side * stop, price + side * stop * (target or 0)
    for i in range(e, n):
        o, low, high = g["o"][i], *((g["l"][i], g["h"][i]) if side > 0 else (g["h"][i], g["l"][i]))
        stopped, won = side * (low - floor) <= 0, bool(target) and side * (high - goal) >= tick
        if stopped or won:
            if i > e and side * (o - floor) <= 0:
                return side * (o - price), i, "gap_stop"
            if i > e and target and side * (o - goal) >= tick:
                return side * (goal - price), i, "target"
            return (side * (floor - price), i, "stop") if stopped else (side * (goal - price), i, "target")
        if hold and g["tmin"][i] - g["tmin"][e] >= hold - 1:
            return side * (g["c"][i] - price), i, "time"
        if i == n - 1 or g["sm"][i + 1] >= 1320 or g["sm"][i] >= 1320:
            return side * (g["c"][i] - price), i, "flat"


def test_outcomes_against_a_bar_by_bar_loop():
    rng = np.random.default_rng(3)
    for start in (930, 1290):
        n = 90
        t = np.cumsum(rng.integers(1, 3, n))
        c = 100 + np.cumsum(rng.integers(-4, 5, n)) * 0.25
        o = c + rng.integers(-6, 7, n) * 0.25
        g = {"instrument": np.full(n, "A", object), "sday": np.zeros(n, int), "tmin": t, "o": o, "h": np.maximum(o, c) + rng.integers(0, 4, n) * 0.25, "l": np.minimum(o, c) - rng.integers(0, 4, n) * 0.25, "c": c, "is_dec": rng.random(n) < 0.8, "scale": np.where(rng.random(n) < 0.1, np.nan, rng.random(n)), "tick": np.full(n, 0.25), "sm": start + t}
        out = s.first_exits(g, rows_at_once=7)
        got = {(a, b, d): (p, e, w) for a, b, d, p, e, w in zip(out["tmin"], out["exit_id"], out["dir"], out["pnl"], out["exit_tmin"], out["reason"], strict=True)}
        seen = 0
        for k in np.flatnonzero(g["is_dec"][:-1] & ~np.isnan(g["scale"][:-1])):
            for name, multiple, hold, target in s.EXITS:
                for side in (1, -1):
                    if np.ceil(multiple * np.sqrt(10) * g["scale"][k] / 0.25 - 1e-9) < 1:
                        continue
                    pnl, i, why = brute_exit(g, k, multiple, hold, target, side)
                    assert got[t[k], name, side] == (pnl, t[i], why)
                    seen += 1
        assert seen == len(got)


def test_targets_need_a_tick_beyond_and_gaps_fill_at_the_limit():
    t = one(FLAT, [100, 101, 101.25, 100], [100, 99.5, 100, 100], FLAT, [1, 0, 0, 0], target_r=1.0)
    assert (t["r"], t["exit_tmin"], t["reason"]) == (1.0, 2, "target")
    t = one([100, 100, 104, 104], [100, 100.5, 105, 105], [100, 99.5, 103, 103], [100, 100, 104, 104], [1, 0, 0, 0], target_r=2.0, partial_r=1.0)
    assert (t["r"], t["exit_tmin"], t["reason"]) == (1.5, 2, "gap_target")
    t = one([100, 100, 101.1, 101.1], [100, 100.5, 101.1, 101.1], [100, 99.5, 101, 101], [100, 100, 101, 101], [1, 0, 0, 0], target_r=1.0)
    assert t["reason"] == "flat"  # 0.1 beyond is not a fill


def test_flat_before_sixteen():
    g = group([100.0] * 6, [100.2] * 6, [99.9] * 6, [100.0] * 6, [1, 0, 0, 0, 0, 0]) | {"sm": 1316 + np.arange(6)}
    assert s.managed(g)["exit_tmin"].tolist() == [3]


def test_spec_metrics(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1, 1.0, 2.0, 2011), ("a", 2, -1.5, 2.0, 2014), ("a", 3, 0.5, 1.0, 2020)], "k string, entry_tmin bigint, r double, risk double, y int")
    r = s.spec_metrics(df, ["k"], cost=F.lit(0.2), stress=F.lit(0.4), year=F.col("y"), shadow=0.1).first()
    assert (r.trades, r.active_years, r.trades_1, r.trades_2, r.trades_3) == (3, 3, 1, 1, 1)
    assert np.allclose([r.net_r, r.stress_net_r, r.max_drawdown_r, r.profit_factor, r.matched_excess_r, r.net_r_2], [-0.4, -0.8, 1.6, 0.75, -0.4 / 3 - 0.1, -1.6])


def test_recursions():
    x = np.array([np.nan, 1.0, np.nan, 3.0, 5.0])
    assert np.allclose(ewm(x, 3, 1), [np.nan, 1, 1, 2, 3.5], equal_nan=True)
    assert np.isnan(ewm(x, 3)[1]) and ewm(x, 3)[3] == 2
    assert cusum(np.array([1.0, 1.0, 1.0, -3.0, -3.0]), 0.5, 1.2).tolist() == [0, 0, 1, -1, -1]


def test_sums_are_added_in_the_order_of_trades(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 3, (3, 120)), 5)
    df = spark.createDataFrame([(f"k{k}", i, float(x[k, i])) for i in rng.permutation(120).tolist() for k in range(3)], "k string, trade_no int, pnl double")
    got = {r.k: r for r in s.trade_metrics(df, ["k"]).collect()}
    for k in range(3):
        total, gain, loss = 0.0, 0.0, 0.0
        for v in x[k].tolist():
            total, gain, loss = total + v, gain + max(v, 0.0), loss + max(-v, 0.0)
        assert (got[f"k{k}"].total, got[f"k{k}"].profit_factor) == (total, gain / loss)


def test_rule_stats_equals_its_sql_at_halves(spark):
    from pathlib import Path

    import duckdb

    import __spark_entry__ as entry
    from test_queries import rows

    folder, db = "/root/testdata/sf0.01", duckdb.connect()
    for path in Path(folder).iterdir():
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    assert rows(entry.queries()["rule_stats"](spark, folder).toPandas()) == rows(db.execute(entry.oracle_sql()["rule_stats"]).df())
