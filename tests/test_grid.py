import datetime as dt

import numpy as np
from tickloom.operators import grid

SESSIONS = "instrument string, sday int, open_tmin bigint, close_tmin bigint, step_min int"
BARS = "instrument string, ts timestamp, tmin bigint, c double, v double"


def at(minute, second=0):
    return dt.datetime(1970, 1, 1) + dt.timedelta(minutes=minute, seconds=second)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_periods_and_marks(spark):
    sessions = spark.createDataFrame([("A", 1, 1000, 1012, 3), ("B", 1, 1000, 1002, 1), (None, 1, 0, 9, 1), ("C", 1, 5, 5, 1), ("C", 1, 5, 9, 0)], SESSIONS)
    bars = spark.createDataFrame(
        [("A", at(1001, 30), 1001, 10.0, 1.0), ("A", at(1001, 30), 1001, 10.0, 1.0), ("A", at(1003), 1003, None, 2.0), ("A", at(1006), 1006, float("inf"), 2.0), ("A", at(1010), 1010, float("nan"), None), (None, at(1003), 1003, 5.0, 1.0), ("B", None, 1000, 4.0, 1.0), ("A", at(1012), 1012, 7.0, 1.0), ("A", at(1000), None, 7.0, 1.0)],
        BARS,
    )
    out = {(r.source, r.tmin): r for r in grid.market_grid(bars, sessions).collect()}
    assert sorted(out) == [("A", 1000), ("A", 1003), ("A", 1006), ("A", 1009), ("B", 1000), ("B", 1001)]
    assert [out["A", t].n_obs for t in (1000, 1003, 1006, 1009)] == [2, 0, 1, 0]
    assert out["A", 1000].last == 10.0 and out["A", 1000].mark == "observed"
    assert out["A", 1006].last == float("inf") and out["A", 1003].mark in ("filled", "missing")
    assert out["B", 1000].n_obs == 1 and out["B", 1001].n_obs == 0


def test_estimate_is_linear_exact_and_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    minutes = np.sort(rng.choice(np.arange(1000, 1060), 40, replace=False))
    sessions = spark.createDataFrame([("A", 1, 1000, 1060, 2)], SESSIONS)
    line = spark.createDataFrame([("A", at(int(m)), int(m), 5.0 + 0.25 * int(m), 1.0) for m in minutes], BARS)
    for r in grid.market_grid(line, sessions).collect():
        if r.c_support >= 2.5 and r.c_fit is not None:
            assert abs(r.c_fit - (5.0 + 0.25 * r.tmin)) < 0.6  # one-sided ends fall back to the mean
    wavy = {int(m): float(rng.normal()) for m in minutes}
    got = grid.market_grid(spark.createDataFrame([("A", at(m), m, y, 1.0) for m, y in wavy.items()], BARS), sessions, bandwidth=3)
    for r in got.collect():
        d = np.array([(m - r.tmin) / 2 for m in wavy])
        w = np.maximum(0, 1 - (d / 3) ** 2) * (np.abs(d) < 3)
        y = np.array(list(wavy.values()))
        support = w.sum() ** 2 / (w**2).sum() if w.sum() else 0.0
        assert abs(support - r.c_support) < 1e-9
        if support >= 2:
            s0, s1, s2, t0, t1 = w.sum(), (w * d).sum(), (w * d * d).sum(), (w * y).sum(), (w * d * y).sum()
            det = s0 * s2 - s1 * s1
            want = (s2 * t0 - s1 * t1) / det if det > 1e-9 * s0 * s0 else t0 / s0
            assert abs(want - r.c_fit) < 1e-6
        else:
            assert r.c_fit is None


def test_quadratic_and_blocks(spark):
    """Sessions on both sides of many block borders; a quadratic is met exactly by degree 2."""
    sessions = spark.createDataFrame([("A", i, i * 100, i * 100 + 60, 1) for i in range(40)], SESSIONS)
    f = lambda m: 1.0 + 0.01 * m + 0.002 * (m % 100) ** 2
    bars = spark.createDataFrame([("A", at(i * 100 + m), i * 100 + m, f(i * 100 + m), 1.0) for i in range(40) for m in range(0, 60) if m % 7], BARS)
    out = grid.market_grid(bars, sessions, degree=2, bandwidth=5).collect()
    assert len(out) == 40 * 60
    assert sum(r.n_obs == 0 for r in out) == 40 * 9
    inner = [r for r in out if 10 <= r.tmin % 100 < 50]
    assert max(abs(r.c_fit - f(r.tmin)) for r in inner) < 1e-6


def test_empty(spark):
    sessions = spark.createDataFrame([("A", 1, 10, 12, 1)], SESSIONS)
    none = spark.createDataFrame([], BARS)
    assert [r.mark for r in grid.market_grid(none, sessions).collect()] == ["missing"] * 2
    assert grid.market_grid(none, spark.createDataFrame([], SESSIONS)).count() == 0


def test_a_wrong_close_changes_no_other_session(spark):
    from pyspark.sql import functions as F
    from tickloom.operators import grid

    sessions = spark.createDataFrame([("A", d, d * 1440 + 600, d * 1440 + 900, 5) for d in range(30)], "instrument string, sday int, open_tmin bigint, close_tmin bigint, step_min int")
    bars = spark.createDataFrame([("A", d * 1440 + 600 + 7 * k, float(k), 1.0) for d in range(30) for k in range(40)], "instrument string, tmin bigint, c double, v double")
    wrong = spark.createDataFrame([("B", 0, 600, 600 + 200_000, 7)], sessions.schema)
    plain = grid.regular_grid(bars, sessions)
    both = grid.regular_grid(bars, sessions.unionByName(wrong))
    key = lambda df: sorted(map(tuple, df.where("source = 'A'").collect()))
    assert key(both) == key(plain)
    assert sorted(r.tmin for r in both.where("source = 'B'").collect()) == list(range(600, 200_600, 7))
