import datetime as dt

import numpy as np
from tickloom.operators import plausibility as p

BARS = "bar_id bigint, instrument string, ts timestamp, o double, h double, l double, c double, v double, at string"
START = dt.datetime(2020, 1, 1)


def market(seed, n, instrument, first_id):
    rng = np.random.default_rng(seed)
    c = np.round(1000 * np.exp(np.cumsum(rng.standard_t(4, n) * 3e-4)), 2)
    o = np.r_[c[0], c[:-1]]
    h, l = np.round(np.maximum(o, c) + rng.random(n) * 0.3, 2), np.round(np.minimum(o, c) - rng.random(n) * 0.3, 2)
    v = rng.poisson(np.exp(rng.normal(6, 0.5, n))).astype(float)
    return [[first_id + i, instrument, START + dt.timedelta(minutes=i), float(o[i]), float(h[i]), float(l[i]), float(c[i]), float(v[i]), "x"] for i in range(n)]


def flagged(spark, rows, **options):
    return {r.bar_id for r in p.implausible_ids(spark.createDataFrame([tuple(r) for r in rows], BARS), **options).collect()}


def planted(seed=3, n=1500):
    rows, cases = market(seed, n, "A", 0), set()
    rows[200][6] *= 1.08
    rows[200][4] = max(rows[200][4], rows[200][6])
    cases.add(200)
    for i in (400, 401, 402):  # three readings a hundred times too large
        for k in (3, 4, 5, 6):
            rows[i][k] *= 100
        cases.add(i)
    for i in range(600, 615):  # a stuck close, the first reading included
        rows[i][6] = rows[600][6]
        rows[i][4], rows[i][5] = max(rows[i][4], rows[i][6]), min(rows[i][5], rows[i][6])
        cases.add(i)
    rows[800][7], rows[801][7], rows[802][4], rows[803][6] = -5.0, 10.5, rows[802][5] - 1, 0.0
    cases |= {800, 801, 802, 803}
    for i in range(1000, n):  # a move that lasts is none
        for k in (3, 4, 5, 6):
            rows[i][k] = rows[i][k] * 1.2
    rows[1000][3] = rows[1000][6]
    rows[1000][4], rows[1000][5] = rows[1000][6] + 0.1, rows[1000][6] - 0.1
    rows[1200][6] = rows[1201][7] = float("nan")
    rows[1202][6] = rows[1203][7] = rows[1204][4] = None
    return rows, cases


def test_planted_cases(spark):
    rows, cases = planted()
    got = flagged(spark, rows)
    assert cases <= got
    assert len(got - cases) <= 2


def test_order_repeats_and_blocks_do_not_matter(spark):
    rows, cases = planted(5)
    got = flagged(spark, rows)
    again = rows + rows[:50] + [rows[400]]
    np.random.default_rng(0).shuffle(again)
    assert flagged(spark, again) == got
    cut = flagged(spark, rows, block_readings=400)
    assert cases <= cut and len(cut ^ got) <= 3


def test_decades_of_one_source(spark):
    from pyspark.sql import functions as F

    rows = market(7, 1200, "A", 0)
    rows[300][6] *= 1.1
    rows[300][4] = rows[300][6]
    cycles = spark.range(30).withColumnRenamed("id", "k")  # 36,000 readings over 58 years, a cycle every two
    long = spark.createDataFrame([tuple(r) for r in rows], BARS).join(F.broadcast(cycles))
    long = long.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") - F.col("k") * 2 * 365 * 86_400_000_000)).withColumn("bar_id", F.col("bar_id") + 10_000 * F.col("k"))
    got = {r.bar_id for r in p.implausible_ids(long).collect()}
    assert {300 + 10_000 * k for k in range(30)} <= got and len(got) <= 40


def test_odd_rows(spark):
    rows = [[1, None, START, 1.0, 0.5, 0.4, 1.0, 1.0, "x"], [2, "A", None, 1.0, 2.0, 0.5, float("inf"), 1.0, "x"], [3, "A", START, None, None, None, None, None, "x"], [None, "A", START, -1.0, 1.0, 1.0, 1.0, 1.0, "x"], [4, "B", START, 5.0, 6.0, 4.0, 5.0, 2.0, "x"], [4, "B", START, 5.0, 6.0, 4.0, 5.0, 2.0, "x"]]
    assert flagged(spark, rows) == {1, 2}
    assert p.implausible_readings(spark.createDataFrame([], BARS)).count() == 0


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    move, start = p.transitions()
    emit = rng.random((4, 1, 4))
    got = p.forward_backward(emit, move, start)[:, 0]
    want = np.zeros((4, 4))
    for path in itertools.product(range(4), repeat=4):
        w = start[path[0]] * emit[0, 0, path[0]]
        for t in range(1, 4):
            w *= move[path[t - 1], path[t]] * emit[t, 0, path[t]]
        for t, s in enumerate(path):
            want[t, s] += w
    assert np.allclose(got, want / want.sum(1, keepdims=True))
