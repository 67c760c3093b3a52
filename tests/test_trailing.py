import datetime as dt
import random

from tickloom.operators import trailing

STREAM = "candidate_id string, session int, r double, n int, recv_ts timestamp, entity string"


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"c{rng.randrange(5)}", rng.randrange(100, 190), rng.choice([None, float("nan"), round(rng.gauss(0, 1), 3)]), rng.choice([None, 0, 1, 3]), rng.choice([None, dt.datetime(2020, 1, rng.randrange(1, 20))]), "x") for _ in range(150)]
    rows += rows[:20] + [(None, 5, 1.0, 1, None, "x"), ("c0", None, 1.0, 1, None, "x")]
    days = trailing.latest_delivery(spark.createDataFrame(rows, STREAM), "candidate_id", "session", "recv_ts", "r", "n")
    got = {(r.entity, r.day): r for r in trailing.trailing_totals(days, (1, 7, 30, 45)).collect()}
    best: dict = {}
    for c, s, r, n, at, _ in rows:
        if c is None or s is None:
            continue
        key = (at is not None, at or dt.datetime.min, 0.0 if r is None or r != r else r, n or 0)
        best[c, s] = max(best.get((c, s), (False, dt.datetime.min, -9e9, -1)), key)
    want = 0
    for c in {c for c, _ in best}:
        mine = {s: v for (x, s), v in best.items() if x == c}
        first = min(mine)
        for day in range(first, max(mine) + 1):
            row = got[c, day]
            want += 1
            for w in (1, 7, 30, 45):
                inside = [mine[d] for d in range(day - w + 1, day + 1) if d in mine]
                assert abs(row[f"r_sum_{w}"] - sum(v[2] for v in inside)) < 1e-8
                assert row[f"n_sum_{w}"] == sum(v[3] for v in inside)
                assert abs(row[f"n_avg_{w}"] - sum(v[3] for v in inside) / min(w, day - first + 1)) < 1e-8
    assert want == len(got)


def test_recorded_arrays(spark):
    rows = [("a", 10, [1.0, None, float("nan")], [1, None], dt.datetime(2020, 1, 2)), ("a", 10, [9.0], [9], dt.datetime(2020, 1, 3)), ("b", None, [1.0], [1], None), (None, 1, [1.0], [1], None), ("c", 3, None, None, None)]
    df = spark.createDataFrame(rows, "candidate_id string, first_session int, daily_r array<double>, daily_count array<int>, recorded_ts timestamp")
    assert sorted(tuple(r) for r in trailing.recorded_days(df).collect()) == [("a", 10, 1.0, 1), ("a", 11, 0.0, 0), ("a", 12, 0.0, 0)]
    assert trailing.trailing_totals(trailing.recorded_days(df.limit(0))).count() == 0


def test_fill_leaves_out_only_days_without_sums(spark):
    import random

    rng = random.Random(4)
    rows = [(e, d, 1.0, rng.randrange(0, 5)) for e in "abc" for d in sorted(rng.sample(range(0, 400), 9))] + [("a", 2_000_000, 1.0, 3)]
    df = spark.createDataFrame(rows, "entity string, day int, r double, n bigint")
    some = {(r.entity, r.day): (r.n_sum_7, r.n_sum_30, r.n_avg_30) for r in trailing.trailing_totals(df, fill=30).collect()}
    dense = {(r.entity, r.day): (r.n_sum_7, r.n_sum_30, r.n_avg_30) for r in trailing.trailing_totals(df.where("day < 1000")).collect()}
    assert all(dense[k] == v for k, v in some.items() if k[1] < 430 and k in dense) and some["a", 2_000_000][1] == 3
    assert all(v[1] == 0 for k, v in dense.items() if k not in some) and len(some) < 3 * 9 * 32
