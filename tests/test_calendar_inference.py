"""Inference over whole calendars against SQL and by hand."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from test_queries import rows


@pytest.mark.parametrize("name", ["hac_t_calendar", "holm_calendar", "bh_by_calendar"])
def test_matches_sql(spark, data, name):
    db = duckdb.connect()
    for path in Path(data).iterdir():
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    assert rows(entry.queries()[name](spark, data).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).df())


def test_days_without_rows_count(spark, tmp_path):
    rows_ = [("a", d, r, 1, None) for d, r in ((0, 2.0), (9, 1.0), (19, 3.0))]
    spark.createDataFrame(rows_, "candidate_id string, session int, r double, n int, recv_ts timestamp").write.parquet(str(tmp_path / "daily_streams.parquet"))
    (got,) = entry.queries()["hac_t_calendar"](spark, str(tmp_path)).collect()
    assert got.n == 20 and got.mean == 0.3


def test_family_inference_against_a_matrix(spark):
    import numpy as np
    from tickloom.operators import inference as inf

    rng = np.random.default_rng(2)
    n, reps = 60, 40
    x = rng.normal(0, 1, (n, 7)) + np.array([0.6, 0.3, 0, 0, 0, -0.2, 0.3])
    x[rng.random(x.shape) < 0.3] = 0.0
    x[0], x[-1] = 0.1, 0.1
    df = spark.createDataFrame([(f"c{j}", 100 + i, float(x[i, j])) for i in range(n) for j in range(7) if x[i, j]], "entity string, day int, r double")
    got = {r.entity: r for r in inf.family_inference(df, reps=reps, block=5, lags=3, seed=4).collect()}
    t = [inf.bartlett_t(x[:, j], 3) for j in range(7)]
    idx = inf.stationary_blocks(n, 5, reps, 4)
    null = np.array([[inf.bartlett_t((x[:, j] - x[:, j].mean())[i], 3) for j in range(7)] for i in idx])
    order, prior = np.argsort(-np.array(t)), 0.0
    for rank, j in enumerate(order):
        prior = max(prior, (1 + (null[:, order[rank:]].max(1) >= t[j]).sum()) / (reps + 1))
        assert abs(got[f"c{j}"].t - t[j]) < 1e-12 and got[f"c{j}"].p == prior
    assert {r.global_p for r in got.values()} == {(1 + (null.max(1) >= max(t)).sum()) / (reps + 1)}
    assert inf.family_inference(df.limit(0)).count() == 0


def test_one_stream_equals_the_grouped_t(spark):
    import numpy as np
    from tickloom.operators import inference as inf

    x = np.random.default_rng(8).normal(0.1, 1, 90)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "entity string, day int, r double")
    assert abs(inf.hac_t(df, 20).first().t - inf.bartlett_t(x, 20)) < 1e-9


def test_stationary_blocks_have_the_mean_length():
    import numpy as np
    from tickloom.operators.inference import stationary_blocks

    i = stationary_blocks(2000, 20, 50, 1)
    breaks = ((i[:, 1:] - i[:, :-1]) % 2000 != 1).mean()
    assert i.min() >= 0 and i.max() < 2000 and abs(1 / breaks - 20) < 1.5


def test_a_breach_below_the_daily_limit_fails():
    import numpy as np
    from tickloom.operators.accounts import Profile, evaluate

    pnl = np.array([-2500.0, 100.0, 100.0, 100.0, 100.0])
    assert evaluate(Profile(), pnl, np.minimum(pnl, 0), 0)[0] == "fail"
    pnl[0] = -1500.0
    assert evaluate(Profile(), pnl, np.minimum(pnl, 0), 0)[2] == 50_000 - 1000 + 400


def test_bh_by_of_many_candidates_in_one_pass(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from tickloom.operators import inference as inf
    from tickloom.plans.research import bh_by_of

    m = 5000
    t = spark.range(m).select(F.col("id").cast("string").alias("candidate_id"), (F.pmod(F.col("id") * 7919, F.lit(m)) / 600.0).alias("t"))
    got = sorted(bh_by_of(t).collect(), key=lambda r: r["rank"])
    p = np.sort(np.round(1 / (1 + np.exp(1.702 * np.arange(m) / 600.0)), 10))
    running = np.minimum.accumulate((m * p / np.arange(1, m + 1))[::-1])[::-1]
    assert [r["rank"] for r in got] == list(range(1, m + 1))
    assert np.allclose([r.bh for r in got], np.minimum(running, 1), atol=2e-8, rtol=0)
    assert np.allclose([r.by_adjusted for r in got], np.minimum(running * (1 / np.arange(1, m + 1)).sum(), 1), atol=2e-8, rtol=0)
    sizes = [1, 2, 999, 1000, 1001, 20_000, 3_000_000]
    sums = spark.createDataFrame([(n,) for n in sizes], "m bigint").select("m", inf.harmonic(F.col("m")).alias("h")).collect()
    assert all(abs(r.h - (1 / np.arange(1, r.m + 1)).sum()) < 1e-12 for r in sums)
