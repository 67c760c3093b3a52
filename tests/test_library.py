import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickloom.functions import calendar as cal
from tickloom.operators import accounts, inference, market
from tickloom.sources import partitions


def test_clock():
    assert [cal.session_minute(c) for c in ("18:00", "09:30", "16:00", "17:00")] == [0, 930, 1320, 1380]
    assert all(cal.session_minute(cal.clock(m)) == m for m in range(1440))


def test_both_seasons_open_at_930(spark):
    rows = [(dt.datetime(2021, 3, 12, 14, 30),), (dt.datetime(2021, 3, 15, 13, 30),)]
    got = spark.createDataFrame(rows, "ts timestamp").select(*[c.alias(n) for n, c in cal.session_fields(F.col("ts")).items()]).collect()
    assert [r.sm for r in got] == [930, 930]
    assert got[1].sday - got[0].sday == 3


def test_holm_bh_against_loops(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(300) ** 3, 4)
    df = spark.createDataFrame([(f"k{i:03d}", float(x)) for i, x in enumerate(p)], "id string, p double")
    order = sorted(range(300), key=lambda i: (p[i], i))
    worst, holm, bh = 0.0, {}, {}
    for rank, i in enumerate(order):
        worst = max(worst, (300 - rank) * p[i])
        holm[f"k{i:03d}"] = min(1.0, worst)
    least = 1.0
    for rank in range(299, -1, -1):
        least = min(least, 300 * p[order[rank]] / (rank + 1))
        bh[f"k{order[rank]:03d}"] = least
    for got, want in ((inference.holm(df), holm), (inference.benjamini(df), bh)):
        assert all(abs(r.adjusted - want[r.id]) < 1e-9 for r in got.collect())


def test_clopper_pearson():
    low, high = inference.clopper_pearson(7, 20)
    assert abs(low - 0.15391) < 1e-4 and abs(high - 0.59219) < 1e-4
    assert inference.clopper_pearson(0, 10)[0] == 0.0 and inference.clopper_pearson(10, 10)[1] == 1.0
    assert abs(inference.clopper_pearson(0, 10)[1] - (1 - 0.025 ** 0.1)) < 1e-9


def test_account_rules():
    p = accounts.Profile(daily_limit=None, min_days=1, consistency=None)
    run = lambda x, **k: accounts.evaluate(accounts.Profile(**{**p.__dict__, **k}), np.array(x, float), np.minimum(np.array(x, float), 0), 0)
    assert run([-2000])[0] == "fail"  # a touch fails
    assert run([-1999.99])[0] == "open"
    assert run([3000])[0] == "pass" and run([3000], min_days=2)[0] == "open"
    assert run([2000, -2000])[0] == "fail"  # the floor has trailed to the start
    assert run([2000, -1999], mode="static")[0] == "open"
    assert run([3000, 3000], consistency=0.5)[0] == "pass"


def test_stop_ticks_round_up(spark):
    r = spark.sql("select 1.0D as d, 0.25D as t").select(accounts.stop_ticks(F.col("d"), F.col("t")).alias("a"), accounts.stop_ticks(F.lit(1.01), F.col("t")).alias("b")).first()
    assert (int(r.a), int(r.b)) == (4, 5)


def test_partitions_add_up(spark, data, tmp_path):
    bars = spark.read.parquet(f"{data}/bars.parquet")
    counts = partitions.write_partitions(bars, str(tmp_path / "p"))
    assert sum(counts.values()) == bars.count()
    some = partitions.read_partition(spark, str(tmp_path / "p"), "discovery", 15342, 15343, ["bar_id", "c"])
    assert some.columns == ["bar_id", "c"]
    assert "PartitionFilters: [isnotnull(part" in some._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        partitions.write_partitions(bars, str(tmp_path / "q"), (("one", 0, 10),))


def test_future_does_not_change_the_past(spark, data):
    """Rows before a cut are the same when everything after it is rewritten."""
    from tickloom.operators import features

    bars = market.clean_bars(spark.read.parquet(f"{data}/bars.parquet"))
    cut = 22094000
    changed = bars.withColumns({c: F.when(F.col("tmin") >= cut, F.col(c) * 1.5).otherwise(F.col(c)) for c in ("o", "h", "l", "c")})

    def past(x):
        y = features.base(x, 2)
        names = list(features.returns(y))
        return y.withColumns(features.returns(y)).where(F.col("tmin") < cut).select("instrument", "tmin", *[F.round(n, 9).alias(n) for n in names])

    assert past(bars).exceptAll(past(changed)).count() == 0


def test_hac(spark):
    x = np.random.default_rng(0).normal(0.1, 1, 80)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "entity string, day int, r double")
    z = x - x.mean()
    lrv = (z * z).mean() + sum(2 * (1 - k / 6) * (z[k:] * z[:-k]).mean() for k in range(1, 6))
    assert abs(inference.hac_t(df, 5).first().t - x.mean() / math.sqrt(max(lrv, 1e-12) / 80)) < 1e-9
