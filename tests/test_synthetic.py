"""Known properties of the synthetic markets, and trades on them."""

import numpy as np
from pyspark.sql import functions as F
from tickloom.operators import execution, market
from tickloom.sources import synthetic as s

MONDAY = 18540  # 2020-10-05 is day 18540


def test_calendar_skips_weekends_and_keeps_the_clock(spark):
    k = s.session_calendar(spark, MONDAY, MONDAY + 8)
    days = k.groupBy("sday").agg(F.count("*").alias("n"), F.min("sm").alias("a"), F.max("sm").alias("b")).orderBy("sday").collect()
    assert [r.sday - MONDAY for r in days] == [0, 1, 2, 3, 4, 7, 8] and {(r.n, r.a, r.b) for r in days} == {(1380, 0, 1379)}


def test_a_rising_market_pays_its_points(spark):
    for step, side in ((1.0, 1), (-1.0, -1)):
        bars = s.steady(spark, MONDAY, step, 1000.0).withColumn("pos", F.col("sm") - 930)
        x = execution.window_masks(bars, 935, 1275, 1320).withColumns({"long": F.col("sm") == 1000, "short": F.lit(False), "stop": F.lit(None).cast("double"), "target": F.lit(None).cast("double")})
        (t,) = execution.run_signals(x, hold=10).collect()
        assert t.points == 10 * side and t.entry_tmin + 9 == t.exit_tmin and t.reason == "time"
    assert s.steady(spark, MONDAY, 0.0, 1500.0).where("o <> c or h <> l").count() == 0


def test_walks(spark):
    z = s.zero_edge(spark, MONDAY, MONDAY + 4)
    d = z.select(F.col("c") - F.col("o")).toPandas().to_numpy().ravel()
    assert set(np.abs(d) / 0.25) == {1, 2, 3, 4} and abs(d.mean()) < 5 * d.std() / len(d) ** 0.5
    w = s.random_walk(spark, MONDAY - 10, MONDAY + 2)
    assert market.schema_problems(w.withColumn("ts", F.timestamp_seconds(F.col("tmin") * 60))) == [] and w.select("seg").distinct().count() == 2
    assert w.where(~market.tradable()).count() == 0 and sorted(map(tuple, w.where(F.col("sday") == MONDAY).collect())) == sorted(map(tuple, s.random_walk(spark, MONDAY - 10, MONDAY + 2).repartition(5).where(F.col("sday") == MONDAY).collect()))


def test_planted_edge_is_captured_exactly(spark):
    bars = s.planted_edge(spark, MONDAY, MONDAY).withColumn("pos", F.col("sm"))
    x = execution.window_masks(bars, 0, 1375, 1380).withColumns({"long": F.col("marker"), "short": F.lit(False), "stop": F.lit(None).cast("double"), "target": F.lit(None).cast("double")})
    got = execution.run_signals(x, hold=5).collect()
    assert len(got) == 46 and {t.points for t in got} == {10.0}


def test_pair_gaps_stay_missing(spark):
    both = s.correlated_pair(spark, MONDAY, MONDAY)
    a = market.align(both, "NQ", "ES")
    assert a.where("not evalid").count() == a.where("tmin % 97 = 0").count() == a.where("ec is null").count()
    r = a.where("evalid").select(F.corr(F.col("c") - F.col("o"), F.col("ec") - F.col("eo"))).first()[0]
    assert 0.75 < r < 0.97
