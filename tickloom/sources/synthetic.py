"""Synthetic sessions and markets as plans: every bar is a function of its session, minute and seed.

Noise comes from a hash of (seed, minute), so any partition can be made alone and again. Prices that sum noise do it
inside a session first and over the sessions' totals, so a long history isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal

TICK = 0.25
COLUMNS = ("instrument", "sday", "tmin", "sm", "o", "h", "l", "c", "v", "seg", "rw")


def session_calendar(spark: SparkSession, first: int, last: int, *, from_sm: int = 0, minutes: int = cal.SESSION_END + 1, zone: str = "America/New_York") -> DataFrame:
    """(sday, tmin, sm) of every minute of the Monday-to-Friday sessions that end on the days ``first`` .. ``last``."""
    days = spark.range(first, last + 1).select(F.col("id").cast("int").alias("sday")).where(cal.weekday(F.col("sday")) < 5)
    start, _ = cal.session_bounds(F.col("sday"), zone)
    return days.withColumn("start", start).select("sday", "start", F.explode(F.sequence(F.lit(from_sm), F.lit(from_sm + minutes - 1))).alias("sm")).select("sday", (F.col("start") + F.col("sm")).alias("tmin"), "sm")


def noise(seed: int, n: int = 1) -> list[Column]:
    """``n`` independent numbers in [0, 1) of each row's minute."""
    return [F.pmod(F.xxhash64(F.col("tmin"), F.lit(seed), F.lit(k)), F.lit(1 << 30)) / (1 << 30) for k in range(n)]


def normal(seed: int) -> Column:
    a, b = noise(seed, 2)
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * 3.141592653589793 * b)


def summed(bars: DataFrame, step: str) -> DataFrame:
    """``total``: the sum of ``step`` up to each minute over all sessions."""
    order = Window.partitionBy("sday").orderBy("tmin").rowsBetween(Window.unboundedPreceding, 0)
    days = bars.groupBy("sday").agg(F.sum(step).alias("all"))
    before = days.select("sday", F.coalesce(F.sum("all").over(Window.orderBy("sday").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))  # one row for each session
    return bars.join(before, "sday").withColumn("total", F.col("before") + F.sum(step).over(order)).drop("before")


def priced(bars: DataFrame, instrument: str, step: str, start: float, wick: float, tick: float = TICK) -> DataFrame:
    """Bars whose closes are ``start`` plus the summed steps, on ticks, open at the last close, with wicks of ``wick``."""
    x = summed(bars, step).withColumn("c", F.round((F.lit(start) + F.col("total")) / tick) * tick)
    return x.withColumn("o", F.round((F.lit(start) + F.col("total") - F.col(step)) / tick) * tick).withColumns({"h": F.greatest("o", "c") + wick, "l": F.least("o", "c") - wick, "instrument": F.lit(instrument)})


def _whole(x: DataFrame, v: Column, seg: Column) -> DataFrame:
    return x.withColumns({"v": v.cast("double"), "seg": seg.cast("int"), "rw": F.lit(False)}).select(*COLUMNS)


def steady(spark: SparkSession, sday: int, step: float, start: float, minutes: int = 390) -> DataFrame:
    """Regular hours in which every close is ``step`` above (below) the last one; 0 is a flat market."""
    k = session_calendar(spark, sday, sday, from_sm=930, minutes=minutes).withColumn("c", F.lit(start) + step * (F.col("sm") - 929))
    wick = TICK if step else 0.0
    x = k.withColumn("o", F.col("c") - step).withColumns({"h": F.greatest("o", "c") + wick, "l": F.least("o", "c") - wick, "instrument": F.lit("SYN")})
    return _whole(x, F.lit(100), F.lit(0))


def random_walk(spark: SparkSession, first: int, last: int, *, seed: int = 7, start: float = 5000.0, roll_gap: float = 15.0, instrument: str = "SYN") -> DataFrame:
    """A driftless walk with quiet nights, more volume by day, and a new contract with a gap each quarter."""
    k = session_calendar(spark, first, last)
    quarter = F.year(cal.session_date(F.col("sday"))) * 4 + F.quarter(cal.session_date(F.col("sday")))
    day = F.col("sm").between(930, 1319)
    firsts = k.select("sday").distinct().withColumn("q", quarter).groupBy("q").agg(F.min("sday").alias("sday")).withColumn("opens", F.col("q") > F.min("q").over(Window.partitionBy())).select("sday", "opens")
    x = k.join(F.broadcast(firsts), "sday", "left")  # one row for each quarter
    gap = F.when(F.coalesce("opens", F.lit(False)) & (F.col("sm") == 0), roll_gap).otherwise(0.0)
    walk = priced(x.withColumn("step", normal(seed) * F.when(day, 1.2).otherwise(0.42) + gap), instrument, "step", start, 0.5)
    return _whole(walk, F.floor(20 + 80 * noise(seed + 1)[0]) * F.when(day, 4).otherwise(1), quarter)


def zero_edge(spark: SparkSession, first: int, last: int, *, seed: int = 1, start: float = 10_000.0) -> DataFrame:
    """Steps of one to four ticks with a fair sign."""
    a, b = noise(seed, 2)
    k = session_calendar(spark, first, last).withColumn("step", TICK * F.when(a < 0.5, -1).otherwise(1) * (1 + F.floor(4 * b)))
    return _whole(priced(k, "SYN", "step", start, 0.5), F.lit(100), F.lit(0))


def planted_edge(spark: SparkSession, first: int, last: int, *, seed: int = 2, start: float = 10_000.0, every: int = 30, bars: int = 5, drift: float = 2.0) -> DataFrame:
    """A walk of at most a tick in which the ``bars`` minutes after each ``every``-th rise by ``drift``; ``marker`` is the signal."""
    since = F.col("sm") % every
    noise_step = (F.floor(3 * noise(seed)[0]) - 1) * TICK
    k = session_calendar(spark, first, last).withColumn("step", F.when(since.between(1, bars), F.lit(drift)).otherwise(noise_step))
    return _whole(priced(k, "SYN", "step", start, TICK), F.lit(100), F.lit(0)).withColumn("marker", F.col("sm") % every == 0)


def correlated_pair(spark: SparkSession, first: int, last: int, *, seed: int = 3, rho: float = 0.9, missing_every: int = 97) -> DataFrame:
    """NQ and ES with correlated steps; ES lacks every ``missing_every``-th minute, which stays missing."""
    k = session_calendar(spark, first, last).withColumns({"z": normal(seed), "w": normal(seed + 1)})
    nq = priced(k.withColumn("step", F.col("z")), "NQ", "step", 12_000.0, TICK)
    es = priced(k.withColumn("step", 0.3 * (rho * F.col("z") + (1 - rho**2) ** 0.5 * F.col("w"))), "ES", "step", 3_500.0, TICK).where(F.col("tmin") % missing_every != 0)
    return _whole(nq, F.lit(100), F.lit(0)).unionByName(_whole(es, F.lit(100), F.lit(0)))
