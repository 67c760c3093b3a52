"""Bars of a market: integrity, identity, resampling, alignment, levels and masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType, TimestampType

from tickloom.functions import calendar as cal
from tickloom.operators.windows import Rolling

SCHEMA = (
    StructType().add("instrument", StringType()).add("ts", TimestampType()).add("tmin", LongType())
    .add("o", DoubleType()).add("h", DoubleType()).add("l", DoubleType()).add("c", DoubleType()).add("v", DoubleType())
)
PRICES = ("o", "h", "l", "c")


def schema_problems(df: DataFrame, expected: StructType = SCHEMA) -> list[str]:
    """Missing columns and columns of another type; extra ones are fine."""
    there = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: {'missing' if f.name not in there else there[f.name].simpleString() + ' is not ' + f.dataType.simpleString()}" for f in expected if there.get(f.name) != f.dataType]


def tradable(o: str = "o", h: str = "h", l: str = "l", c: str = "c", tolerance: float = 1e-9) -> Column:  # noqa: E741
    """Finite prices above zero that lie in order."""
    finite = reduce(lambda a, b: a & b, [F.col(x).isNotNull() & ~F.isnan(x) & (F.col(x) > 0) & (F.col(x) < float("inf")) for x in (o, h, l, c)])
    return finite & (F.col(h) >= F.greatest(o, c) - tolerance) & (F.col(l) <= F.least(o, c) + tolerance)


def clean_bars(bars: DataFrame) -> DataFrame:
    """One tradable bar for each (instrument, minute): the last received one, ties to the larger id.

    Volume is NULL where it is missing, NaN, negative or infinite; it is never filled. ``pos`` is
    the place in the group of session and contract, from 0.
    """
    ok = bars.where(F.col("instrument").isNotNull() & F.col("tmin").isNotNull() & tradable())
    v = F.when(~F.isnan("v") & (F.col("v") >= 0) & (F.col("v") < float("inf")), F.col("v"))
    # a maximum combines before the shuffle; a ranking window would not
    best = ok.groupBy("instrument", "tmin").agg(
        F.max(F.struct(F.coalesce(F.unix_micros("recv_ts"), F.lit(-(2**63))).alias("at"), F.coalesce("bar_id", F.lit(-1)).alias("id"), *PRICES, v.alias("v"), "seg", "sday", "sm", "rw")).alias("b")
    )
    return best.select("instrument", "tmin", *[f"b.{c}" for c in (*PRICES, "v", "seg", "sday", "sm", "rw")]).withColumn("pos", Rolling().position())


def integrity(bars: DataFrame) -> DataFrame:
    """One row of conditional counts for each instrument; all of them zero for an intact partition."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) <= 0) | (F.col(c) == float("inf"))
    n = lambda e: F.sum(F.coalesce(e, F.lit(False)).cast("bigint"))
    return bars.where("instrument is not null").groupBy("instrument").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.count_distinct("tmin")).alias("duplicate_minutes"),
        n(bad("o") | bad("h") | bad("l") | bad("c")).alias("bad_prices"),
        n(F.col("h") < F.greatest("o", "c") - 1e-9).alias("high_too_low"),
        n(F.col("l") > F.least("o", "c") + 1e-9).alias("low_too_high"),
        n(F.col("v") < 0).alias("negative_volume"),
        n((F.col("v") != F.floor("v")) & ~F.isnan("v")).alias("fractional_volume"),
        n(F.col("v").isNull() | F.isnan("v")).alias("missing_volume"),
        n(F.col("v") == 0).alias("zero_volume"),
    )


def resample(bars: DataFrame, k: int) -> DataFrame:
    """k-minute bars by UTC bucket. Volume is NULL if any is; seg and sday are -1 where a bucket straddles."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.max(c)).otherwise(-1).alias(c)
    return bars.groupBy("instrument", F.floor(F.col("tmin") / k).alias("bucket")).agg(
        F.min_by("o", "tmin").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "tmin").alias("c"),
        F.when(F.count("v") == F.count("*"), F.sum("v")).alias("v"), one("seg"), one("sday"), F.count("*").alias("n_bars"),
    )


def last_completed(bars: DataFrame, k: int, block: int = 1440) -> DataFrame:
    """Each bar with the last k-minute bucket that was complete at its close (as-of, backward).

    Buckets and bars meet by (instrument, block of minutes) only, so a hot instrument spreads; the
    newest bucket of each block is carried into blocks whose start has none before.
    """
    buckets = resample(bars, k).select("instrument", "bucket", F.col("c").alias("htf_c"), ((F.col("bucket") + 1) * k - 1).alias("known"))
    at = lambda t: F.floor(F.col(t) / block)
    known = buckets.select("instrument", at("known").alias("block"), F.col("known").alias("t"), F.struct("bucket", "htf_c").alias("x"), F.lit(0).alias("kind"))
    bounds = known.groupBy("instrument", "block").agg(F.max_by("x", "t").alias("x"))
    of_bars = bars.select("instrument", at("tmin").alias("block")).distinct()
    every = bounds.select("instrument", "block", "x").unionByName(of_bars.withColumn("x", F.lit(None).cast("struct<bucket:bigint,htf_c:double>"))).groupBy("instrument", "block").agg(F.max("x").alias("x"))
    before = Window.partitionBy("instrument").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("carried", F.last("x", ignorenulls=True).over(before)).select("instrument", "block", "carried")
    rows = bars.select("instrument", at("tmin").alias("block"), F.col("tmin").alias("t"), F.lit(None).cast("struct<bucket:bigint,htf_c:double>").alias("x"), F.lit(1).alias("kind"))
    inside = Window.partitionBy("instrument", "block").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = known.unionByName(rows).withColumn("x", F.last("x", ignorenulls=True).over(inside)).where("kind = 1")
    return seen.join(carried, ["instrument", "block"], "left").withColumn("y", F.coalesce("x", "carried")).select("instrument", F.col("t").alias("tmin"), "y.bucket", "y.htf_c")


def align(bars: DataFrame, primary: str, other: str) -> DataFrame:
    """The other market's bar of the identical minute; never filled forward."""
    a = bars.where(F.col("instrument") == primary)
    b = bars.where(F.col("instrument") == other).select("tmin", *[F.col(c).alias("e" + c) for c in (*PRICES, "v")], F.col("seg").alias("es_seg"), F.col("rw").alias("es_rw"))
    out = a.join(b, "tmin", "left")
    return out.withColumns({"evalid": F.col("ec").isNotNull(), "es_seg": F.coalesce("es_seg", F.lit(-1)), "es_rw": F.coalesce("es_rw", F.lit(False))})


def session_numbers(bars: DataFrame) -> DataFrame:
    """(instrument, sday, session_no): dense numbers of the sessions there."""
    order = Window.partitionBy("instrument").orderBy("sday")
    return bars.select("instrument", "sday").distinct().withColumn("session_no", F.row_number().over(order))


def prior_levels(bars: DataFrame) -> DataFrame:
    """High, low and last close of each session's regular hours and those of the session before."""
    rth = bars.where(F.col("sm").between(cal.RTH_OPEN, cal.RTH_CLOSE - 1))
    daily = rth.groupBy("instrument", "sday").agg(F.max("h").alias("hi"), F.min("l").alias("lo"), F.max_by("c", "tmin").alias("last"))
    every = session_numbers(bars).join(daily, ["instrument", "sday"], "left")
    order = Window.partitionBy("instrument").orderBy("sday")
    return every.select("instrument", "sday", "hi", "lo", "last", *[F.lag(c).over(order).alias("prev_" + c) for c in ("hi", "lo", "last")])


def decision_bars(bars: DataFrame) -> DataFrame:
    """Bars whose next bar is in the same group and can be entered in regular hours."""
    nxt = Rolling().lead(F.col("sm"))
    return bars.withColumn("is_dec", F.coalesce((nxt >= cal.RTH_OPEN) & (nxt < cal.LAST_ENTRY), F.lit(False)))


def roll_report(bars: DataFrame) -> DataFrame:
    """Segment changes of each instrument and whether they fall on a session's first bar."""
    firsts = bars.groupBy("instrument", "sday", "seg").agg(F.min("tmin").alias("first"))
    order = Window.partitionBy("instrument").orderBy("first")
    marked = firsts.withColumn("prev_seg", F.lag("seg").over(order)).withColumn("prev_sday", F.lag("sday").over(order))
    roll = F.col("prev_seg").isNotNull() & (F.col("seg") != F.col("prev_seg"))
    return marked.groupBy("instrument").agg(F.sum(roll.cast("int")).alias("rolls"), F.sum((roll & (F.col("sday") != F.col("prev_sday"))).cast("int")).alias("rolls_at_session_start"), F.count("*").alias("groups"))


def tail_sessions(bars: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("instrument").orderBy(F.desc("sday"))
    keep = bars.select("instrument", "sday").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return bars.join(keep.select("instrument", "sday"), ["instrument", "sday"], "left_semi")


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """A hash of all rows that does not depend on their order: count, XOR and wrapped sum of row hashes."""
    row = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(row).alias("hash_xor"), F.sum(F.pmod(row, F.lit(2**31))).alias("hash_sum"))
