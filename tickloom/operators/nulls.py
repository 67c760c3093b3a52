"""Surrogate worlds. Signs and donors come from arithmetic on keys, so a world is reproducible data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import Rolling

R = Rolling()


def arithmetic_sign(key: str, world: int = 0) -> str:
    """+1 or -1 from an integer expression, by two steps of a multiplicative generator."""
    return f"(1 - 2 * (((({key}) * 48271 + {11 + 2 * world}) % 2147483647 * 16807 % 2147483647) % 2))"


def flip_path(bars: DataFrame) -> DataFrame:
    """Prices rebuilt from steps of sign ``s``: a bar's open, high and low keep their distances from the close before
    (from the open at a contract's first bar), turned with the sign. The path runs on through sessions; the gap of a
    contract change stays as it was. Sums run inside sessions and over sessions' totals, so no instrument is one task.
    """
    order = Window.partitionBy("instrument", "sday").orderBy("tmin")
    ends = bars.groupBy("instrument", "sday").agg(F.max_by(F.struct("c", "seg"), "tmin").alias("last"))
    before = ends.select("instrument", "sday", F.lag("last").over(Window.partitionBy("instrument").orderBy("sday")).alias("z"))
    x = bars.join(before, ["instrument", "sday"]).withColumns({"pc": F.coalesce(F.lag("c").over(order), F.col("z.c")), "pseg": F.coalesce(F.lag("seg").over(order), F.col("z.seg"))})
    first = F.col("pc").isNull() | ~F.col("seg").eqNullSafe(F.col("pseg"))
    x = x.withColumn("first", first).withColumns({"ref": F.when(F.col("first"), F.col("o")).otherwise(F.col("pc")), "gap": F.when(F.col("first"), F.coalesce(F.col("o") - F.col("pc"), F.lit(0.0))).otherwise(0.0)})
    # the very first bar starts at its own open
    x = x.withColumn("step", F.when(F.col("pc").isNull(), F.col("o")).otherwise(0.0) + F.col("gap") + F.col("s") * (F.col("c") - F.col("ref")))
    sums = x.groupBy("instrument", "sday").agg(F.sum("step").alias("all"))
    start = sums.select("instrument", "sday", F.coalesce(F.sum("all").over(Window.partitionBy("instrument").orderBy("sday").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("start"))
    y = x.join(start, ["instrument", "sday"]).withColumn("path", F.col("start") + F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the new reference: the path before this bar's own move
    y = y.withColumn("at", F.col("path") - F.col("s") * (F.col("c") - F.col("ref")))
    up, away = F.col("s") > 0, lambda c: F.col(c) - F.col("ref")
    return y.withColumns({
        "o": F.col("at") + F.col("s") * away("o"), "h": F.col("at") + F.when(up, away("h")).otherwise(-away("l")), "l": F.col("at") + F.when(up, away("l")).otherwise(-away("h")), "c": F.col("path"),
    }).select(*bars.columns)


def block_sign_flip(bars: DataFrame, minutes: int = 30, world: int = 0) -> DataFrame:
    """Steps of each clock block keep or turn their sign, in all markets alike."""
    return flip_path(bars.withColumn("s", F.expr(arithmetic_sign(f"tmin div {minutes}", world)))).drop("s")


def minute_sign_flip(bars: DataFrame, world: int = 0) -> DataFrame:
    """Each minute's step keeps or turns its sign, in all markets alike."""
    return flip_path(bars.withColumn("s", F.expr(arithmetic_sign("tmin", world)))).drop("s")


def session_reflection(bars: DataFrame) -> DataFrame:
    """Prices mirrored at the group's first open; high and low change places."""
    turn = lambda c: 2 * F.col("o0") - F.col(c)
    return bars.withColumn("o0", F.first("o").over(R.so_far)).withColumns({"o": turn("o"), "h": turn("l"), "l": turn("h"), "c": turn("c")}).drop("o0")


def numbered_groups(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("instrument")
    g = bars.select("instrument", "sday", "seg").distinct()
    return g.withColumns({"k": F.row_number().over(w.orderBy("sday", "seg")) - 1, "m": F.count("*").over(w)})


def donor_resample(bars: DataFrame, a: int = 5, b: int = 3) -> DataFrame:
    """Each bar's volume from the same minute of a donor session; its own where the donor lacks the minute."""
    n = numbered_groups(bars)
    z = n.select("instrument", F.col("k").alias("zk"), F.col("sday").alias("dday"), F.col("seg").alias("dseg"))
    d = n.withColumn("zk", (F.col("k") * a + b) % F.col("m")).join(z, ["instrument", "zk"]).select("instrument", "sday", "seg", "dday", "dseg")
    source = bars.select("instrument", F.col("sday").alias("dday"), F.col("seg").alias("dseg"), "sm", F.col("v").alias("dv"), F.lit(True).alias("there"))
    j = bars.join(d, ["instrument", "sday", "seg"]).join(source, ["instrument", "dday", "dseg", "sm"], "left")
    return j.withColumns({"donated": F.coalesce("there", F.lit(False)), "v": F.coalesce("dv", "v")}).drop("dday", "dseg", "dv", "there")


def session_permutation(bars: DataFrame, by: int = 1) -> DataFrame:
    """Each group's source group among those of the same instrument with identical minutes, in a cycle."""
    minutes = F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("sm")), lambda x: x.cast("string")), ","))
    s = bars.groupBy("instrument", "sday", "seg").agg(minutes.alias("sig"))
    w = Window.partitionBy("instrument", "sig")
    n = s.withColumns({"k": F.row_number().over(w.orderBy("sday", "seg")) - 1, "m": F.count("*").over(w)})
    z = n.select("instrument", "sig", F.col("k").alias("zk"), F.col("sday").alias("source_sday"), F.col("seg").alias("source_seg"))
    return n.withColumn("zk", (F.col("k") + by) % F.col("m")).join(z, ["instrument", "sig", "zk"]).select("instrument", "sday", "seg", "source_sday", "source_seg")
