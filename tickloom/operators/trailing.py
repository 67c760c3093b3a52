"""Trailing totals by binary doubling over a dense calendar.

The blocks S1, S2, S4, ... hold the totals of 1, 2, 4, ... days ending at a day, each made of
two blocks of half the length: S2k(d) = Sk(d) + Sk(d - k). A window of any length is put
together from the blocks of its binary digits, one after another into the past: 30 days are
S16(d) + S8(d - 16) + S4(d - 24) + S2(d - 28). Five doublings serve every window up to 63 days.

Plan: deliveries are reduced to one row for each (entity, day) with a partial aggregate
before the shuffle, so a hot entity's repeats never meet in one task. Then one shuffle by
entity; filling the calendar (each row is expanded up to the next one) and all shifts are
windows on that one order. An entity's group holds at most one row for each day of its span.

Defined results for odd input
    * NULL entity or NULL day: left out. NULL n or r (or NaN r) counts as 0.
    * of several deliveries for a day the one with the latest receipt counts; a NULL receipt
      is earliest; ties go to the larger (r, n).
    * days before an entity's first day hold nothing; averages divide by the calendar days
      of the window that exist, so by fewer at the start.
    * empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_delivery(rows: DataFrame, entity: str, day: str, received: str, amount: str, count: str) -> DataFrame:
    """(entity, day, r, n): the delivery with the latest receipt for each entity and day."""
    r = F.col(amount).cast("double")
    return (
        rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(day).cast("int").alias("day"))
        .agg(
            F.max(
                F.struct(
                    F.coalesce(F.unix_micros(received), F.lit(-(2**63))).alias("at"),
                    F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)).alias("r"),
                    F.coalesce(F.col(count).cast("bigint"), F.lit(0)).alias("n"),
                )
            ).alias("best")
        )
        .select("entity", "day", "best.r", "best.n")
    )


def trailing_totals(days: DataFrame, windows: Sequence[int] = (7, 30), *, fill: int | None = None) -> DataFrame:
    """``days`` has one row for each (entity, day) with r and n; every calendar day between an
    entity's first and last one comes out with ``r_sum_W, n_sum_W, r_avg_W, n_avg_W``.

    ``fill``: only the days up to so many after one with a row, at least the longest window; all others have zero
    sums. Without it a wrong day far ahead makes a row for each day up to it."""
    if fill is not None and fill < max(windows):
        raise ValueError("fill must be at least the longest window")
    whole = Window.partitionBy("entity").orderBy("day")
    order = whole if fill is None else Window.partitionBy("entity", "island").orderBy("day")
    ahead = F.coalesce(F.lead("day").over(whole), F.col("day") + 1)
    apart = F.lit(0) if fill is None else F.coalesce((F.col("day") - F.lag("day").over(whole) > fill + 1).cast("int"), F.lit(0))
    dense = (
        days.withColumn("first_day", F.min("day").over(Window.partitionBy("entity"))).withColumn("apart", apart)
        .withColumns({"until": ahead if fill is None else F.least(ahead, F.col("day") + fill + 1), "island": F.sum("apart").over(whole)})
        .select("entity", "first_day", "island", F.posexplode(F.sequence("day", F.col("until") - 1)).alias("gap", "on"), "r", "n")
        .select("entity", "first_day", "island", F.col("on").alias("day"), F.when(F.col("gap") == 0, F.col("r")).otherwise(0.0).alias("r"), F.when(F.col("gap") == 0, F.col("n")).otherwise(0).alias("n"))
    )

    def shifted(name: str, by: int) -> Column:
        return F.col(name) if by == 0 else F.coalesce(F.lag(name, by).over(order), F.lit(0))

    blocks = dense.withColumnsRenamed({"r": "r1", "n": "n1"})
    size = 1
    while size * 2 <= max(windows):
        blocks = blocks.withColumns({f"{x}{size * 2}": F.col(f"{x}{size}") + shifted(f"{x}{size}", size) for x in "rn"})
        size *= 2
    out = {}
    for w in windows:
        past, parts = 0, {"r": F.lit(0.0), "n": F.lit(0)}
        for bit in reversed(range(w.bit_length())):
            if w >> bit & 1:
                for x in "rn":
                    parts[x] = parts[x] + shifted(f"{x}{1 << bit}", past)
                past += 1 << bit
        held = F.least(F.lit(w), F.col("day") - F.col("first_day") + 1)
        for x in "rn":
            out[f"{x}_sum_{w}"] = F.round(parts[x], 9) if x == "r" else parts[x]
            out[f"{x}_avg_{w}"] = out[f"{x}_sum_{w}"] / held
    return blocks.select("entity", "day", F.col("r1").alias("r"), F.col("n1").alias("n"), *[v.alias(k) for k, v in out.items()])


def recorded_days(records: DataFrame) -> DataFrame:
    """daily_r and daily_count of candidates as (entity, day, r, n): element i is of day first_session + i.

    The earliest record of a candidate counts (ties: the smaller arrays); NULL elements count as 0;
    where one array is shorter, its missing end counts as 0.
    """
    first = (
        records.where("candidate_id is not null and first_session is not null")
        .groupBy("candidate_id")
        .agg(F.min(F.struct(F.coalesce(F.unix_micros("recorded_ts"), F.lit(2**63 - 1)).alias("at"), "first_session", "daily_r", "daily_count")).alias("x"))
    )
    pairs = F.arrays_zip(F.coalesce("x.daily_r", F.array().cast("array<double>")).alias("r"), F.coalesce("x.daily_count", F.array().cast("array<int>")).alias("n"))
    return (
        first.select(F.col("candidate_id").alias("entity"), F.col("x.first_session").alias("start"), F.posexplode(pairs).alias("i", "p"))
        .select("entity", (F.col("start") + F.col("i")).alias("day"), F.coalesce(F.when(~F.isnan("p.r"), F.col("p.r")), F.lit(0.0)).alias("r"), F.coalesce(F.col("p.n").cast("bigint"), F.lit(0)).alias("n"))
    )
