"""Scans, calendar, integrity, resampling, alignment and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.operators.execution import window_masks
from tickloom.operators import market as m
from tickloom.operators.windows import Rolling
from tickloom.plans.oracle import CLEAN, FINITE, G
from tickloom.plans.registry import Registry
from tickloom.sources.tables import table

REGISTRY = Registry()
add = REGISTRY.add
R = Rolling()


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return m.clean_bars(table(spark, folder, "bars"))


@add("bars_clean", f"with {CLEAN} select instrument, tmin, o, h, l, c, v, seg, sday, sm, rw, pos from b")
def bars_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean(spark, folder)


@add("guarded_scan", f"with {CLEAN} select instrument, tmin, c, v from b where instrument = 'NQ' and sday between 15345 and 15365")
def guarded_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The session range and the instrument reach the parquet scan."""
    return m.clean_bars(table(spark, folder, "bars").where("instrument = 'NQ' and sday between 15345 and 15365")).select("instrument", "tmin", "c", "v")


K15 = f"""with {CLEAN} select instrument, tmin // 15 as bucket, arg_min(o, tmin) as o, max(h) as h, min(l) as l, arg_max(c, tmin) as c,
  case when count(v) = count(*) then sum(v) end as v, case when min(seg) = max(seg) then max(seg) else -1 end as seg,
  case when min(sday) = max(sday) then max(sday) else -1 end as sday, count(*) as n_bars from b group by 1, 2"""


@add("bars_ohlcv", K15)
def bars_ohlcv(spark: SparkSession, folder: str) -> DataFrame:
    return m.resample(clean(spark, folder), 15)


@add("resample_5m", K15.replace("// 15", "// 5"))
def resample_5m(spark: SparkSession, folder: str) -> DataFrame:
    return m.resample(clean(spark, folder), 5)


@add("resample_60m", K15.replace("// 15", "// 60"))
def resample_60m(spark: SparkSession, folder: str) -> DataFrame:
    return m.resample(clean(spark, folder), 60)


@add("htf_asof", f"""with {CLEAN},
k as (select instrument, tmin // 15 as bucket, arg_max(c, tmin) as htf_c, (tmin // 15 + 1) * 15 - 1 as known from b group by 1, 2, 4)
select b.instrument, b.tmin, k.bucket, k.htf_c from b asof left join k on b.instrument = k.instrument and b.tmin >= k.known""")
def htf_asof(spark: SparkSession, folder: str) -> DataFrame:
    return m.last_completed(clean(spark, folder), 15)


@add("session_fields", """
with x as (select event_id, ts, epoch_us(timezone('America/New_York', timezone('UTC', ts))) // 60000000 as local from events)
select event_id, epoch_us(ts) // 60000000 as tmin, local, cast(floor((local + 360) / 1440.0) as integer) as sday, cast((local + 360) % 1440 as smallint) as sm from x""")
def session_fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", *[c.alias(n) for n, c in cal.session_fields(F.col("ts").cast("timestamp")).items()])


@add("session_bounds", """
with d as (select distinct cast(epoch_us(ts) // 86400000000 as integer) as sday from events)
select sday, cast(date '1970-01-01' + sday as varchar) as session_date,
  epoch_us(timezone('America/New_York', make_timestamp((sday::bigint * 1440 - 360) * 60000000))) // 60000000 as start_tmin,
  epoch_us(timezone('America/New_York', make_timestamp((sday::bigint * 1440 + 1020) * 60000000))) // 60000000 as end_tmin from d""")
def session_bounds(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("int").alias("sday")).distinct()
    start, end = cal.session_bounds(F.col("sday"))
    return days.select("sday", cal.session_date(F.col("sday")).cast("string").alias("session_date"), start.alias("start_tmin"), end.alias("end_tmin"))


@add("session_calendar", """
select distinct sday, year(date '1970-01-01' + sday) as year, strftime(date '1970-01-01' + sday, '%Y%m') as yyyymm, (sday + 3) % 7 as dow,
  month(date '1970-01-01' + sday) as month,
  (select count(*) from range(1, 31) r(i) where date '1970-01-01' + sday + cast(i as integer) <= last_day(date '1970-01-01' + sday) and isodow(date '1970-01-01' + sday + cast(i as integer)) < 6) as weekdays_left,
  date_trunc('week', date '1970-01-01' + sday) = date_trunc('week', date_trunc('month', date '1970-01-01' + sday)::date + cast((11 - isodow(date_trunc('month', date '1970-01-01' + sday)) + 1) % 7 as integer) + 14) as opex_week
from sessions""")
def session_calendar(spark: SparkSession, folder: str) -> DataFrame:
    date = cal.session_date(F.col("sday"))
    return table(spark, folder, "sessions").select("sday").distinct().select(
        "sday", F.year(date).alias("year"), F.date_format(date, "yyyyMM").alias("yyyymm"), cal.weekday(F.col("sday")).alias("dow"), F.month(date).alias("month"),
        cal.weekdays_left(date).alias("weekdays_left"), (F.trunc(date, "week") == F.trunc(cal.third_friday(date), "week")).alias("opex_week"),
    )


@add("contract_fields", """
with s as (select distinct strftime(o_orderdate, '%Y-%m-%d') as d, o_orderdate as date, 'NQ' || substr('FGHJKMNQUVXZ', 1 + (o_custkey % 12)::integer, 1) || '4' as symbol from orders)
select d as date, symbol, m as contract_month, m = month(date) and day(date) >= 8 as roll_window
from (select *, case substr(symbol, -2, 1) when 'H' then 3 when 'M' then 6 when 'U' then 9 when 'Z' then 12 else 0 end as m from s)""")
def contract_fields(spark: SparkSession, folder: str) -> DataFrame:
    letter = F.substring(F.lit("FGHJKMNQUVXZ"), (F.lit(1) + F.col("o_custkey") % 12).cast("int"), F.lit(1))
    s = table(spark, folder, "orders").select(F.col("o_orderdate").alias("date"), F.concat(F.lit("NQ"), letter, F.lit("4")).alias("symbol")).distinct()
    return s.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "symbol", cal.contract_month(F.col("symbol")).alias("contract_month"), cal.in_roll_window(F.col("symbol"), F.col("date")).alias("roll_window"))


@add("integrity_counts", f"""
select instrument, count(*) as n_rows, count(*) - count(distinct tmin) as duplicate_minutes,
  count(*) filter (not coalesce({FINITE}, false)) as bad_prices,
  count(*) filter (h < greatest(o, c) - 1e-9 and o is not null and c is not null) as high_too_low, count(*) filter (l > least(o, c) + 1e-9 and o is not null and c is not null) as low_too_high,
  count(*) filter (v < 0) as negative_volume, count(*) filter (v <> floor(v) and not isnan(v)) as fractional_volume,
  count(*) filter (v is null or isnan(v)) as missing_volume, count(*) filter (v = 0) as zero_volume
from bars where instrument is not null group by 1""")
def integrity_counts(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "bars")
    # NaN and a single missing price must not decide the order of prices
    whole = bars.withColumns({c: F.when(F.col("o").isNotNull() & F.col("c").isNotNull(), F.col(c)) for c in ("h", "l")})
    return m.integrity(bars).drop("high_too_low", "low_too_high").join(m.integrity(whole).select("instrument", "high_too_low", "low_too_high"), "instrument")


@add("volume_structure", f"""with {CLEAN} select instrument, count(*) as n_bars, count(v) as with_volume, count(*) filter (v = 0) as zero_bars,
  sum(v) as total, max(v) as largest, quantile_cont(v, 0.5) as median from b group by 1""")
def volume_structure(spark: SparkSession, folder: str) -> DataFrame:
    return clean(spark, folder).groupBy("instrument").agg(
        F.count("*").alias("n_bars"), F.count("v").alias("with_volume"), F.count_if(F.col("v") == 0).alias("zero_bars"), F.sum("v").alias("total"), F.max("v").alias("largest"), F.percentile("v", 0.5).alias("median"),
    )


@add("schema_difference", "select * from (values ('bar_id', 'bigint'), ('gid', 'bigint'), ('recv_ts', 'timestamp'), ('eo', 'double'), ('eh', 'double'), ('el', 'double'), ('ec', 'double'), ('ev', 'double'), ('evalid', 'boolean'), ('es_seg', 'int'), ('es_rw', 'boolean')) t(name, kind) where name not in ('bar_id', 'gid')")
def schema_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Symmetric difference of two tables' (column, type) sets."""
    a, b = ({(f.name, f.dataType.simpleString()) for f in table(spark, folder, t).schema} for t in ("bars", "aligned"))
    return spark.createDataFrame(sorted(a ^ b), "name string, kind string")


@add("align_same_minute", f"""with {CLEAN}, nq as (select * from b where instrument = 'NQ'), es as (select * from b where instrument = 'ES')
select nq.tmin, nq.c, es.c as ec, es.v as ev, es.c is not null as evalid, coalesce(es.seg, -1) as es_seg, coalesce(es.rw, false) as es_rw from nq left join es using (tmin)""")
def align_same_minute(spark: SparkSession, folder: str) -> DataFrame:
    return m.align(clean(spark, folder), "NQ", "ES").select("tmin", "c", "ec", "ev", "evalid", "es_seg", "es_rw")


@add("segment_groups", f"""with {CLEAN}, f as (select instrument, sday, seg, min(tmin) as first_tmin, max(tmin) as last_tmin, count(*) as n_bars from b group by 1, 2, 3)
select *, row_number() over (partition by instrument order by first_tmin) - 1 as group_no,
  coalesce(seg <> lag(seg) over (partition by instrument order by first_tmin), false) as is_roll from f""")
def segment_groups(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("instrument").orderBy("first_tmin")
    f = clean(spark, folder).groupBy("instrument", "sday", "seg").agg(F.min("tmin").alias("first_tmin"), F.max("tmin").alias("last_tmin"), F.count("*").alias("n_bars"))
    return f.withColumn("group_no", F.row_number().over(order) - 1).withColumn("is_roll", F.coalesce(F.col("seg") != F.lag("seg").over(order), F.lit(False)))


@add("roll_report", f"""with {CLEAN}, f as (select instrument, sday, seg, min(tmin) as first from b group by 1, 2, 3),
p as (select *, lag(seg) over w as ps, lag(sday) over w as pd from f window w as (partition by instrument order by first))
select instrument, cast(sum((ps is not null and seg <> ps)::int) as bigint) as rolls, cast(sum((ps is not null and seg <> ps and sday <> pd)::int) as bigint) as rolls_at_session_start, count(*) as groups from p group by 1""")
def roll_report(spark: SparkSession, folder: str) -> DataFrame:
    return m.roll_report(clean(spark, folder))


@add("decision_bars", f"""with {CLEAN} select instrument, tmin from (select *, lead(sm) over ({G}) as nxt from b) where nxt >= 930 and nxt < 1290""")
def decision_bars(spark: SparkSession, folder: str) -> DataFrame:
    return m.decision_bars(clean(spark, folder)).where("is_dec").select("instrument", "tmin")


@add("entry_flat_masks", f"""with {CLEAN} select instrument, tmin, coalesce(lag(sm) over ({G}) is not null and sm >= 935 and sm < 1200 and sm < 1320, false) as entry_ok,
  coalesce(lead(sm) over ({G}) is null or lead(sm) over ({G}) >= 1320 or sm >= 1320, true) as flat_bar from b""")
def entry_flat_masks(spark: SparkSession, folder: str) -> DataFrame:
    """A window may be entered from 09:35 to 14:00; bars from 16:00 on, the one before, and a group's last are flat."""
    return window_masks(clean(spark, folder), 935, 1200, 1320).select("instrument", "tmin", "entry_ok", "flat_bar")


@add("session_start_mask", f"""with {CLEAN} select instrument, tmin from (select *, lag(sday) over (partition by instrument order by tmin) as p from b) where p is distinct from sday""")
def session_start_mask(spark: SparkSession, folder: str) -> DataFrame:
    return clean(spark, folder).groupBy("instrument", "sday").agg(F.min("tmin").alias("tmin")).select("instrument", "tmin")


@add("tail_sessions", f"""with {CLEAN}, k as (select instrument, sday, row_number() over (partition by instrument order by sday desc) as k from (select distinct instrument, sday from b))
select b.instrument, b.tmin from b join k using (instrument, sday) where k <= 5""")
def tail_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return m.tail_sessions(clean(spark, folder), 5).select("instrument", "tmin")


@add("complete_sessions", f"with {CLEAN} select instrument, sday, max(sm) >= 1379 as complete, count(*) as n_bars from b group by 1, 2")
def complete_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return clean(spark, folder).groupBy("instrument", "sday").agg((F.max("sm") >= cal.SESSION_END).alias("complete"), F.count("*").alias("n_bars"))


@add("first_in_session", f"""with {CLEAN} select instrument, sday, min(tmin) as tmin from (select *, lag(c) over ({G}) as p from b) where c > p * 1.001 group by 1, 2""")
def first_in_session(spark: SparkSession, folder: str) -> DataFrame:
    up = clean(spark, folder).withColumn("p", R.lag(F.col("c"))).where(F.col("c") > F.col("p") * 1.001)
    return up.groupBy("instrument", "sday").agg(F.min("tmin").alias("tmin"))


@add("prior_session_levels", f"""with {CLEAN}, s as (select distinct instrument, sday from b),
d as (select instrument, sday, max(h) as hi, min(l) as lo, arg_max(c, tmin) as last from b where sm between 930 and 1319 group by 1, 2)
select instrument, sday, hi, lo, last, lag(hi) over w as prev_hi, lag(lo) over w as prev_lo, lag(last) over w as prev_last
from s left join d using (instrument, sday) window w as (partition by instrument order by sday)""")
def prior_session_levels(spark: SparkSession, folder: str) -> DataFrame:
    return m.prior_levels(clean(spark, folder))


@add("partition_ranges", """
with p(name, low, high) as (values ('discovery', 0, 15344), ('validation', 15345, 15347), ('audit', 15348, 99999))
select name as part, count(*) as n_rows, min(tmin) as first_tmin, max(tmin) as last_tmin, count(distinct sday) as n_sessions
from bars join p on sday between low and high group by 1""")
def partition_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Every row belongs to exactly one range of sessions; counts reconcile with the source."""
    from tickloom.sources.partitions import RANGES, with_partition

    return with_partition(table(spark, folder, "bars"), RANGES).groupBy("part").agg(F.count("*").alias("n_rows"), F.min("tmin").alias("first_tmin"), F.max("tmin").alias("last_tmin"), F.count_distinct("sday").alias("n_sessions"))


@add("content_hash")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return m.content_hash(table(spark, folder, "bars"), ["bar_id", "instrument", "tmin", "o", "h", "l", "c", "v"])


@add("union_chronological", f"""with {CLEAN} select instrument, tmin, c from b where sday < 15345 union all select instrument, tmin, c from b where sday >= 15345""")
def union_chronological(spark: SparkSession, folder: str) -> DataFrame:
    bars = clean(spark, folder).select("instrument", "tmin", "c", "sday")
    return bars.where("sday < 15345").unionByName(bars.where("sday >= 15345")).drop("sday")


@add("common_sessions", f"with {CLEAN} select sday from b where instrument = 'NQ' intersect select sday from b where instrument = 'ES'")
def common_sessions(spark: SparkSession, folder: str) -> DataFrame:
    bars = clean(spark, folder)
    return bars.where("instrument = 'NQ'").select("sday").intersect(bars.where("instrument = 'ES'").select("sday"))


@add("equity_curve", f"""select candidate_id, session, round(sum(r) over w, 6) + 0.0 as equity, round(greatest(max(e) over w, 0) - e, 6) + 0.0 as drawdown from (
  select *, sum(r) over (partition by candidate_id order by session) as e from (
    select candidate_id, session, arg_max(coalesce(case when isnan(r) then null else r end, 0), (recv_ts, coalesce(case when isnan(r) then null else r end, 0), coalesce(n, 0))) as r from daily_streams where candidate_id is not null and session is not null group by 1, 2))
window w as (partition by candidate_id order by session)""")
def equity_curve(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.operators.trailing import latest_delivery

    days = latest_delivery(table(spark, folder, "daily_streams"), "candidate_id", "session", "recv_ts", "r", "n")
    w = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    e = days.withColumn("e", F.sum("r").over(w))
    return e.select(F.col("entity").alias("candidate_id"), F.col("day").alias("session"), (F.round("e", 6) + 0.0).alias("equity"), (F.round(F.greatest(F.max("e").over(w), F.lit(0.0)) - F.col("e"), 6) + 0.0).alias("drawdown"))
