"""The general training-data queries: regular grids, implausible readings, trailing totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import grid, plausibility, trailing
from tickloom.plans.registry import Registry
from tickloom.sources.tables import table

REGISTRY = Registry()

P1_SQL = """
with periods as (
  select instrument, step_min, unnest(range(open_tmin, close_tmin, step_min)) as tmin from sessions),
usable as (select distinct instrument, tmin from bars where c is not null and not isnan(c)),
held as (
  select distinct p.instrument, p.tmin from periods p
  join usable b on b.instrument = p.instrument and b.tmin >= p.tmin and b.tmin < p.tmin + p.step_min),
es as (select distinct tmin from aligned where evalid and ec is not null and not isnan(ec))
select 'bars' as series, instrument, tmin from (select instrument, tmin from periods except select * from held)
union all
select 'aligned' as series, 'NQ' as instrument, tmin from periods p
where instrument = 'ES' and not exists (select 1 from es where es.tmin = p.tmin)
"""


@REGISTRY.add("p1_found", P1_SQL)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return grid.unobserved_periods(table(spark, folder, "bars"), table(spark, folder, "aligned"), table(spark, folder, "sessions"))


def grid_sql(source: str, sessions: str) -> str:
    """The grid by sums over every pair of a reading and a period less than three periods away; ``source`` has
    source, t, x, c, v and ok (whether c counts for a period at the reading's minute from the session's open)."""
    moments = ", ".join(f"sum({w}) filter (isfinite({y})) as {y}{n}" for y in ("c", "v") for n, w in (("0", "w"), ("1", "w * d"), ("2", "w * d * d"), ("s", "w * w"), ("p", f"w * {y}"), ("q", f"w * d * {y}")))
    fit = lambda y: f"case when {y}0 * {y}2 - {y}1 * {y}1 > 1e-9 * {y}0 * {y}0 then ({y}2 * {y}p - {y}1 * {y}q) / ({y}0 * {y}2 - {y}1 * {y}1) else {y}p / {y}0 end"
    support = lambda y: f"coalesce({y}0 * {y}0 / {y}s, 0)"
    return f"""with s2 as (select row_number() over () as id, instrument as source, sday, open_tmin as a, step_min as step, cast(ceil((close_tmin - open_tmin) / step_min::double) as bigint) as n from {sessions} where instrument is not null and sday is not null and close_tmin > open_tmin and step_min >= 1),
cells as (select id, source, sday, a, step, n, unnest(range(0, n)) as k from s2),
r as ({source}),
own as (select s2.id, s2.a, s2.step, s2.n, (r.t - s2.a) // s2.step as p, r.t, r.x, case when ok or (r.t - s2.a) % s2.step = 0 then r.c end as c, r.v, (r.x - s2.a) / s2.step as u from r join s2 on s2.source = r.source and r.t >= s2.a and r.t < s2.a + s2.n * s2.step),
o as (select id, p as k, count(c) as n_obs, arg_max(c, (t, x, c)) filter (c is not null) as last from own group by 1, 2),
near as (select id, n, u, c, v, unnest(range(cast(floor(u) as bigint) - 2, cast(floor(u) as bigint) + 4)) as k from own),
wd as (select id, k, c, v, u - k as d, 1 - ((u - k) / 3) * ((u - k) / 3) as w from near where k >= 0 and k < n),
m as (select id, k, {moments} from wd where w > 0 group by 1, 2),
f as (select c.source, c.sday, c.a + c.k * c.step as tmin, coalesce(o.n_obs, 0) as n_obs, o.last, {support('c')} as c_support, {support('v')} as v_support, {fit('c')} as c_fit, {fit('v')} as v_fit from cells c left join o using (id, k) left join m using (id, k))
select source, sday, tmin, cast(n_obs as integer) as n_obs, last, case when c_support >= 2 then round(c_fit + 1e-9::double, 4) + 0.0 end as c_fit, round(c_support + 1e-9::double, 4) as c_support, case when v_support >= 2 then round(v_fit + 1e-9::double, 4) + 0.0 end as v_fit,
  round(v_support + 1e-9::double, 4) as v_support, case when n_obs > 0 then 'observed' when c_support >= 2 then 'filled' else 'missing' end as mark from f"""


CLEAR = "case when not isnan({0}) then {0} end"
BAR_READINGS = f"select instrument as source, tmin as t, coalesce(epoch_us(ts) / 6e7::double, tmin) as x, {CLEAR.format('c')} as c, {CLEAR.format('v')} as v, true as ok from bars where instrument is not null and tmin is not null and (({CLEAR.format('c')}) is not null or ({CLEAR.format('v')}) is not null)"
ES_READINGS = f"select 'ES' as source, tmin as t, tmin::double as x, {CLEAR.format('ec')} as c, {CLEAR.format('ev')} as v, false as ok from aligned where tmin is not null and evalid and (({CLEAR.format('ec')}) is not null or ({CLEAR.format('ev')}) is not null)"


def shown_grid(made: DataFrame) -> DataFrame:
    return made.withColumns({c: F.round(F.col(c) + 1e-9, 4) + 0.0 for c in ("c_fit", "c_support", "v_fit", "v_support")})


@REGISTRY.add("p1_grid", grid_sql(BAR_READINGS, "sessions"))
def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    return shown_grid(grid.market_grid(table(spark, folder, "bars"), table(spark, folder, "sessions")))


@REGISTRY.add("p1_aligned_grid", grid_sql(ES_READINGS, "(select * from sessions where instrument = 'ES')"))
def p1_aligned_grid(spark: SparkSession, folder: str) -> DataFrame:
    return shown_grid(grid.aligned_grid(table(spark, folder, "aligned"), table(spark, folder, "sessions")))


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return plausibility.implausible_ids(table(spark, folder, "bars"))


@REGISTRY.add("p3_flags")
def p3_flags(spark: SparkSession, folder: str) -> DataFrame:
    return plausibility.implausible_readings(table(spark, folder, "bars"))


P4_LATEST = """
latest as (
  select candidate_id, session, coalesce(case when isnan(r) then null else r end, 0) as r, coalesce(n, 0) as n from (
    select *, row_number() over (partition by candidate_id, session
      order by recv_ts desc nulls last, coalesce(case when isnan(r) then null else r end, 0) desc, coalesce(n, 0) desc) as k
    from daily_streams where candidate_id is not null and session is not null) where k = 1),
"""
P4_WINDOWS = """
spans as (select candidate_id, min(session) as a, max(session) as b from latest group by 1),
days as (select candidate_id, cast(unnest(range(a, b + 1)) as integer) as session, a from spans),
dense as (select d.candidate_id, d.session, d.a, coalesce(l.r, 0) as r, coalesce(l.n, 0) as n
  from days d left join latest l on l.candidate_id = d.candidate_id and l.session = d.session),
w as (select candidate_id, session, r, n, a,
  sum(r) over w7 as r_sum_7, sum(n) over w7 as n_sum_7, sum(r) over w30 as r_sum_30, sum(n) over w30 as n_sum_30
  from dense window w7 as (partition by candidate_id order by session rows 6 preceding),
    w30 as (partition by candidate_id order by session rows 29 preceding))
"""
P4_TOTALS = """
select candidate_id, session, round(r, 4) as r, cast(n as bigint) as n,
  round(r_sum_7, 4) + 0.0 as r_sum_7, cast(n_sum_7 as bigint) as n_sum_7, round(r_sum_30, 4) + 0.0 as r_sum_30, cast(n_sum_30 as bigint) as n_sum_30,
  round(round(r_sum_7, 9) / least(7, session - a + 1), 8) + 0.0 as r_avg_7, round(n_sum_7 / least(7, session - a + 1), 8) as n_avg_7,
  round(round(r_sum_30, 9) / least(30, session - a + 1), 8) + 0.0 as r_avg_30, round(n_sum_30 / least(30, session - a + 1), 8) as n_avg_30
from w
"""


def _latest_days(spark: SparkSession, folder: str) -> DataFrame:
    return trailing.latest_delivery(table(spark, folder, "daily_streams"), "candidate_id", "session", "recv_ts", "r", "n")


def _totals(days: DataFrame) -> DataFrame:
    out = trailing.trailing_totals(days)
    rounded = [(F.round(c, places) + F.lit(0.0)).alias(c) for c, places in {"r_sum_7": 4, "r_sum_30": 4, "r_avg_7": 8, "n_avg_7": 8, "r_avg_30": 8, "n_avg_30": 8}.items()]
    return out.select(F.col("entity").alias("candidate_id"), F.col("day").alias("session"), F.round("r", 4).alias("r"), "n", "n_sum_7", "n_sum_30", *rounded)


@REGISTRY.add("p4_found", "with " + P4_LATEST + P4_WINDOWS + "select candidate_id, session from w where n_sum_7 = 0 and n_sum_30 >= 10")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    # later than 30 days after a delivery nothing is left in the window, so no case is there
    return trailing.trailing_totals(_latest_days(spark, folder), fill=30).where("n_sum_7 = 0 and n_sum_30 >= 10").select(F.col("entity").alias("candidate_id"), F.col("day").alias("session"))


@REGISTRY.add("p4_totals", "with " + P4_LATEST + P4_WINDOWS + P4_TOTALS)
def p4_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _totals(_latest_days(spark, folder))


P4_RECORDED = """
with firsts as (select candidate_id, first_session, daily_r, daily_count from (select *, row_number() over (partition by candidate_id order by recorded_ts nulls last, first_session, daily_r nulls first, daily_count nulls first) as k
  from candidates where candidate_id is not null and first_session is not null) where k = 1),
at_ as (select *, unnest(range(greatest(coalesce(len(daily_r), 0), coalesce(len(daily_count), 0)))) as i from firsts),
latest as (select candidate_id, cast(first_session + i as integer) as session, coalesce(case when not isnan(daily_r[i + 1]) then daily_r[i + 1] end, 0) as r, coalesce(daily_count[i + 1], 0) as n from at_),
"""


@REGISTRY.add("p4_recorded_totals", P4_RECORDED + P4_WINDOWS + P4_TOTALS)
def p4_recorded_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _totals(trailing.recorded_days(table(spark, folder, "candidates")))
