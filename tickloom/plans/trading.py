"""Triggers, filters, symbols, mechanism signals, simulated trades and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import market, sequential, signals, simulate
from tickloom.operators.windows import Rolling
from tickloom.plans import features as pf
from tickloom.plans import oracle as q
from tickloom.plans.market import clean
from tickloom.plans.oracle import CLEAN, G
from tickloom.plans.registry import Registry
from tickloom.sources.tables import table

REGISTRY = Registry()
add = REGISTRY.add
R = Rolling()
K = pf.K

#: Thresholds of the return, opening, efficiency and volume triggers; a little above, so equal values do not cross.
LEVELS = {f"RETZ{h}_{t}": (f"retz_{h}", t + 1e-7) for h in (1, 5, 15, 30, 60) for t in (1.5, 2.0, 2.5, 3.0)}
LEVELS |= {f"OPEN_RETZ_{t}": ("open_retz", t + 1e-7) for t in (1.0, 1.5, 2.0)} | {f"ER{h}_{t}": (f"er_{h}", t + 1e-7) for h in (15, 30, 60, 120) for t in (0.5, 0.7)}
LEVELS |= {"TREND_AGREE": ("trend_agree", 3.5), "SGNVOL15_0.3": ("sgnvol_15", 0.3 + 1e-7)}
USED = [*sorted({c for c, _ in LEVELS.values()}), "retz_240", "er_60", "lrvol_15", "lrvol_5", "lrvol_60", "sgnvol_60", "clvvol_60", "semi_60", "rvratio_60", "pos_range_240"]
USED = list(dict.fromkeys(USED))
KNOWN = pf.FAMILIES["feature_ret"] | pf.FAMILIES["feature_vol"] | pf.FAMILIES["feature_path"] | pf.FAMILIES["feature_dist"]
FEATURED = pf.BASE + ", y as materialized (select *, " + ", ".join(f"{KNOWN[c]} as {c}" for c in USED) + " from x)"


def featured(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.operators import features as f

    x = pf.base(spark, folder)
    every = f.returns(x) | f.paths(x) | f.volumes(x) | f.distributions(x)
    return x.withColumns({c: every[c] for c in USED})


def crossing(name: str, column: str, level: float) -> str:
    up, down = f"{column} > {level!r}::double and p <= {level!r}::double", f"{column} < -({level!r}::double) and p >= -({level!r}::double)"
    return f"select instrument, tmin, '{name}' as trigger_id, case when {up} then 1 else -1 end as sign from (select *, {q.lag(column)} as p from y) where ({up}) or ({down})"


@add("trigger_events", FEATURED + " " + " union all ".join(crossing(n, c, v) for n, (c, v) in LEVELS.items()))
def trigger_events(spark: SparkSession, folder: str) -> DataFrame:
    return signals.signed_crossings(featured(spark, folder), LEVELS, ("instrument", "tmin"))


#: Filter bits by name: for a long trade and, where it depends on the side, for a short one.
BITS = {
    "rvol_high": "lrvol_15 > ln(1.5)", "rvol_low": "lrvol_15 < ln(0.7)", "vol_accelerating": "lrvol_5 - lrvol_60 > ln(1.5)", "volreg_high": "rvratio_60 > 1.5", "volreg_low": "rvratio_60 < 0.7",
    "er_high": "abs(er_60) > 0.4000001", "er_low": "abs(er_60) < 0.1499999", "first_hour": "sm >= 929 and sm < 989", "midday": "sm >= 1049 and sm < 1229", "last_90": "sm >= 1229 and sm < 1290",
    "monday": "(sday + 3) % 7 = 0", "friday": "(sday + 3) % 7 = 4", "trend240_aligned": ("retz_240 > 0.5", "retz_240 < -0.5"), "trend60_aligned": ("retz_60 > 0.5", "retz_60 < -0.5"), "trend60_against": ("retz_60 < -0.5", "retz_60 > 0.5"),
    "range_top": ("pos_range_240 > 0.8000001", "pos_range_240 < 0.1999999"), "range_bottom": ("pos_range_240 < 0.1999999", "pos_range_240 > 0.8000001"), "open_aligned": ("open_retz > 0.5", "open_retz < -0.5"),
    "sgnvol_aligned": ("sgnvol_60 > 0.1000001", "sgnvol_60 < -0.1000001"), "clvvol_aligned": ("clvvol_60 > 0.1000001", "clvvol_60 < -0.1000001"), "semi_aligned": ("semi_60 > 0.2", "semi_60 < -0.2"),
}
SIDED = {side: [v if isinstance(v, str) else v[k] for v in BITS.values()] for k, side in enumerate(("long_mask", "short_mask"))}


@add("filter_bits", FEATURED + " select instrument, tmin, " + ", ".join("cast(" + " + ".join(f"{1 << k} * coalesce({e}, false)::int" for k, e in enumerate(es)) + f" as bigint) as {side}" for side, es in SIDED.items()) + " from y")
def filter_bits(spark: SparkSession, folder: str) -> DataFrame:
    return featured(spark, folder).select("instrument", "tmin", *[signals.filter_mask([F.expr(e) for e in es]).alias(side) for side, es in SIDED.items()])


@add("symbol_codes", f"""with {CLEAN}, k as (select instrument, sday, seg, tmin // 5 as bucket, arg_min(o, tmin) as o, arg_max(c, tmin) as c from b group by 1, 2, 3, 4),
s as (select *, case when c > o * 1.0005 then 2 when c < o * 0.9995 then 0 else 1 end as symbol from k)
select instrument, bucket, symbol, case when lag(bucket) over w = bucket - 1 then 3 * lag(symbol) over w + symbol end as code from s window w as (partition by instrument, sday, seg order by bucket)""")
def symbol_codes(spark: SparkSession, folder: str) -> DataFrame:
    return signals.symbol_codes(clean(spark, folder))


def context(spark: SparkSession, folder: str) -> DataFrame:
    bars = clean(spark, folder)
    return signals.context(bars, market.session_numbers(bars), K)


def cq(x: str, k: int, p: float) -> str:
    w = f"(partition by instrument, sm order by session_no rows between {k} preceding and 1 preceding)"
    return f"case when count({x}) over {w} = {k} then quantile_cont({x}, {p}) over {w} end"


CONTEXT = f"""with {CLEAN},
x0 as (select *, {q.lag("c")} as pc, dense_rank() over (partition by instrument order by sday) as session_no from b),
x1 as (select *, {q.ln("c / pc")} as r1, c - pc as d, case when pc is not null then greatest(h, pc) - least(l, pc) end as tr, {q.lag("sm", -1)} as next_sm from x0),
x2 as (select *, {q.rsum("r1", 15)} as ret15, {cq("abs(r1)", K, 0.5)} as med, {q.rmean("tr", 15)} as stop0 from x1),
x3 as (select *, case when med is not null then greatest(med, 0.25 / c) end as v_abs, {q.lag("stop0")} as stop from x2),
x as (select *, coalesce(abs(ret15) >= 1.5 * v_abs * sqrt(15), false) as c15, coalesce(sign(ret15), 0) as direction15,
  coalesce(sm >= 930 and next_sm between 935 and 1275 and not coalesce(rw, false) and stop >= 0.25 and v_abs is not null, false) as base_ok from x3)"""


@add("signal_context", CONTEXT + " select instrument, tmin, round(v_abs, 9) as v_abs, c15, cast(direction15 as integer) as direction15, base_ok from x")
def signal_context(spark: SparkSession, folder: str) -> DataFrame:
    return context(spark, folder).select("instrument", "tmin", F.round("v_abs", 9).alias("v_abs"), "c15", "direction15", "base_ok")


def mechanism(name: str, build, extra: str, hit: str, source=context, base: str = CONTEXT) -> None:  # noqa: ANN001
    """A family and its SQL: ``hit`` over table y, in the move's direction where c15 holds."""

    @add(f"signal_{name}", f"{base}{extra} select instrument, tmin, cast(direction15 as integer) as state from y where base_ok and c15 and direction15 <> 0 and coalesce({hit}, false)")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(source(spark, folder)).where("base_ok and state <> 0").select("instrument", "tmin", "state")


def paired(spark: SparkSession, folder: str) -> DataFrame:
    bars = clean(spark, folder)
    return signals.paired_context(bars, market.session_numbers(bars.where("instrument = 'NQ'")), K=K)


PAIRED = CONTEXT + f""", xo as (select x.*, es.c as ec, coalesce(es.rw, false) as es_rw, es.c is not null as evalid from x left join (select tmin, c, rw from b where instrument = 'ES') es using (tmin) where instrument = 'NQ'),
xp as (select *, {q.ln(f"ec / ({q.lag('ec')})")} as er from xo)"""
Z = q.ratio("r1", "v_abs")


def hist(x: str, bins: tuple = signals.BINS) -> str:
    return " + ".join(f"({x} >= {e})::int" for e in bins)


mechanism("e07", lambda x: signals.e07(x, 30, 0.8), f", w as (select *, array_agg(c) over {q.frame(30)} as cs, {q.lag('c', 30)} as c0 from x), y as (select *, case when pos >= 30 and len(cs) = 30 then len(list_filter(cs, lambda e: e > c0)) / 30.0::double end as occ from w)", "(case when direction15 > 0 then occ >= 0.8 else occ <= 1 - 0.8::double end)")
mechanism("e09", lambda x: signals.e09(x, 15, 0.5000001), f", y as (select *, {q.ratio(q.rsum('sign(r1) * v', 15), q.rsum('v', 15))} as sh from x)", "direction15 * sh >= 0.5000001")
mechanism("e10", lambda x: signals.e10(x, 15, 0.75, K), f", w as (select *, {q.ratio('abs(ret15)', q.rsum('v', 15))} as im from x), y as (select *, {cq('im', K, 0.75)} as cut from w)", "im > cut")
mechanism("e17", lambda x: signals.e17(x, 60, 1.5000001), f", w as (select *, {q.rsum('r1', 5)} as five from x), w2 as (select *, case when sm % 5 = 4 then five * five else 0.0 end as blk from w), y as (select *, {q.ratio(q.rsum('r1 * r1', 60), q.rsum('blk', 60))} as rate from w2)", "rate >= 1.5000001")
mechanism("e18", lambda x: signals.e18(x, K, 0.2), f", w as (select *, {cq('v', K, 0.2)} as vq, {cq('(h - l)', K, 0.8)} as hq from x), w2 as (select *, coalesce(v < vq and h - l > hq, false) as thin from w), y as (select *, thin and coalesce({q.lag('thin')}, false) as dry from w2)", "dry")
mechanism("e19", lambda x: signals.e19(x, K, 0.2500001), f""", w as (select *, {Z} as z from x), w2 as (select *, case when z > 1 then 2 when z < -1 then 0 when z is not null then 1 end as sym from w), w3 as (select *, {q.lag('sym')} as frm from w2),
dm as (select instrument, sday, any_value(session_no) as session_no, count(*) filter (frm = 0 and sym is not null) as n0, count(*) filter (frm = 2 and sym is not null) as n2, count(*) filter (frm = 0 and sym = 0) as s0, count(*) filter (frm = 2 and sym = 2) as s2 from w3 group by 1, 2),
dp as (select instrument, sday, case when session_no > {K} then (sum(s0) over g + 1) / (sum(n0) over g + 3) end as p0, case when session_no > {K} then (sum(s2) over g + 1) / (sum(n2) over g + 3) end as p2 from dm window g as (partition by instrument order by session_no rows between {K} preceding and 1 preceding)),
y as (select w3.*, p0, p2 from w3 join dp using (instrument, sday))""", "(case when direction15 > 0 then sym = 2 and p2 >= 0.2500001 else sym = 0 and p0 >= 0.2500001 end)")
mechanism("e24", lambda x: signals.e24(x, 30, 0.05, 2), f""", w as (select *, {Z} as z from x), w2 as (select *, case when z is not null then {hist('z')} end as bin from w),
w3 as (select *, {", ".join(f"{q.rsum(f'(bin = {k})::int::double', 30)} as h{k}" for k in range(8))} from w2),
w4 as (select *, {", ".join(f"case when count(h0) over g = 2 then sum(h{k}) over g end as q{k}" for k in range(8))} from w3 window g as (partition by instrument, sm order by session_no rows between 2 preceding and 1 preceding)),
w5 as (select *, {", ".join(f"(h{k} + 0.5) / 34 as p_{k}, (q{k} + 0.5) / (2 * 30 + 4) as q_{k}" for k in range(8))} from w4),
y as (select *, {" + ".join(f"0.5 * (p_{k} * ln(p_{k} / ((p_{k} + q_{k}) / 2)) + q_{k} * ln(q_{k} / ((p_{k} + q_{k}) / 2)))" for k in range(8))} as js from w5)""", "js > 0.05")
mechanism("e25", lambda x: signals.e25(x, 30, 2, 2), f", w as (select *, {Z} as z from x), w2 as (select *, coalesce(abs(z) > {cq('abs(z)', 2, 0.95)}, false) as ex from w), y as (select *, {q.rsum('ex::int::double', 30)} as n_ex, {q.rsum('(case when ex then sign(z) else 0.0 end)', 30)} as sg from w2)", "n_ex >= 2 and sign(sg) = direction15")
mechanism("e26", lambda x: signals.e26(x, 30, 0.7000001), ", w as (select *, sm between 930 and 1319 as rth from x), w2 as (select *, first_value(sm) over z as s0, first_value(o) over z as oo, max(h) over z as hh, min(l) over z as ll from w window z as (partition by instrument, sday, seg, rth order by tmin rows unbounded preceding)), w3 as (select *, greatest(hh - oo, 0) as up, greatest(oo - ll, 0) as dn from w2), y as (select *, case when rth and s0 = 930 and sm - 930 >= 30 and up + dn > 0 then (case when direction15 > 0 then up else dn end) / (up + dn) end as fav from w3)", "fav >= 0.7000001")
mechanism("e27", lambda x: signals.e27(x, 30, 1.2000001), f", w as (select *, {q.rmax('h', 15)} - {q.rmin('l', 15)} as r15, {q.rmax('h', 10)} - {q.rmin('l', 10)} as r10 from x), y as (select *, {q.lag('r10', 5)} as f10, case when count(r15) over {q.frame(30, -1)} = 30 then quantile_cont(r15, 0.5) over {q.frame(30, -1)} end as usual from w)", "r15 > 0 and r15 >= 1.2000001 * usual and (r15 - f10) / r15 >= 0.7")
mechanism("e12", lambda x: signals.e12(x, 15, 0.5, K, 2), f""", w as (select *, {cq('abs(er)', K, 0.5)} as em, {q.rsum('er', 15)} as e15 from xp), w2 as (select *, case when em is not null then greatest(em, 0.25 / ec) end as ev from w),
w3 as (select *, {q.ratio('abs(ret15)', 'v_abs * sqrt(15)')} as nz, {q.ratio('abs(e15)', 'ev * sqrt(15)')} as ez from w2), y as (select *, {cq('nz', 2, 0.5)} as nq_, {cq('ez', 2, 0.5)} as eq_ from w3)""", "nz > nq_ and ez > eq_ and sign(e15) = direction15 and evalid and not es_rw", paired, PAIRED)


def labelled(x: DataFrame) -> DataFrame:
    return signals.with_labels(x, F.when(F.col("c15"), F.col("direction15")).otherwise(0))


#: The label's first bar that reaches half a stop, by a join with the next 30 bars.
LABELS = f""", ev as (select x.*, nx.o as entry from x join b nx on nx.instrument = x.instrument and nx.sday = x.sday and nx.seg is not distinct from x.seg and nx.pos = x.pos + 1 where c15 and direction15 <> 0 and stop > 0),
hit as (select ev.instrument, ev.tmin, min(f.pos) filter (case when direction15 > 0 then f.h - entry >= 0.5 * stop else entry - f.l >= 0.5 * stop end) as w_, min(f.pos) filter (case when direction15 > 0 then entry - f.l >= 0.5 * stop else f.h - entry >= 0.5 * stop end) as l_
  from ev join b f on f.instrument = ev.instrument and f.sday = ev.sday and f.seg is not distinct from ev.seg and f.pos between ev.pos + 1 and ev.pos + 30 group by 1, 2),
lb as (select instrument, tmin, case when l_ is not null and (w_ is null or l_ <= w_) then 0.0 when w_ is not null then 1.0 end as label from hit),
w as (select x.*, label from x left join lb using (instrument, tmin)),"""


@add("barrier_labels", CONTEXT + LABELS + " y as (select 1) select instrument, tmin, label from w where label is not null")
def barrier_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(context(spark, folder)).where("label is not null").select("instrument", "tmin", "label")


mechanism("e20", lambda x: signals.e20(labelled(x), K, 0.55), LABELS + f""" y as (select *, (sum(case when c15 and direction15 = 1 then label end) over g + 1) / (count(case when c15 and direction15 = 1 then label end) over g + 2) as up_, (sum(case when c15 and direction15 = -1 then label end) over g + 1) / (count(case when c15 and direction15 = -1 then label end) over g + 2) as dn_
  from w window g as (partition by instrument, sm order by session_no rows between {K} preceding and 1 preceding))""", "(case when direction15 > 0 then up_ >= 0.55 else dn_ >= 0.55 end)")


@add("signal_e11", CONTEXT + """, sp as (select instrument, sday, case when sm < 480 then 0 when sm < 840 then 1 else 2 end as part, count(*) as n, sign(arg_max(c, tmin) - arg_min(o, tmin)) as side from x where sm >= 0 and sm < 930 group by all),
sd as (select instrument, sday, min(side) as side from sp where n >= case part when 0 then 240 when 1 then 180 else 45 end group by 1, 2 having count(*) = 3 and min(side) = max(side) and min(side) <> 0)
select instrument, min(tmin) as tmin, cast(any_value(side) as integer) as state from x join sd using (instrument, sday) where base_ok and c15 and direction15 = side and sm >= 930 and sm < 1320 group by instrument, sday""")
def signal_e11(spark: SparkSession, folder: str) -> DataFrame:
    return signals.e11(context(spark, folder)).select("instrument", "tmin", "state")


def learnt(name: str, build, source=context) -> None:  # noqa: ANN001
    """Families without SQL: slopes, filters, models and chains; tested by rewriting the future and by planted cases."""

    @add(f"signal_{name}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(source(spark, folder)).where("base_ok and state <> 0").select("instrument", "tmin", "state")


learnt("e13", lambda x: signals.e13(x, K, 2.0), paired)
learnt("e14", signals.e14, paired)
learnt("e21", lambda x: signals.e21(x, 60, 0.55, K))
learnt("e28", lambda x: signals.e28(x, 30, 0.75, K))
learnt("e29", lambda x: signals.e29(x, 30, 0.8, K), paired)
learnt("e30", lambda x: signals.e30(x, 60, 0.45, K))


@add("signals_path")
def signals_path(spark: SparkSession, folder: str) -> DataFrame:
    return signals.path_signals(context(spark, folder), K, K)


@add("feature_tech_ewm")
def feature_tech_ewm(spark: SparkSession, folder: str) -> DataFrame:
    bars = pf.base(spark, folder).select("instrument", "sday", "seg", "tmin", "h", "l", "c", "sig1")
    return sequential.by_group(bars, sequential.technical_ewm, sequential.TECHNICAL)


def with_stops(spark: SparkSession, folder: str) -> DataFrame:
    bars = market.decision_bars(clean(spark, folder))
    tr = F.greatest("h", F.coalesce(R.lag(F.col("c")), F.col("h"))) - F.least("l", F.coalesce(R.lag(F.col("c")), F.col("l")))
    ticks = table(spark, folder, "costs").select("instrument", F.col("tick_size").alias("tick"))
    return bars.withColumn("tr", tr).withColumn("scale", R.mean(F.col("tr"), 15)).join(ticks, "instrument")


#: All 14 exits: the first bar of each level by a minimum over the bars after the entry, written from the rules.
STOPS = f"""with {CLEAN}, n as (select *, {q.lag("sm", -1)} as nsm, greatest(h, coalesce({q.lag("c")}, h)) - least(l, coalesce({q.lag("c")}, l)) as tr from b),
s as (select n.*, tick_size as tick, {q.rmean("tr", 15)} as scale, nsm >= 930 and nsm < 1290 as is_dec, nsm is null or nsm >= 1320 or sm >= 1320 as flat from n join costs using (instrument)),
m(mult) as (values (1.0), (2.0)), dirs(dir) as (values (1), (-1)),
d as (select s.instrument, s.sday, s.seg, s.tmin, s.pos, mult, dir, ceil(mult * sqrt(10) * scale / tick - 1e-9) * tick as stop, tick from s, m, dirs where is_dec and scale is not null),
p as (select d.*, b.o as price, b.tmin as emin, b.o - dir * stop as floor_, b.o + dir * stop * 2.0 as goal2, b.o + dir * stop * 3.0 as goal3 from d join b on b.instrument = d.instrument and b.sday = d.sday and b.seg = d.seg and b.pos = d.pos + 1 where stop >= tick),
w as (select p.instrument, p.sday, p.seg, p.tmin, p.pos, mult, dir, any_value(price) as price, any_value(floor_) as floor_, any_value(goal2) as goal2, any_value(goal3) as goal3, any_value(p.tick) as tick,
  min(s.pos) filter (dir * ((case when dir > 0 then s.l else s.h end) - floor_) <= 0) as i_stop, min(s.pos) filter (dir * ((case when dir > 0 then s.h else s.l end) - goal2) >= p.tick) as i_2,
  min(s.pos) filter (dir * ((case when dir > 0 then s.h else s.l end) - goal3) >= p.tick) as i_3, min(s.pos) filter (flat) as i_flat,
  min(s.pos) filter (s.tmin - emin >= 14) as i_15, min(s.pos) filter (s.tmin - emin >= 29) as i_30, min(s.pos) filter (s.tmin - emin >= 59) as i_60, min(s.pos) filter (s.tmin - emin >= 119) as i_120
  from p join s on s.instrument = p.instrument and s.sday = p.sday and s.seg = p.seg and s.pos > p.pos group by all),
k(name, hold, tgt) as (values ('T15', 15, null), ('T30', 30, null), ('T60', 60, null), ('T120', 120, null), ('EOD', null, null), ('R2', null, 2), ('R3', null, 3)),
x as (select w.*, 'S' || cast(mult as integer) || '_' || name as exit_id, hold, tgt, case tgt when 2 then goal2 when 3 then goal3 end as goal, coalesce(i_stop, 1000000) as a,
  coalesce(case tgt when 2 then i_2 when 3 then i_3 end, 1000000) as g, coalesce(case hold when 15 then i_15 when 30 then i_30 when 60 then i_60 when 120 then i_120 end, 1000000) as ti from w, k),
y as (select *, least(a, g, ti, i_flat) as i from x),
z as (select y.*, s.o, s.c, s.tmin as t from y join s on s.instrument = y.instrument and s.sday = y.sday and s.seg = y.seg and s.pos = y.i),
f as (select *, case when i > pos + 1 and dir * (o - floor_) <= 0 then 'gap_stop' when i > pos + 1 and g = i and dir * (o - goal) >= tick then 'target' when a = i then 'stop' when g = i then 'target' when ti = i then 'time' else 'flat' end as reason from z)
select instrument, sday, tmin, exit_id, dir, round(dir * (case reason when 'gap_stop' then o when 'stop' then floor_ when 'target' then goal else c end - price), 6) + 0.0 as pnl, t as exit_tmin, reason from f"""


@add("exit_outcomes", STOPS)
def exit_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return simulate.outcomes(with_stops(spark, folder)).withColumn("pnl", F.round("pnl", 6) + 0.0)


def taken(spark: SparkSession, folder: str) -> DataFrame:
    return simulate.greedy(exit_outcomes(spark, folder), ["instrument", "sday", "exit_id", "dir"])


GREEDY = f"""with out_ as materialized (select *, row_number() over () as id from ({STOPS})),
ev as (select instrument, sday, exit_id, dir, tmin as t, 1 as kind, id as start_id, null as id from out_ union all select instrument, sday, exit_id, dir, exit_tmin, 0, null, id from out_ where pnl is not null),
nx as materialized (select id, next from (select id, first_value(start_id ignore nulls) over (partition by instrument, sday, exit_id, dir order by t, kind rows between current row and unbounded following) as next from ev) where id is not null and next is not null),
first as materialized (select arg_min(id, tmin) as id from out_ where pnl is not null group by instrument, sday, exit_id, dir),
go as materialized (with recursive r as (select id, 0 as trade_no from first union all select next as id, trade_no + 1 as trade_no from r join nx using (id)) select * from r),
tr as materialized (select instrument, sday, exit_id, dir, trade_no, tmin, exit_tmin, pnl from go join out_ using (id))"""


@add("greedy_trades", GREEDY + " select instrument, sday, exit_id, dir, trade_no, tmin, exit_tmin, pnl from tr")
def greedy_trades(spark: SparkSession, folder: str) -> DataFrame:
    return taken(spark, folder)


@add("rule_stats", GREEDY + """, eq as (select *, sum(pnl) over w as eq, count(*) filter (pnl >= 0) over w as island from tr window w as (partition by instrument, exit_id, dir order by tmin rows unbounded preceding)),
dd as (select *, greatest(max(eq) over (partition by instrument, exit_id, dir order by tmin rows unbounded preceding), 0) - eq as dd from eq),
st as (select instrument, exit_id, dir, max(k) as losing_streak from (select instrument, exit_id, dir, island, count(*) filter (pnl < 0) as k from eq group by all) group by all)
select instrument, exit_id, dir, count(*) as n, round(sum(pnl), 4) + 0.0 as total, round(avg(pnl) + 1e-9, 6) + 0.0 as mean, round(avg((pnl > 0)::int), 6) as win_rate, round(case when sum(greatest(-pnl, 0)) > 0 then sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)) end, 4) as profit_factor,
  round(case when (sum(pnl * pnl) - sum(pnl) * sum(pnl) / count(*)) / nullif(count(*) - 1, 0) > 1e-12 then avg(pnl) / sqrt((sum(pnl * pnl) - sum(pnl) * sum(pnl) / count(*)) / nullif(count(*) - 1, 0) / count(*)) end, 4) + 0.0 as t_stat,
  round(max(dd), 4) + 0.0 as max_drawdown, any_value(st.losing_streak) as losing_streak from dd join st using (instrument, exit_id, dir) group by all""")
def rule_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = simulate.trade_metrics(taken(spark, folder), ["instrument", "exit_id", "dir"], order="tmin")
    # as the SQL rounds: the scaled double, not its shortest decimal
    scaled = lambda x, d: F.round(x * 10.0**d) / 10.0**d + 0.0
    r = lambda c, d: scaled(F.col(c), d).alias(c)
    return s.select("instrument", "exit_id", "dir", "n", r("total", 4), scaled(F.col("mean") + 1e-9, 6).alias("mean"), r("win_rate", 6), r("profit_factor", 4), r("t_stat", 4), r("max_drawdown", 4), "losing_streak")


@add("mae_mfe", GREEDY + f""", {CLEAN}, e as (select tr.*, (select arg_min(b.o, b.tmin) from b where b.instrument = tr.instrument and b.sday = tr.sday and b.tmin > tr.tmin and b.tmin <= tr.exit_tmin) as price from tr)
select e.instrument, e.sday, e.tmin, e.exit_id, e.dir, round(greatest(0, max(case when dir > 0 then price - l else h - price end)), 6) as mae, round(greatest(0, max(case when dir > 0 then h - price else price - l end)), 6) as mfe
from e join b on b.instrument = e.instrument and b.sday = e.sday and b.tmin > e.tmin and b.tmin <= e.exit_tmin group by all""")
def mae_mfe(spark: SparkSession, folder: str) -> DataFrame:
    """Excursions from the entry bar on; bars meet trades by (instrument, session), both bounded by time."""
    bars = clean(spark, folder).select("instrument", "sday", F.col("tmin").alias("t"), "o", "h", "l")
    j = taken(spark, folder).join(bars, ["instrument", "sday"]).where("t > tmin and t <= exit_tmin")
    keys = ["instrument", "sday", "tmin", "exit_id", "dir"]
    a = j.groupBy(*keys).agg(F.min_by("o", "t").alias("price"), F.min("l").alias("lo"), F.max("h").alias("hi"))
    up = F.col("dir") > 0
    down_move, up_move = F.col("price") - F.col("lo"), F.col("hi") - F.col("price")
    return a.select(*keys, F.round(F.greatest(F.lit(0.0), F.when(up, down_move).otherwise(up_move)), 6).alias("mae"), F.round(F.greatest(F.lit(0.0), F.when(up, up_move).otherwise(down_move)), 6).alias("mfe"))


def signalled(spark: SparkSession, folder: str) -> DataFrame:
    x = signals.e27(context(spark, folder)).where("tr is not null or pos = 0")
    return x.withColumn("signal", F.when(F.col("base_ok"), F.col("state")).otherwise(0).cast("double")).withColumn("risk", F.col("stop"))


@add("managed_trades")
def managed_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Four management templates over the same signals."""
    return simulate.managed_trades(signalled(spark, folder))
