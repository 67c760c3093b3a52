"""One query for each feature family, triggers, filter bits and symbol codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features as f
from tickloom.operators import market
from tickloom.operators.windows import Rolling, clock_quantile, log, ratio
from tickloom.plans import oracle as q
from tickloom.plans.market import clean
from tickloom.plans.oracle import CLEAN, G
from tickloom.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add
R = Rolling()
#: Sessions behind clock means in these queries; the library's default is larger.
K = 4
#: Added before rounding, so that exact halves fall to one side in either engine.
NUDGE = 1e-10


def clock(x: str, k: int = K, frac: float = 0.5) -> str:
    import math

    w = f"(partition by instrument, sm order by session_no range between {k} preceding and 1 preceding)"
    return f"case when count({x}) over {w} >= {max(1, math.ceil(frac * k))} then avg({x}) over {w} end"


BASE = f"""with {CLEAN},
x0 as (select *, {q.lag("c")} as pc, dense_rank() over (partition by instrument order by sday) as session_no from b),
x1 as (select *, {q.ln("c / pc")} as r1, c - pc as d, case when not coalesce(rw, false) then v end as vv, coalesce(case when pc is not null then greatest(h, pc) - least(l, pc) end, h - l) as tr from x0),
x2 as (select *, {q.rmean("r1 * r1", 30, 0.5)} as m30_r2, {q.rmean("tr", 30, 0.5)} as m30_tr, {clock("r1 * r1")} as e_r2, {clock("tr")} as e_tr, {clock("vv")} as e_v from x1),
x as (select *, coalesce(sqrt(sqrt(e_r2 * m30_r2)), sqrt(e_r2)) as sig1, coalesce(sqrt(e_tr * m30_tr), e_tr) as stop_scale from x2)
"""


def rounded(df: DataFrame, names: list[str], places: int = 6, keys: tuple[str, ...] = ("instrument", "tmin")) -> DataFrame:
    return df.select(*keys, *[(F.round(F.col(n) + NUDGE, places) + F.lit(0.0)).alias(n) for n in names])


def sql(columns: dict[str, str], source: str = "x", places: int = 6, head: str = BASE, keys: str = "instrument, tmin") -> str:
    return f"{head} select {keys}, " + ", ".join(f"round({e} + {NUDGE}::double, {places}) + 0.0 as {n}" for n, e in columns.items()) + f" from {source}"


def base(spark: SparkSession, folder: str) -> DataFrame:
    return f.base(clean(spark, folder), K)


#: The SQL of each family's columns, for queries that take several families.
FAMILIES: dict[str, dict[str, str]] = {}


def family(name: str, build, columns: dict[str, str], places: int = 6, head: str = BASE, source: str = "x") -> None:  # noqa: ANN001
    """Register a family given as columns over the base."""
    FAMILIES[name] = columns

    @add(name, sql(columns, source, places, head))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        x = base(spark, folder)
        built = build(x)
        made = x.withColumns(built) if isinstance(built, dict) else built
        return rounded(made, list(columns), places)


family("feature_base", lambda x: {}, {"r1": "r1", "tr": "tr", "sig1": "sig1", "stop_scale": "stop_scale"}, 8)
z = lambda e, h: f"{e} / nullif(sig1 * sqrt({h}.0), 0)"
s = lambda h: f"coalesce(sign({q.ln(f'c / {q.lag('c', h)}')}), 0)"
family(
    "feature_ret", f.returns,
    {f"retz_{h}": z(q.ln(f"c / {q.lag('c', h)}"), h) for h in (1, 5, 15, 30, 60, 120, 240)}
    | {f"dsma_{h}": z(q.ln(f"c / ({q.rmean('c', h)})"), h) for h in (15, 60, 240)}
    | {f"pos_range_{h}": q.ratio(f"c - ({q.rmin('l', h)})", f"({q.rmax('h', h)}) - ({q.rmin('l', h)})") for h in (15, 60, 240)}
    | {"open_retz": q.ln(f"c / (case when sm >= 930 then last_value(case when sm = 930 then o end ignore nulls) over ({G} rows between unbounded preceding and current row) end)") + " / nullif(sig1 * sqrt(greatest(sm - 929, 1)::double), 0)"}
    | {"trend_agree": f"case when {q.ln(f'c / {q.lag('c', 240)}')} is not null and sig1 > 0 then {s(5)} + {s(15)} + {s(60)} + {s(240)} end"},
)
lr = lambda w: q.ln(q.ratio(q.rsum("vv", w), q.rsum("e_v", w)))
share = lambda e, w: q.ratio(q.rsum(e, w), q.rsum("vv", w))
family(
    "feature_vol", f.volumes,
    {f"lrvol_{w}": lr(w) for w in (1, 3, 5, 10, 15, 30, 60)} | {"vol_mom": f"{lr(5)} - {lr(60)}"}
    | {f"vol_conc_{w}": q.ratio(q.rmax("vv", w), q.rsum("vv", w)) for w in (15, 60)}
    | {"vol_entropy_15": f"case when ({q.rsum('vv', 15)}) > 0 then (ln({q.rsum('vv', 15)}) - ({q.rsum('(case when vv > 0 then vv * ln(vv) else 0.0 end)', 15)}) / ({q.rsum('vv', 15)})) / ln(15) end"}
    | {f"upvol_{w}": share("case when c > o then vv when vv is not null then 0 end", w) for w in (15, 60)}
    | {f"sgnvol_{w}": share("sign(c - o) * vv", w) for w in (15, 60)}
    | {f"clvvol_{w}": share("(case when h > l then (2 * c - h - l) / (h - l) else 0 end) * vv", w) for w in (15, 60)}
    | {f"obv_{w}": share("sign(d) * vv", w) for w in (30, 120)}
    | {"pvt_30": f"{share('r1 * vv', 30)} / nullif(sig1, 0)",
       "ret_per_vol_15": f"abs({z(q.ln(f'c / {q.lag('c', 15)}'), 15)}) / exp({lr(15)})", "range_per_vol_15": f"{z(f'((({q.rmax('h', 15)}) - ({q.rmin('l', 15)})) / c)', 15)} / exp({lr(15)})",
       "er_per_vol_15": f"abs({q.ratio(f'c - ({q.lag('c', 15)})', q.rsum('abs(d)', 15))}) / exp({lr(15)})"},
    4,
)

turn = lambda k: q.rsum(f"(case when turn = {k} then vv when vv is not null and turn is not null then 0.0 end)", 30)
VOLCH = BASE + f""", v1 as (select *, {lr(5)} as lr5, {lr(15)} as lr15, sign(c - ({q.lag('c', 30)})) as way, sign(d) as turn, sm >= 930 as rth from x),
v2 as (select *, {turn(1)} as s1, {turn(0)} as s0, {turn(-1)} as s_1, sum(coalesce(vv, 0)) over ({G} rows unbounded preceding) as cs, sum(coalesce(e_v, 0)) over ({G} rows unbounded preceding) as ce,
  sum(coalesce(vv, 0)) over wr as rs, sum(coalesce(e_v, 0)) over wr as re from v1 window wr as (partition by instrument, sday, seg, rth order by tmin rows unbounded preceding))"""
family("feature_vol_changes", f.volume_changes, {
    "vol_accel": f"lr5 - ({q.lag('lr5', 5)})", "vol_expansion": f"lr15 - ({q.lag('lr15', 15)})",
    "dirvol_30": "ln(((case when way > 0 then s1 when way < 0 then s_1 else s0 end) + 1) / ((case when way > 0 then s_1 when way < 0 then s1 else s0 end) + 1))",
    "lrvol_cum_sess": q.ln(q.ratio("cs", "ce")), "lrvol_cum_rth": f"case when rth then {q.ln(q.ratio('rs', 're'))} end",
}, 5, VOLCH, "v2")


def ols(h: int) -> dict[str, str]:
    w = q.frame(h)
    keep = lambda e: f"case when pos >= {h - 1} and count(c) over {w} = {h} then {e} end"
    slope = f"regr_slope(c - base_c, pos) over {w}"
    rss = f"greatest(var_pop(c - base_c) over {w} * (1 - coalesce(regr_r2(c - base_c, pos) over {w}, 1)), 0)"
    return {f"ols_r2_{h}": keep(f"case when var_pop(c - base_c) over {w} > 1e-18 then regr_r2(c - base_c, pos) over {w} end"), f"ols_slope_{h}": keep(slope), f"ols_resid_{h}": keep(f"sqrt({rss})")}


OLS_HEAD = BASE + f", y as (select *, first_value(c) over ({G}) as base_c from x)"


@add("feature_ols", sql({k: v for h in (15, 30) for k, v in ols(h).items()}, "y", 4, OLS_HEAD))
def feature_ols(spark: SparkSession, folder: str) -> DataFrame:
    x = base(spark, folder).withColumn("y", F.col("c") - F.first("c").over(R.so_far))
    made = {}
    for h in (15, 30):
        fit = R.ols(F.col("y"), h)
        made |= {f"ols_{k}_{h}": fit[k] for k in ("r2", "slope", "resid")}
    return rounded(x.withColumns(made), list(made), 4)


family(
    "feature_path", f.paths,
    {f"er_{h}": q.ratio(f"c - ({q.lag('c', h)})", q.rsum("abs(d)", h)) for h in (5, 15, 30, 60, 120, 240)}
    | {"body_30": f"case when abs(c - ({q.lag('c', 30)})) > 1e-6 then ({q.rsum('(c - o)', 30)}) / (c - ({q.lag('c', 30)})) end", "wick_30": q.ratio(q.rsum("((h - l) - abs(c - o))", 30), q.rsum("(h - l)", 30)),
       "hhi_30": q.ratio(q.rsum("d * d", 30), f"({q.rsum('abs(d)', 30)}) * ({q.rsum('abs(d)', 30)})")},
    4,
)

N = 15
STEPS = f"""{BASE}, y as (select *, array_agg(d) over {q.frame(N)} as steps, count(d) over {q.frame(N)} as n_steps from x),
w as (select instrument, tmin, case when pos >= {N} and n_steps = {N} then steps end as st from y),
v as (select *, list_sum(st) as net, list_sum(list_transform(st, lambda e: abs(e))) as path, list_reverse_sort(list_transform(st, lambda e: abs(e))) as big from w)
"""


@add("feature_path_stats", sql({
    f"path_revs_{N}": f"case when st is not null then len(list_filter(range(2, {N + 1}), lambda i: st[i] * st[i - 1] < 0)) / {N}.0 end",
    f"path_dfrac_{N}": f"case when abs(net) > 1e-9 * path then len(list_filter(st, lambda e: sign(e) = sign(net))) / {N}.0 end",
    f"path_big1_{N}": q.ratio("big[1]", "path"), f"path_top3_{N}": q.ratio("big[1] + big[2] + big[3]", "path"),
    f"path_early_{N}": q.ratio(f"list_sum(list_transform(st[1:{N // 3}], lambda e: abs(e)))", "path"), f"path_late_{N}": q.ratio(f"list_sum(list_transform(st[{N - N // 3 + 1}:{N}], lambda e: abs(e)))", "path"),
    f"path_retr_{N}": "case when st is not null then least(50, " + q.ratio(f"list_max(list_transform(range(1, {N + 1}), lambda i: greatest(0, list_max(list_transform(range(0, i + 1), lambda j: coalesce(list_sum(st[1:j]), 0) * sign(net)))) - list_sum(st[1:i]) * sign(net)))", "(case when abs(net) > 1e-9 * path then abs(net) end)") + ") * (case when abs(net) > 1e-9 * path then 1 end) end",
}, "v", 6, STEPS))
def feature_path_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(f.path_stats(clean(spark, folder), N), [f"path_{k}_{N}" for k in f.PATH_STATS if k != "run"])


m2, m3, m4 = (lambda w: q.rmean("r1 * r1", w)), (lambda w: q.rmean("r1 * r1 * r1", w)), (lambda w: q.rmean("r1 * r1 * r1 * r1", w))
dist: dict[str, str] = {}
for w_ in (15, 30, 60, 120):
    rv = q.rsum("r1 * r1", w_)
    dist |= {
        f"rvratio_{w_}": q.ratio(rv, q.rsum("e_r2", w_)),
        f"semi_{w_}": q.ratio(f"({q.rsum('(case when r1 > 0 then r1 * r1 when r1 is not null then 0 end)', w_)}) - ({q.rsum('(case when r1 < 0 then r1 * r1 when r1 is not null then 0 end)', w_)})", rv),
        f"skew_{w_}": q.ratio(m3(w_), f"({m2(w_)}) * sqrt({m2(w_)})"), f"kurt_{w_}": q.ratio(m4(w_), f"({m2(w_)}) * ({m2(w_)})"), f"mabs_{w_}": f"({q.rmean('abs(r1)', w_)}) / nullif(sig1, 0)",
    }
dist |= {"maxpos_30": f"({q.rmax('r1', 30)}) / nullif(sig1, 0)", "maxneg_30": f"({q.rmin('r1', 30)}) / nullif(sig1, 0)", **{f"tailfreq_{w}": q.rmean("coalesce(abs(r1) > 3 * sig1, false)::int::double", w) for w in (30, 60)}}
family("feature_dist", f.distributions, dist, 5)

JUMP = BASE + f""", j1 as (select *, abs(r1) * abs({q.lag("r1")}) as bp from x),
j2 as (select *, pi() / 2 * ({q.rsum("bp", 60)}) as bv60 from j1),
j as (select *, r1 / nullif(sqrt(({q.lag("bv60")}) / 59), 0) as jz from j2)"""
jr = lambda w: q.ratio(f"greatest(({q.rsum('r1 * r1', w)}) - pi() / 2 * ({q.rsum('bp', w)}), case when ({q.rsum('r1 * r1', w)}) is null or ({q.rsum('bp', w)}) is null then null else 0 end)", q.rsum("r1 * r1", w))
family("feature_jump", f.jumps, {
    "jz": "jz", "jr_30": jr(30), "jr_60": jr(60), "jcount_pos_30": q.rsum("coalesce(jz > 4, false)::int::double", 30), "jcount_neg_30": q.rsum("coalesce(jz < -4, false)::int::double", 30),
    "bars_since_jump": f"pos - last_value(case when abs(jz) > 4 then pos end ignore nulls) over ({G} rows between unbounded preceding and current row)",
}, 4, JUMP, "j")


def corr_sql(x: str, y: str, n: int, f_: float = 1.0) -> str:
    bx, by = f"(case when {x} is not null and {y} is not null then {x} end)", f"(case when {x} is not null and {y} is not null then {y} end)"
    w = q.frame(n)
    return q.guard(f"case when var_pop({bx}) over {w} > 1e-18 and var_pop({by}) over {w} > 1e-18 then corr({bx}, {by}) over {w} end", bx, n, f_)


PERS = BASE + f""", p1 as (select *, {q.rsum("r1", 5)} as r5, {q.rsum("r1", 15)} as r15, {q.lag("r1")} as rl, {q.lag("r1", 2)} as rl2, sign(r1) as s from x),
p2 as (select *, {q.lag("s")} as sl, case when rl2 is not null then coalesce(r1 > 0, false)::int + 2 * coalesce(rl > 0, false)::int + 4 * coalesce(rl2 > 0, false)::int end as pattern, {q.ratio(q.rsum("r5 * r5", 120), f"5 * ({q.rsum('r1 * r1', 120)})")} as vr5,
  abs({q.ratio(f"c - ({q.lag('c', 30)})", q.rsum("abs(d)", 30))}) as er30, {q.ln(q.ratio(q.rsum("r1 * r1", 30), q.rsum("e_r2", 30)))} as lrr from p1)"""
pattern_n = q.rsum("(case when pattern is not null then 1.0::double end)", 60)
pattern_k = lambda k: f"(({q.rsum(f'(case when pattern is not null then (pattern = {k})::int::double end)', 60)}) / ({pattern_n}))"
family("feature_pers", f.persistence, {
    "vr5_60": q.ratio(q.rmean("r5 * r5", 60), f"5 * ({q.rmean('r1 * r1', 60)})"), "vr5_120": q.ratio(q.rmean("r5 * r5", 120), f"5 * ({q.rmean('r1 * r1', 120)})"),
    "vr15_120": q.ratio(q.rmean("r15 * r15", 120), f"15 * ({q.rmean('r1 * r1', 120)})"), "sac1_60": corr_sql("s", "sl", 60),
    "entropy_60": "(" + " + ".join(f"(case when {pattern_k(k)} > 0 then -{pattern_k(k)} * ln({pattern_k(k)}) when {pattern_k(k)} is not null then 0 end)" for k in range(8)) + ") / ln(8)",
    "er_ch": f"er30 - ({q.lag('er30', 30)})", "volreg_ch": f"lrr - ({q.lag('lrr', 30)})", "vr_ch": f"vr5 - ({q.lag('vr5', 30)})",
}, 5, PERS, "p2")

VWAP = BASE + f""", v1 as (select *, sm >= 930 as rth, (h + l + c) / 3 as tp, coalesce(v, 0) as v0 from x),
v2 as (select *, {q.ratio(f"sum(tp * v0) over ({G} rows unbounded preceding)", f"sum(v0) over ({G} rows unbounded preceding)")} as vwap_glx,
  case when rth then {q.ratio("sum(tp * v0) over wr", "sum(v0) over wr")} end as vwap_rth from v1 window wr as (partition by instrument, sday, seg, rth order by tmin rows unbounded preceding)),
v3 as (select *, sign(c - vwap_rth) as side from v2),
v4 as (select *, sum(case when side = ps then 0 else 1 end) over ({G} rows unbounded preceding) as run_id from (select *, {q.lag("side")} as ps from v3))"""
family("feature_vwap", f.vwap, {"vdist_glx": z(q.ln("c / vwap_glx"), 30), "vdist_rth": z(q.ln("c / vwap_rth"), 30), "vslope_rth": z(q.ln(f"vwap_rth / ({q.lag('vwap_rth', 15)})"), 15), "vside_run_rth": "side * row_number() over (partition by instrument, sday, seg, run_id order by tmin)"}, 6, VWAP, "v4")


@add("feature_open", f"""with {CLEAN}, n as (select *, {q.lag("c")} as pc from b where sm < 930), r as (select *, {q.ln("c / pc")} as r1 from n),
a as (select instrument, sday, arg_min(o, tmin) as fo, arg_max(c, tmin) as lc, max(h) as hi, min(l) as lo, sum(abs(c - pc)) as path, coalesce(sum(r1 * r1) filter (r1 > 0), 0) as up, coalesce(sum(r1 * r1) filter (r1 < 0), 0) as down, count(*) as k, corr(c, tmin) as rho from r group by 1, 2)
select instrument, sday, round(ln(lc / fo) + 1e-10::double, 6) + 0.0 as on_ret, round(ln(hi / lo) + 1e-10::double, 6) as on_range, round({q.ratio("lc - fo", "path")} + 1e-10::double, 6) + 0.0 as on_er, round({q.ratio("lc - lo", "hi - lo")} + 1e-10::double, 6) as on_loc, round({q.ratio("up - down", "up + down")} + 1e-10::double, 6) + 0.0 as on_semi, round(case when k >= 30 then rho * rho end, 4) as on_r2 from a""")
def feature_open(spark: SparkSession, folder: str) -> DataFrame:
    o = f.overnight(clean(spark, folder))
    return rounded(o, ["on_ret", "on_range", "on_er", "on_loc", "on_semi"], keys=("instrument", "sday", "on_r2")).withColumn("on_r2", F.round("on_r2", 4))


XMKT = BASE + f""", al as (select x.*, es.c as ec, es.c is not null as evalid from x left join (select tmin, c from b where instrument = 'ES') es using (tmin) where instrument = 'NQ'),
y1 as (select *, {q.ln(f"ec / ({q.lag('ec')})")} as er1, ec - ({q.lag('ec')}) as ed, {q.ln(f"c / ({q.lag('c', 5)})")} as n5, {q.ln(f"ec / ({q.lag('ec', 5)})")} as e5, {q.ln(f"ec / ({q.lag('ec', 15)})")} as eret15 from al)"""
ex, ey = "(case when r1 is not null and er1 is not null then er1 end)", "(case when r1 is not null and er1 is not null then r1 end)"
beta = q.guard(f"case when var_pop({ex}) over {q.frame(120)} > 1e-18 then covar_pop({ey}, {ex}) over {q.frame(120)} / var_pop({ex}) over {q.frame(120)} end", ex, 120)
semi_sql = lambda y: q.ratio(f"({q.rsum(f'(case when {y} > 0 then {y} * {y} else 0.0 end)', 30)}) - ({q.rsum(f'(case when {y} < 0 then {y} * {y} else 0.0 end)', 30)})", q.rsum(f"{y} * {y}", 30))
er_sql = lambda p, d, h: q.ratio(f"{p} - ({q.lag(p, h)})", q.rsum(f"abs({d})", h))
vr_sql = lambda y5, y: q.ratio(q.rsum(f"{y5} * {y5}", 120), f"5 * ({q.rsum(f'{y} * {y}', 120)})")
CROSS = {
    "corr_60": corr_sql("r1", "er1", 60), "rel_semi_30": f"{semi_sql('r1')} - {semi_sql('er1')}", "rel_er_15": f"{er_sql('c', 'd', 15)} - {er_sql('ec', 'ed', 15)}", "rel_er_60": f"{er_sql('c', 'd', 60)} - {er_sql('ec', 'ed', 60)}",
    "pers_disagree": f"{vr_sql('n5', 'r1')} - {vr_sql('e5', 'er1')}", "residz_15": z(f"({q.ln(f'c / ({q.lag('c', 15)})')} - ({beta}) * eret15)", 15),
}


@add("feature_xmkt", sql(CROSS, "y1", 4, XMKT))
def feature_xmkt(spark: SparkSession, folder: str) -> DataFrame:
    x = base(spark, folder).where("instrument in ('NQ', 'ES')")
    other = x.where("instrument = 'ES'").select("tmin", F.col("c").alias("ec"))
    both = x.where("instrument = 'NQ'").join(other, "tmin", "left").withColumn("evalid", F.col("ec").isNotNull())
    return rounded(f.cross_market(both), list(CROSS), 4)


family("feature_tech", f.technical, {
    "stoch_14": "100 * " + q.ratio(f"c - ({q.rmin('l', 14)})", f"({q.rmax('h', 14)}) - ({q.rmin('l', 14)})"),
    "aroon_osc_25": f"case when pos >= 25 then 100 * ((arg_max(pos, (h, pos)) over {q.frame(26)}) - (arg_max(pos, (-l, pos)) over {q.frame(26)})) / 25.0 end",
})
