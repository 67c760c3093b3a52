"""Causal features of bars by family, as stages of window expressions.

Everything looks back inside the group of session and contract, but for the clock means (same
minute of earlier sessions) and session levels. Default lookbacks are the catalogue's; ``K`` is
the number of sessions behind a clock mean.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import market
from tickloom.operators.sequential import by_group
from tickloom.operators.windows import Rolling, both, clock_mean, correlation, log, ratio

R = Rolling()


def base(bars: DataFrame, K: int = 20) -> DataFrame:
    """r1, tr, d, vv, session_no, e_r2, e_tr, e_v, sig1 and stop_scale."""
    c = F.col("c")
    prev = R.lag(c)
    one = bars.withColumns({
        "r1": log(c / prev), "d": c - prev, "vv": F.when(~F.coalesce("rw", F.lit(False)), F.col("v")),
        "tr": F.coalesce(F.when(prev.isNotNull(), F.greatest("h", prev) - F.least("l", prev)), F.col("h") - F.col("l")),
    }).join(market.session_numbers(bars), ["instrument", "sday"])
    r2 = F.col("r1") * F.col("r1")
    two = one.withColumns({"m30_r2": R.mean(r2, 30, 0.5), "m30_tr": R.mean(F.col("tr"), 30, 0.5)}).withColumns(
        {"e_r2": clock_mean(r2, K, min_frac=0.5), "e_tr": clock_mean(F.col("tr"), K, min_frac=0.5), "e_v": clock_mean(F.col("vv"), K, min_frac=0.5)}
    )
    return two.withColumns({
        "sig1": F.coalesce(F.sqrt(F.sqrt(F.col("e_r2") * F.col("m30_r2"))), F.sqrt("e_r2")),
        "stop_scale": F.coalesce(F.sqrt(F.col("e_tr") * F.col("m30_tr")), F.col("e_tr")),
    })


def scaled(e: Column, h: float | Column) -> Column:
    """Over the usual deviation of h minutes."""
    return e / F.nullif(F.col("sig1") * F.sqrt(F.lit(float(h)) if isinstance(h, (int, float)) else h), F.lit(0.0))


def returns(x: DataFrame, horizons: tuple[int, ...] = (1, 5, 15, 30, 60, 120, 240), means: tuple[int, ...] = (15, 60, 240)) -> dict[str, Column]:
    c, sm = F.col("c"), F.col("sm")
    moved = lambda h: log(c / R.lag(c, h))
    out = {f"retz_{h}": scaled(moved(h), h) for h in horizons}
    out |= {f"dsma_{h}": scaled(log(c / R.mean(c, h)), h) for h in means}
    out |= {f"pos_range_{h}": ratio(c - R.min(F.col("l"), h), R.max(F.col("h"), h) - R.min(F.col("l"), h)) for h in means}
    opened = F.when(sm >= 930, R.last_where(sm == 930, F.col("o")))
    out["open_retz"] = scaled(log(c / opened), F.greatest(sm - 929, F.lit(1)).cast("double"))
    sign = lambda h: F.coalesce(F.signum(moved(h)), F.lit(0.0))
    return out | {"trend_agree": F.when(moved(240).isNotNull() & (F.col("sig1") > 0), sign(5) + sign(15) + sign(60) + sign(240))}


def volumes(x: DataFrame) -> dict[str, Column]:
    v, e, c, o, d = F.col("vv"), F.col("e_v"), F.col("c"), F.col("o"), F.col("d")
    lr = lambda w: log(ratio(R.sum(v, w), R.sum(e, w)))
    span = F.col("h") - F.col("l")
    place = F.when(span > 0, (2 * c - F.col("h") - F.col("l")) / span).otherwise(0.0)
    out = {f"lrvol_{w}": lr(w) for w in (1, 3, 5, 10, 15, 30, 60)}
    out |= {"vol_mom": lr(5) - lr(60)}
    out |= {f"vol_conc_{w}": ratio(R.max(v, w), R.sum(v, w)) for w in (15, 60)}
    mixed = R.sum(F.when(v > 0, v * F.ln(v)).otherwise(0.0), 15)
    out["vol_entropy_15"] = F.when(R.sum(v, 15) > 0, (F.ln(R.sum(v, 15)) - mixed / R.sum(v, 15)) / math.log(15))
    for w in (15, 60):
        out[f"upvol_{w}"] = ratio(R.sum(F.when(c > o, v).otherwise(F.when(v.isNotNull(), 0.0)), w), R.sum(v, w))
        out[f"sgnvol_{w}"] = ratio(R.sum(F.signum(c - o) * v, w), R.sum(v, w))
        out[f"clvvol_{w}"] = ratio(R.sum(place * v, w), R.sum(v, w))
    out |= {f"obv_{w}": ratio(R.sum(F.signum("d") * v, w), R.sum(v, w)) for w in (30, 120)}
    out["pvt_30"] = ratio(R.sum(F.col("r1") * v, 30), R.sum(v, 30)) / F.nullif(F.col("sig1"), F.lit(0.0))
    usual = F.exp(lr(15))
    out["ret_per_vol_15"] = F.abs(scaled(log(c / R.lag(c, 15)), 15)) / usual
    out["range_per_vol_15"] = scaled((R.max(F.col("h"), 15) - R.min(F.col("l"), 15)) / c, 15) / usual
    out["er_per_vol_15"] = F.abs(ratio(c - R.lag(c, 15), R.sum(F.abs(d), 15))) / usual
    return out


def volume_changes(x: DataFrame) -> DataFrame:
    """Measures that need another stage: accelerations, volume with and against the 30-bar move, cumulative
    volume since the group's start and since 09:30 against the usual one."""
    v, e = F.col("vv"), F.col("e_v")
    lr = lambda w: log(ratio(R.sum(v, w), R.sum(e, w)))
    rth = F.col("sm") >= 930
    w = Window.partitionBy(*R.group, "rth").orderBy("tmin").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda q, over: F.sum(F.coalesce(q, F.lit(0.0))).over(over)
    one = x.withColumns({"lr5": lr(5), "lr15": lr(15), "way": F.signum(F.col("c") - R.lag(F.col("c"), 30)), "turn": F.signum("d"), "rth": rth})
    # the direction is that of the window's end, so volumes are summed by the sign of each step first
    sums = {k: R.sum(F.when(F.col("turn") == k, v).otherwise(F.when(v.isNotNull() & F.col("turn").isNotNull(), 0.0)), 30) for k in (1, 0, -1)}
    with_way = F.when(F.col("way") > 0, sums[1]).when(F.col("way") < 0, sums[-1]).otherwise(sums[0])
    against = F.when(F.col("way") > 0, sums[-1]).when(F.col("way") < 0, sums[1]).otherwise(sums[0])
    return one.withColumns({
        "vol_accel": F.col("lr5") - R.lag(F.col("lr5"), 5), "vol_expansion": F.col("lr15") - R.lag(F.col("lr15"), 15), "dirvol_30": F.ln((with_way + 1) / (against + 1)),
        "lrvol_cum_sess": log(ratio(total(v, R.so_far), total(e, R.so_far))), "lrvol_cum_rth": F.when(F.col("rth"), log(ratio(total(v, w), total(e, w)))),
    })


def paths(x: DataFrame) -> dict[str, Column]:
    c, d = F.col("c"), F.col("d")
    out = {f"er_{h}": ratio(c - R.lag(c, h), R.sum(F.abs(d), h)) for h in (5, 15, 30, 60, 120, 240)}
    for h in (15, 30, 60, 120):
        fit = R.ols(c, h)
        out |= {f"ols_t_{h}": fit["t"], f"ols_r2_{h}": fit["r2"], f"ols_resid_{h}": fit["resid"] / F.nullif(c * F.col("sig1"), F.lit(0.0))}
    span = F.col("h") - F.col("l")
    out["body_30"] = F.when(F.abs(c - R.lag(c, 30)) > 1e-6, R.sum(c - F.col("o"), 30) / (c - R.lag(c, 30)))
    out["wick_30"] = ratio(R.sum(span - F.abs(c - F.col("o")), 30), R.sum(span, 30))
    out["hhi_30"] = ratio(R.sum(d * d, 30), R.sum(F.abs(d), 30) * R.sum(F.abs(d), 30))
    return out


def path_kernel(g: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Eight statistics of the n steps between the last n + 1 closes of one group, all windows at once."""
    rows = len(g["c"])
    out = {k: np.full(rows, np.nan) for k in PATH_STATS}
    if rows > n:
        steps = np.lib.stride_tricks.sliding_window_view(np.diff(g["c"]), n)
        sizes, signs = np.abs(steps), np.sign(steps)
        net, path = steps.sum(axis=1), sizes.sum(axis=1)
        way = np.sign(net)[:, None]
        walk = np.cumsum(steps * way, axis=1)
        top = np.maximum(np.maximum.accumulate(walk, axis=1), 0.0)
        ordered, third = np.sort(sizes, axis=1)[:, ::-1], n // 3
        run, best = np.zeros(len(steps), int), np.zeros(len(steps), int)
        for i in range(n):
            same = signs[:, i] == (signs[:, i - 1] if i else np.nan)
            run = np.where(signs[:, i] == 0, 0, np.where(same, run + 1, 1))
            best = np.maximum(best, run)
        with np.errstate(all="ignore"):
            moved, gone = np.abs(net) > 1e-9 * path, path > 0
            share = lambda x: np.where(gone, x / path, np.nan)
            got = (
                np.where(moved, np.minimum((top - walk).max(axis=1) / np.abs(net), 50.0), np.nan), (signs[:, 1:] * signs[:, :-1] < 0).sum(axis=1) / n,
                np.where(moved, (signs == way).sum(axis=1) / n, np.nan), best.astype(float), share(ordered[:, 0]), share(ordered[:, :3].sum(axis=1)),
                share(sizes[:, :third].sum(axis=1)), share(sizes[:, n - third :].sum(axis=1)),
            )
        for k, x in zip(PATH_STATS, got, strict=True):
            out[k][n:] = x
    return {"instrument": g["instrument"], "tmin": g["tmin"], **out}


PATH_STATS = ("retr", "revs", "dfrac", "run", "big1", "top3", "early", "late")


def path_stats(x: DataFrame, n: int) -> DataFrame:
    """(instrument, tmin, path_*_n): largest retracement over the net move (at most 50), reversals, share of steps with
    the move, longest run, shares of the largest step and the top three, of the early and the late third."""
    schema = "instrument string, tmin bigint, " + ", ".join(f"{k} double" for k in PATH_STATS)
    made = by_group(x.select("instrument", "sday", "seg", "tmin", "c"), partial(path_kernel, n=n), schema)
    return made.withColumnsRenamed({k: f"path_{k}_{n}" for k in PATH_STATS})


def distributions(x: DataFrame) -> dict[str, Column]:
    r, out = F.col("r1"), {}
    over = lambda e: e / F.nullif(F.col("sig1"), F.lit(0.0))
    for w in (15, 30, 60, 120):
        up, down = R.sum(F.when(r > 0, r * r).when(r.isNotNull(), 0.0), w), R.sum(F.when(r < 0, r * r).when(r.isNotNull(), 0.0), w)
        all_of = R.sum(r * r, w)
        out[f"rvratio_{w}"] = ratio(all_of, R.sum(F.col("e_r2"), w))
        out[f"semi_{w}"] = ratio(up - down, all_of)
        m2, m3, m4 = R.mean(r * r, w), R.mean(r * r * r, w), R.mean(r * r * r * r, w)
        out[f"skew_{w}"] = ratio(m3, m2 * F.sqrt(m2))
        out[f"kurt_{w}"] = ratio(m4, m2 * m2)
        out[f"mabs_{w}"] = over(R.mean(F.abs(r), w))
    out["maxpos_30"] = over(R.max(r, 30))
    out["maxneg_30"] = over(R.min(r, 30))
    tail = F.coalesce(F.abs(r) > 3 * F.col("sig1"), F.lit(False)).cast("double")
    out |= {f"tailfreq_{w}": R.mean(tail, w) for w in (30, 60)}
    return out


def jumps(x: DataFrame) -> DataFrame:
    """jz, jr_30, jr_60, jcounts and bars since the last jump."""
    pair = F.abs("r1") * F.abs(R.lag(F.col("r1")))
    one = x.withColumn("bp", pair)
    bv = lambda w: F.lit(math.pi / 2) * R.sum(F.col("bp"), w)
    two = one.withColumn("bv60", bv(60)).withColumns({f"jr_{w}": ratio(both(F.greatest, R.sum(F.col("r1") * F.col("r1"), w) - bv(w), F.lit(0.0)), R.sum(F.col("r1") * F.col("r1"), w)) for w in (30, 60)})
    three = two.withColumn("jz", F.col("r1") / F.nullif(F.sqrt(R.lag(F.col("bv60")) / 59), F.lit(0.0)))
    jump = lambda e: F.coalesce(e, F.lit(False)).cast("double")
    return three.withColumns({
        "jcount_pos_30": R.sum(jump(F.col("jz") > 4), 30), "jcount_neg_30": R.sum(jump(F.col("jz") < -4), 30), "bars_since_jump": R.bars_since(F.coalesce(F.abs("jz") > 4, F.lit(False))),
    })


def persistence(x: DataFrame) -> DataFrame:
    """Variance ratios, autocorrelations and the entropy of up and down patterns."""
    r = F.col("r1")
    one = x.withColumns({"r5": R.sum(r, 5), "r15": R.sum(r, 15), "rl": R.lag(r), "s": F.signum(r)}).withColumn("sl", R.lag(F.col("s")))
    vr = lambda q, w: ratio(R.mean(F.col(f"r{q}") * F.col(f"r{q}"), w), q * R.mean(r * r, w))
    up = lambda k: F.coalesce((R.lag(r, k) > 0), F.lit(False)).cast("int")
    coded = one.withColumn("pattern", F.when(R.lag(r, 2).isNotNull(), up(0) + 2 * up(1) + 4 * up(2)))
    shares = [R.sum(F.when(F.col("pattern").isNotNull(), (F.col("pattern") == k).cast("double")), 60) / R.sum(F.when(F.col("pattern").isNotNull(), 1.0), 60) for k in range(8)]
    entropy = sum((F.when(p > 0, -p * F.ln(p)).when(p.isNotNull(), 0.0) for p in shares[1:]), F.when(shares[0] > 0, -shares[0] * F.ln(shares[0])).when(shares[0].isNotNull(), 0.0)) / math.log(8)
    return coded.withColumns({"vr5_60": vr(5, 60), "vr5_120": vr(5, 120), "vr15_120": vr(15, 120), "ac1_30": R.corr(r, F.col("rl"), 30), "ac1_120": R.corr(r, F.col("rl"), 120), "sac1_60": R.corr(F.col("s"), F.col("sl"), 60), "entropy_60": entropy, "er_30": F.abs(ratio(F.col("c") - R.lag(F.col("c"), 30), R.sum(F.abs("d"), 30))), "lrr_30": log(ratio(R.sum(r * r, 30), R.sum(F.col("e_r2"), 30)))}).withColumns(
        {name: F.col(of) - R.lag(F.col(of), 30) for name, of in (("vr_ch", "vr5_120"), ("ac_ch", "ac1_120"), ("er_ch", "er_30"), ("ent_ch", "entropy_60"), ("volreg_ch", "lrr_30"))}
    )


def vwap(x: DataFrame) -> DataFrame:
    """VWAP anchored at the session's and the regular hours' start: distance, side and run length of the side."""
    tp = (F.col("h") + F.col("l") + F.col("c")) / 3
    rth = F.col("sm") >= 930
    w = Window.partitionBy(*R.group, "rth").orderBy("tmin").rowsBetween(Window.unboundedPreceding, 0)
    pv, v = tp * F.coalesce("v", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    one = x.withColumn("rth", rth).withColumns({
        "vwap_glx": ratio(R.cumulative(pv), R.cumulative(v)), "vwap_rth": F.when(rth, ratio(F.sum(pv).over(w), F.sum(v).over(w))),
    })
    two = one.withColumns({"vdist_glx": scaled(log(F.col("c") / F.col("vwap_glx")), 30), "vdist_rth": scaled(log(F.col("c") / F.col("vwap_rth")), 30), "vslope_rth": scaled(log(F.col("vwap_rth") / R.lag(F.col("vwap_rth"), 15)), 15), "vside_rth": F.signum(F.col("c") - F.col("vwap_rth"))})
    change = F.coalesce(F.col("vside_rth") != R.lag(F.col("vside_rth")), F.lit(True)).cast("int")
    three = two.withColumn("run_id", F.sum(change).over(R.so_far))
    run = Window.partitionBy(*R.group, "run_id").orderBy("tmin")
    return three.withColumn("vside_run_rth", F.col("vside_rth") * F.row_number().over(run))


def overnight(bars: DataFrame) -> DataFrame:
    """One row for each session: the hours before 09:30 (return, range, efficiency, location, semivariance)."""
    on = bars.where("sm < 930").withColumn("d", R.diff(F.col("c"))).withColumn("r1", log(F.col("c") / R.lag(F.col("c"))))
    return on.groupBy("instrument", "sday").agg(
        F.min_by("o", "tmin").alias("first_o"), F.max_by("c", "tmin").alias("last_c"), F.max("h").alias("hi"), F.min("l").alias("lo"), F.sum(F.abs("d")).alias("path"),
        F.sum(F.when(F.col("r1") > 0, F.col("r1") * F.col("r1"))).alias("up"), F.sum(F.when(F.col("r1") < 0, F.col("r1") * F.col("r1"))).alias("down"), F.count("*").alias("n"),
        correlation(F.col("c"), F.col("tmin").cast("double")).alias("rho"),
    ).select(
        "instrument", "sday", log(F.col("last_c") / F.col("first_o")).alias("on_ret"), log(F.col("hi") / F.col("lo")).alias("on_range"), ratio(F.col("last_c") - F.col("first_o"), F.col("path")).alias("on_er"),
        ratio(F.col("last_c") - F.col("lo"), F.col("hi") - F.col("lo")).alias("on_loc"), ratio(F.coalesce("up", F.lit(0.0)) - F.coalesce("down", F.lit(0.0)), F.coalesce("up", F.lit(0.0)) + F.coalesce("down", F.lit(0.0))).alias("on_semi"),
        F.when(F.col("n") >= 30, F.col("rho") * F.col("rho")).alias("on_r2"),
    )


def cross_market(x: DataFrame) -> DataFrame:
    """Relative measures of two aligned markets (``x`` from ``base`` with ec and evalid); nothing where the other one is missing."""
    one = x.withColumns({"er1": log(F.col("ec") / R.lag(F.col("ec"))), "ed": F.col("ec") - R.lag(F.col("ec"))})
    r, e, c, ec = F.col("r1"), F.col("er1"), F.col("c"), F.col("ec")
    semi = lambda y: ratio(R.sum(F.when(y > 0, y * y).otherwise(0.0), 30) - R.sum(F.when(y < 0, y * y).otherwise(0.0), 30), R.sum(y * y, 30))
    move = lambda p, d, h: ratio(p - R.lag(p, h), R.sum(F.abs(d), h))
    two = one.withColumns({"n5": log(c / R.lag(c, 5)), "e5": log(ec / R.lag(ec, 5))})
    five = lambda y5, y: ratio(R.sum(y5 * y5, 120), 5 * R.sum(y * y, 120))
    three = two.withColumns({
        "corr_60": R.corr(r, e, 60), "corr_240": R.corr(r, e, 240), "beta_120": R.beta(e, r, 120), "rel_semi_30": semi(r) - semi(e), "eret15": log(ec / R.lag(ec, 15)),
        "rel_er_15": move(c, F.col("d"), 15) - move(ec, F.col("ed"), 15), "rel_er_60": move(c, F.col("d"), 60) - move(ec, F.col("ed"), 60), "pers_disagree": five(F.col("n5"), r) - five(F.col("e5"), e),
    })
    return three.withColumns({"corr_ch": F.col("corr_60") - F.col("corr_240"), "beta_ch": F.col("beta_120") - R.lag(F.col("beta_120"), 60), "residz_15": scaled(log(c / R.lag(c, 15)) - F.col("beta_120") * F.col("eret15"), 15)})


def technical(x: DataFrame) -> DataFrame:
    """CCI, stochastic, Aroon and Bollinger: windows only (the exponential ones are sequential)."""
    tp = (F.col("h") + F.col("l") + F.col("c")) / 3
    one = x.withColumn("tp", tp)
    w = R.last_bars(26)
    last_high, last_low = F.max_by("pos", F.struct("h", "pos")).over(w), F.max_by("pos", F.struct(-F.col("l"), F.col("pos"))).over(w)
    sd = R.std(F.col("c"), 20)
    return one.withColumns({
        "cci_20": ratio(F.col("tp") - R.mean(F.col("tp"), 20), 0.015 * 0.8 * R.std(F.col("tp"), 20)),
        "stoch_14": 100 * ratio(F.col("c") - R.min(F.col("l"), 14), R.max(F.col("h"), 14) - R.min(F.col("l"), 14)),
        "aroon_osc_25": F.when(F.col("pos") >= 25, 100 * (last_high - last_low) / 25.0), "bb_pb": ratio(F.col("c") - R.mean(F.col("c"), 20), 2 * sd),
    })
