"""Backtests, trade tables and their figures, each with its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import execution, metrics, signals, simulate
from tickloom.operators.accounts import round_trip_cents
from tickloom.plans.accounts import CENTS, COST, costs
from tickloom.plans.market import clean
from tickloom.plans.oracle import CLEAN
from tickloom.plans.registry import Registry
from tickloom.plans.trading import FEATURED, GREEDY, LEVELS, STOPS, context, crossing, exit_outcomes, mae_mfe, taken, trigger_events

REGISTRY = Registry()
add = REGISTRY.add
KEYS, ORDER = ["instrument", "exit_id", "dir"], ["tmin"]

#: The trade table of the greedy trades of all exits, with excursions, costs and the period of each instrument.
TABLE = GREEDY + f""", {CLEAN}, {COST}, e as (select tr.*, arg_min(b.o, b.tmin) as price, min(b.l) as lo, max(b.h) as hi from tr join b on b.instrument = tr.instrument and b.sday = tr.sday and b.tmin > tr.tmin and b.tmin <= tr.exit_tmin group by all),
per as (select instrument, (max(sday) - min(sday) + 1) / 365.25::double as years, count(*) as bars from b group by 1),
{{}}
t as (select e.*, point, years, bars, pnl * point as gross_usd, pnl * point - base / 100.0::double as net_usd, pnl * point - stress / 100.0::double as stress_usd, pnl * point - moderate / 100.0::double as moderate_usd, exit_tmin - tmin as hold_min,
  round(greatest(0, case when dir > 0 then price - lo else hi - price end), 6) as mae, round(greatest(0, case when dir > 0 then hi - price else price - lo end), 6) as mfe, year(date '1970-01-01' + sday) as year, year(date '1970-01-01' + sday) * 100 + month(date '1970-01-01' + sday) as month
  from e join kk using (instrument) join per using (instrument) where base is not null)"""
PRICES = "kk as (select instrument, point, " + ", ".join(CENTS.replace("cm", f"{c}::double").replace("sm_", f"{s}::double") + f" as {n}" for n, c, s in (("base", 1.0, 1.0), ("stress", 1.0, 2.0), ("moderate", 1.0, 0.5))) + " from k),"
TABLE = TABLE.format(PRICES)


def trade_rows(spark: SparkSession, folder: str) -> DataFrame:
    trades = taken(spark, folder).join(mae_mfe(spark, folder), ["instrument", "sday", "tmin", "exit_id", "dir"])
    named = trades.select("*", (F.col("tmin") + 1).alias("entry_tmin"), F.col("dir").alias("side"), F.col("pnl").alias("points"), F.lit(None).cast("double").alias("initial_risk"), F.lit("close").alias("reason"), F.lit(False).alias("ambiguous"))
    period = clean(spark, folder).groupBy("instrument").agg(((F.max("sday") - F.min("sday") + 1) / 365.25).alias("years"), F.count("*").alias("bars"))
    # the entry bar follows the signal bar by at least a minute; minutes held count from the signal's close
    made = execution.trade_table(named, costs(spark, folder)).join(period, "instrument").withColumn("hold_min", (F.col("exit_tmin") - F.col("tmin")).cast("double"))
    return made.where("net_usd is not null")


def shown(df: DataFrame, keys: list[str], whole: list[str], figures: list[str], places: int = 4) -> DataFrame:
    return df.select(*keys, *whole, *[(F.round(F.col(c) + 1e-7, places) + 0.0).alias(c) for c in figures])


FIGURES = {
    "win_rate": "avg((net_usd > 0)::int)", "profit_factor": "sum(greatest(net_usd, 0)) / nullif(sum(greatest(-net_usd, 0)), 0)", "gross_pnl": "sum(gross_usd)", "net_pnl": "sum(net_usd)", "avg_trade": "avg(net_usd)",
    "gross_profit": "sum(greatest(net_usd, 0))", "gross_loss": "sum(greatest(-net_usd, 0))", "profit_factor_gross": "sum(greatest(gross_usd, 0)) / nullif(sum(greatest(-gross_usd, 0)), 0)", "profit_factor_stress": "sum(greatest(stress_usd, 0)) / nullif(sum(greatest(-stress_usd, 0)), 0)",
    "stress_net_pnl": "sum(stress_usd)", "moderate_net_pnl": "sum(moderate_usd)", "total_cost_usd": "sum(gross_usd - net_usd)", "avg_winner": "avg(net_usd) filter (net_usd > 0)", "avg_loser": "avg(net_usd) filter (net_usd < 0)", "best_trade": "max(net_usd)", "worst_trade": "min(net_usd)",
    "expectancy_pts": "avg(net_usd / point)", "gross_expectancy_pts": "avg(pnl)", "max_dd_usd": "max(dd)", "max_dd_pts": "max(dd) / any_value(point)", "breakeven_cost_per_trade": "avg(gross_usd)", "avg_hold_min": "avg(hold_min)", "median_hold_min": "median(hold_min)", "exposure": "sum(hold_min) / any_value(bars)",
    "trades_per_year": "count(*) / any_value(years)", "annual_net_pnl": "sum(net_usd) / any_value(years)", "long_pnl": "coalesce(sum(net_usd) filter (dir = 1), 0)", "short_pnl": "coalesce(sum(net_usd) filter (dir = -1), 0)", "avg_mae_pts": "avg(mae)", "avg_mfe_pts": "avg(mfe)",
    "top1pct_trades_pnl": "sum(net_usd) filter (rk <= greatest(1, ceil(n_ * 0.01)))", "win_loss_ratio": "avg(net_usd) filter (net_usd > 0) / -(avg(net_usd) filter (net_usd < 0))",
    "observed_breakeven_winrate": "-(avg(net_usd) filter (net_usd < 0)) / ((avg(net_usd) filter (net_usd > 0)) - (avg(net_usd) filter (net_usd < 0)))",
}
COUNTS = {"trades": "count(*)", "wins": "count(*) filter (net_usd > 0)", "losses": "count(*) filter (net_usd < 0)", "long_trades": "count(*) filter (dir = 1)", "short_trades": "count(*) filter (dir = -1)", "longest_losing_streak": "cast(max(lost) as bigint)"}
PATH = """, q1 as (select *, sum(net_usd) over w as eq, count(*) filter (net_usd >= 0) over w as island from t window w as (partition by {k} order by tmin rows unbounded preceding)),
q2 as (select *, greatest(max(eq) over (partition by {k} order by tmin rows unbounded preceding), 0) - eq as dd, count(*) filter (net_usd < 0) over (partition by {k}, island order by tmin rows unbounded preceding) as lost, row_number() over (partition by {k} order by net_usd desc, tmin) as rk, count(*) over (partition by {k}) as n_ from q1)"""


def figures_sql(figures: dict[str, str], counts: dict[str, str], keys: str, source: str = "q2") -> str:
    return f"select {keys}, " + ", ".join(f"{e} as {n}" for n, e in counts.items()) + ", " + ", ".join(f"round({e} + 1e-7::double, 4) + 0.0 as {n}" for n, e in figures.items()) + f" from {source} group by {keys}"


SPANS = """, my as (select instrument, exit_id, dir, month, sum(net_usd) as s from t group by all), yy as (select instrument, exit_id, dir, year, sum(net_usd) as s from t group by all),
ms as (select instrument, exit_id, dir, count(*) filter (s > 0) as positive_months, count(*) filter (s < 0) as negative_months, round(max(s) + 1e-7::double, 4) + 0.0 as best_month_net from my group by 1, 2, 3),
ys as (select instrument, exit_id, dir, count(*) filter (s > 0) as positive_years, count(*) filter (s < 0) as negative_years, round(max(s) + 1e-7::double, 4) + 0.0 as best_year_net from yy group by 1, 2, 3)"""


@add("trade_summary", TABLE + PATH.format(k="instrument, exit_id, dir") + SPANS + f", f as ({figures_sql(FIGURES, COUNTS, 'instrument, exit_id, dir')}) select * from f join ms using (instrument, exit_id, dir) join ys using (instrument, exit_id, dir)")
def trade_summary(spark: SparkSession, folder: str) -> DataFrame:
    made = metrics.summary(trade_rows(spark, folder), KEYS, ORDER, F.col("years"), F.col("bars"))
    return shown(made, KEYS, [*COUNTS, "positive_months", "negative_months", "positive_years", "negative_years"], [*FIGURES, "best_month_net", "best_year_net"])


SHORT = {k: FIGURES[k] for k in ("win_rate", "profit_factor", "gross_pnl", "net_pnl", "avg_trade", "max_dd_usd")}
FEW = {k: COUNTS[k] for k in ("trades", "wins", "long_trades", "short_trades")}
BY_MONTH = TABLE + PATH.format(k="instrument, exit_id, dir, month")


@add("trade_months", BY_MONTH + " " + figures_sql(SHORT, FEW, "instrument, exit_id, dir, month"))
def trade_months(spark: SparkSession, folder: str) -> DataFrame:
    return shown(metrics.by_period(trade_rows(spark, folder), KEYS, ORDER, "month"), [*KEYS, "month"], list(FEW), list(SHORT))


@add("trade_years", TABLE + PATH.format(k="instrument, exit_id, dir, year") + f""", f as ({figures_sql(SHORT, FEW, 'instrument, exit_id, dir, year')}), ks as (select distinct instrument, exit_id, dir from f),
every as (select ks.*, unnest(range(2010, 2014)) as year from ks)
select instrument, exit_id, dir, cast(year as integer) as year, """ + ", ".join(f"coalesce({c}, 0) as {c}" for c in FEW) + ", win_rate, profit_factor, avg_trade, " + ", ".join(f"coalesce({c}, 0.0) as {c}" for c in ("gross_pnl", "net_pnl", "max_dd_usd")) + " from every left join f using (instrument, exit_id, dir, year)")
def trade_years(spark: SparkSession, folder: str) -> DataFrame:
    """The years 2010 to 2013 of each rule, those without trades as zeros."""
    made = metrics.yearly(trade_rows(spark, folder), KEYS, ORDER, 2010, 2013)
    kept = shown(made, [*KEYS, "year"], list(FEW), list(SHORT))
    return kept.withColumns({c: F.coalesce(F.when(F.col("trades") > 0, F.col(c)), F.lit(0.0)) for c in ("gross_pnl", "net_pnl", "max_dd_usd")})


@add("trade_12m", BY_MONTH + """, mo as (select instrument, exit_id, dir, (month // 100) * 12 + month % 100 - 1 as no, sum(net_usd) as net, count(*) as k from t group by all),
every as (select instrument, exit_id, dir, unnest(range(min(no), max(no) + 1)) as no from mo group by 1, 2, 3)
select instrument, exit_id, dir, cast((no // 12) * 100 + no % 12 + 1 as integer) as month, round(sum(coalesce(net, 0)) over w + 1e-7::double, 4) + 0.0 as net_12m, cast(sum(coalesce(k, 0)) over w as bigint) as trades_12m
from every left join mo using (instrument, exit_id, dir, no) window w as (partition by instrument, exit_id, dir order by no rows 11 preceding)""")
def trade_12m(spark: SparkSession, folder: str) -> DataFrame:
    made = metrics.rolling_12m(metrics.by_period(trade_rows(spark, folder), KEYS, ORDER, "month"), KEYS)
    return shown(made, [*KEYS, "month"], ["trades_12m"], ["net_12m"])


#: Every trigger of the catalogue under six direction variants with 14 exits, after baseline costs.
RULES = FEATURED + ", ev0 as materialized (" + " union all ".join(crossing(n, c, v) for n, (c, v) in LEVELS.items()) + f"""), out0 as materialized ({STOPS}), {COST}, {PRICES}
va(variant, way, side) as (values """ + ", ".join(f"('{n}', {way}, {only})" for n, way, only in simulate.VARIANTS) + """),
out_ as materialized (select row_number() over () as id, o.instrument, o.sday, trigger_id, variant, o.exit_id, o.tmin, o.exit_tmin, pnl - base / 100.0::double / point as net
  from ev0 join va on side = 0 or side = sign join out0 o on o.instrument = ev0.instrument and o.tmin = ev0.tmin and o.dir = way * sign join kk on kk.instrument = o.instrument where base is not null),
ev as (select instrument, sday, trigger_id, variant, exit_id, tmin as t, 1 as kind, id as start_id, null as id from out_ union all select instrument, sday, trigger_id, variant, exit_id, exit_tmin, 0, null, id from out_),
nx as materialized (select id, next from (select id, first_value(start_id ignore nulls) over (partition by instrument, sday, trigger_id, variant, exit_id order by t, kind rows between current row and unbounded following) as next from ev) where id is not null and next is not null),
first as materialized (select arg_min(id, tmin) as id from out_ group by instrument, sday, trigger_id, variant, exit_id),
go as materialized (with recursive r as (select id from first union all select next as id from r join nx using (id)) select * from r),
eq as (select *, sum(net) over (partition by instrument, trigger_id, variant, exit_id order by tmin rows unbounded preceding) as eq from go join out_ using (id)),
dd as (select *, greatest(max(eq) over (partition by instrument, trigger_id, variant, exit_id order by tmin rows unbounded preceding), 0) - eq as dd from eq)
select instrument, trigger_id, variant, exit_id, count(*) as n, count(*) filter (net > 0) as wins, """ + ", ".join(f"round({e} + 1e-7::double, 4) + 0.0 as {n}" for n, e in (("sum", "sum(net)"), ("sumsq", "sum(net * net)"), ("sumpos", "sum(greatest(net, 0))"), ("sumneg", "sum(least(net, 0))"), ("maxdd", "max(dd)"))) + " from dd group by all"


@add("rule_evaluation", RULES)
def rule_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    k = costs(spark, folder)
    cents = round_trip_cents(F.col("commission_round_trip"), F.col("slippage_ticks_per_side"), F.col("tick_size"), F.col("point_value"), F.col("extra"))
    points = k.select("instrument", (cents / 100 / F.col("point_value")).alias("cost")).where("cost is not null")
    events = simulate.rule_events(trigger_events(spark, folder), exit_outcomes(spark, folder)).join(points, "instrument")
    made = simulate.rule_stats(events, F.col("cost"))
    return shown(made, ["instrument", "trigger_id", "variant", "exit_id"], ["n", "wins"], ["sum", "sumsq", "sumpos", "sumneg", "maxdd"])


@add("backtest_trades")
def backtest_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Occupation signals in the regular window with a stop of one and a target of two 15-bar ranges, for an hour at most."""
    x = signals.e07(context(spark, folder), 30, 0.8)
    x = x.withColumns({"long": F.col("base_ok") & (F.col("state") > 0), "short": F.col("base_ok") & (F.col("state") < 0), "target": 2 * F.col("stop")})
    return execution.run_signals(execution.window_masks(x, 935, 1275, 1320), hold=60, exit_on_opposite=True, require_stop=True, require_target=True)
