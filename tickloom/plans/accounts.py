"""Sizing, costs and account queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import accounts as a
from tickloom.operators.trailing import trailing_totals
from tickloom.operators.windows import Rolling
from tickloom.plans import oracle as q
from tickloom.plans.market import clean
from tickloom.plans.oracle import CLEAN
from tickloom.plans.registry import Registry
from tickloom.plans.research import LATEST, days
from tickloom.sources.tables import table

REGISTRY = Registry()
add = REGISTRY.add
R = Rolling()


def costs(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "costs")
    return c.withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("commission_round_trip", "slippage_ticks_per_side", "extra")})


COST = "k as (select instrument, tick_size as tick, point_value as point, case when not isnan(commission_round_trip) then commission_round_trip end as com, slippage_ticks_per_side as slip, coalesce(case when not isnan(extra) then extra end, 0) as extra from costs)"
CENTS = "cast(round(round(com * cm + 2 * slip * tick * point * sm_ + extra * cm, 6) * 100, 0) as bigint)"


@add("cost_scenarios", f"with {COST}, s(scenario, cm, sm_) as (values ('gross', 0.0::double, 0.0::double), ('moderate', 1.0, 0.5), ('baseline', 1.0, 1.0), ('stress', 1.0, 2.0)) select instrument, scenario, {CENTS} as cents from k, s where com is not null")
def cost_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Round-trip costs of every instrument under the four scenarios (a fixed table of four rows)."""
    s = spark.createDataFrame(list(a.SCENARIOS), "scenario string, cm double, sm_ double")
    k = costs(spark, folder).where("commission_round_trip is not null").join(F.broadcast(s))
    cents = a.round_trip_cents(F.col("commission_round_trip"), F.col("slippage_ticks_per_side"), F.col("tick_size"), F.col("point_value"), F.col("extra"), F.col("cm"), F.col("sm_"))
    return k.select("instrument", "scenario", cents.alias("cents"))


@add("fixed_dollar", f"""with {CLEAN}, {COST}, t as (select instrument, tmin, greatest(h, coalesce({q.lag('c')}, h)) - least(l, coalesce({q.lag('c')}, l)) as tr from b),
s as (select instrument, tmin, tr, tick, point, (cast(round(tr * 1000000) as bigint) + cast(round(tick * 1000000) as bigint) - 1) // cast(round(tick * 1000000) as bigint) as ticks, 1.0::double as cm, 1.0::double as sm_, com, slip, extra from t join k using (instrument)),
z as (select *, cast(round(round(ticks * tick * point, 6) * 100, 0) as bigint) + {CENTS} as each_ from s)
select instrument, tmin, ticks, least(50, cast(floor(50000 / nullif(each_, 0)) as bigint)) as contracts from z where each_ is not null""")
def fixed_dollar(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts for a 500 dollar budget if each bar's true range were the stop."""
    prev = R.lag(F.col("c"))
    t = clean(spark, folder).withColumn("tr", F.greatest("h", F.coalesce(prev, F.col("h"))) - F.least("l", F.coalesce(prev, F.col("l"))))
    j = t.join(costs(spark, folder), "instrument").withColumn("ticks", a.stop_ticks(F.col("tr"), F.col("tick_size")))
    cost = a.round_trip_cents(F.col("commission_round_trip"), F.col("slippage_ticks_per_side"), F.col("tick_size"), F.col("point_value"), F.col("extra"))
    sized = j.withColumn("contracts", a.fixed_dollar(50_000, F.col("ticks"), F.col("tick_size"), F.col("point_value"), cost))
    return sized.where("contracts is not null").select("instrument", "tmin", F.col("ticks").cast("bigint").alias("ticks"), F.col("contracts").cast("bigint").alias("contracts"))


@add("daily_policy", f"""{LATEST}, f as (select session, candidate_id, r, substr(candidate_id, 4, 2) as book from days where n > 0),
c as (select *, sum(r) over (partition by book, session order by candidate_id) as run from f), h as (select *, coalesce(max((run <= -2 + 1e-9 or run >= 3 - 1e-9)::int) over (partition by book, session order by candidate_id rows between unbounded preceding and 1 preceding), 0) as over_ from c)
select candidate_id, session, round(run, 6) + 0.0 as run, over_ = 0 as taken from h""")
def daily_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Books of candidates stop for the day at -2 R or +3 R."""
    f = days(spark, folder).where("n > 0").withColumn("book", F.substring("entity", 4, 2))
    out = a.daily_policy(f, ["book", "day"], "entity")
    return out.select(F.col("entity").alias("candidate_id"), F.col("day").alias("session"), (F.round("run", 6) + 0.0).alias("run"), "taken")


def starts(spark: SparkSession, folder: str) -> DataFrame:
    dense = trailing_totals(days(spark, folder), (1,)).select("entity", "day", "r")
    return a.rolling_accounts(dense)


@add("account_starts")
def account_starts(spark: SparkSession, folder: str) -> DataFrame:
    return starts(spark, folder)


@add("account_summary")
def account_summary(spark: SparkSession, folder: str) -> DataFrame:
    share = lambda o: F.avg((F.col("outcome") == o).cast("double"))
    return starts(spark, folder).groupBy("entity").agg(F.count("*").alias("starts"), share("pass").alias("pass_rate"), share("fail").alias("fail_rate"), share("open").alias("open_rate"), F.percentile("days", 0.5).alias("median_days"), F.percentile("balance", 0.9).alias("p90_balance"))
