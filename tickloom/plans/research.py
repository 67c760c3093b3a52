"""Candidate bookkeeping, similarity of reported pairs, splits, inference and surrogate worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import inference as inf
from tickloom.operators import nulls
from tickloom.operators.trailing import latest_delivery, trailing_totals
from tickloom.operators.windows import Rolling, correlation
from tickloom.plans import oracle as q
from tickloom.plans.market import clean
from tickloom.plans.oracle import CLEAN, G
from tickloom.plans.registry import Registry
from tickloom.sources.tables import table

REGISTRY = Registry()
add = REGISTRY.add
R = Rolling()

LATEST = """with days as (select candidate_id, session, r, n from (select candidate_id, session, coalesce(case when isnan(r) then null else r end, 0) as r, coalesce(n, 0) as n,
  row_number() over (partition by candidate_id, session order by recv_ts desc nulls last, coalesce(case when isnan(r) then null else r end, 0) desc, coalesce(n, 0) desc) as k from daily_streams where candidate_id is not null and session is not null) where k = 1)"""
CAND = "select *, row_number() over (partition by candidate_id order by recorded_ts nulls last, spec nulls last, signal_hash nulls last) as pick from candidates where candidate_id is not null"


def days(spark: SparkSession, folder: str) -> DataFrame:
    return latest_delivery(table(spark, folder, "daily_streams"), "candidate_id", "session", "recv_ts", "r", "n")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each candidate: the first recorded."""
    w = Window.partitionBy("candidate_id").orderBy(F.asc_nulls_last("recorded_ts"), F.asc_nulls_last("spec"), F.asc_nulls_last("signal_hash"))
    return table(spark, folder, "candidates").where("candidate_id is not null").withColumn("pick", F.row_number().over(w)).where("pick = 1")


@add("candidate_ids", "select distinct spec, 'T-' || substr(sha256(spec), 1, 24) as content_id from candidates where spec is not null")
def candidate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").where("spec is not null").select("spec", F.concat(F.lit("T-"), F.substring(F.sha2("spec", 256), 1, 24)).alias("content_id")).distinct()


AXES = (("filter", 10), ("variant", 6), ("exit", 14), ("side", 2))


@add("grammar_enum", "select i as row_no, cast(i // 168 as integer) as filter, cast(i // 28 % 6 as integer) as variant, cast(i // 2 % 14 as integer) as exit, cast(i % 2 as integer) as side from range(1680) t(i)")
def grammar_enum(spark: SparkSession, folder: str) -> DataFrame:
    """Row number <-> point of the product, the last axis fastest; any part can be made by itself."""
    total, columns = 1, {}
    for name, size in reversed(AXES):
        columns[name] = F.floor(F.col("id") / total) % size
        total *= size
    return spark.range(total).select(F.col("id").alias("row_no"), *[columns[n].cast("int").alias(n) for n, _ in AXES])


@add("grammar_neighbours", "with g as (select i, i // 168 as f, i // 28 % 6 as v, i // 2 % 14 as e, i % 2 as s from range(1680) t(i)) select a.i as row_no, b.i as neighbour from g a join g b on abs(a.f - b.f) + abs(a.v - b.v) + abs(a.e - b.e) + abs(a.s - b.s) = 1")
def grammar_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """One step along one axis, by offsets: no self-join of the product."""
    g, weight, steps = grammar_enum(spark, folder), 1, []
    for name, size in reversed(AXES):
        for d in (-1, 1):
            steps.append(F.when((F.col(name) + d >= 0) & (F.col(name) + d < size), F.col("row_no") + d * weight))
        weight *= size
    return g.select("row_no", F.explode(F.array_compact(F.array(*steps))).alias("neighbour"))


@add("exact_duplicates", f"with c as ({CAND}) select candidate_id, first_value(candidate_id) over (partition by signal_hash order by recorded_ts nulls last, candidate_id) as first_id from c where pick = 1 and signal_hash is not null")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Each candidate's first one with the same signals. The first is a minimum, joined back, so large groups combine early."""
    c = candidates(spark, folder).where("signal_hash is not null")
    late = F.struct(F.col("recorded_ts").isNull().alias("late"), "recorded_ts", "candidate_id")
    first = c.groupBy("signal_hash").agg(F.min(late).alias("f")).select("signal_hash", F.col("f.candidate_id").alias("first_id"))
    return c.select("candidate_id", "signal_hash").join(first, "signal_hash").select("candidate_id", "first_id")


@add("grouping_sets", f"with c as ({CAND}) select stage, family, side, cast(grouping(stage) + 2 * grouping(family) + 4 * grouping(side) as integer) as which, count(*) as n, count(*) filter (net_r > 0) as winners, cast(sum(coalesce(trades, 0)) as bigint) as trades from c where pick = 1 group by grouping sets ((stage), (family), (side), (stage, side))")
def grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql("select stage, family, side, cast(grouping(stage) + 2 * grouping(family) + 4 * grouping(side) as int) as which, count(*) as n, count_if(net_r > 0 and not isnan(net_r)) as winners, sum(coalesce(trades, 0)) as trades from {first} group by grouping sets ((stage), (family), (side), (stage, side))", first=candidates(spark, folder))


@add("screen", f"with c as ({CAND}) select candidate_id, coalesce(trades >= 20, false) as enough_trades, coalesce(active_years >= 1, false) as enough_years, coalesce(net_r > 0 and not isnan(net_r), false) as net_positive, coalesce(stress_net_r > 0 and not isnan(stress_net_r), false) as stress_positive, coalesce(profit_factor > 1.05 and not isnan(profit_factor), false) as factor_ok, coalesce(trades >= 20, false) and coalesce(active_years >= 1, false) and coalesce(net_r > 0 and not isnan(net_r), false) and coalesce(stress_net_r > 0 and not isnan(stress_net_r), false) and coalesce(profit_factor > 1.05 and not isnan(profit_factor), false) as qualified from c where pick = 1")
def screen(spark: SparkSession, folder: str) -> DataFrame:
    """Declarative rules (column, least, strict); every verdict is kept."""
    rules = {"enough_trades": F.col("trades") >= 20, "enough_years": F.col("active_years") >= 1, "net_positive": (F.col("net_r") > 0) & ~F.isnan("net_r"), "stress_positive": (F.col("stress_net_r") > 0) & ~F.isnan("stress_net_r"), "factor_ok": (F.col("profit_factor") > 1.05) & ~F.isnan("profit_factor")}
    verdicts = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    every = F.lit(True)
    for v in verdicts.values():
        every = every & v
    return candidates(spark, folder).select("candidate_id", *[v.alias(k) for k, v in verdicts.items()], every.alias("qualified"))


@add("top_by_family", f"with c as ({CAND}), r as (select candidate_id, family, statistic, row_number() over (partition by family order by statistic desc, candidate_id) as rank from c where pick = 1 and statistic is not null and not isnan(statistic)) select * from r where rank <= 5")
def top_by_family(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("family").orderBy(F.desc("statistic"), "candidate_id")
    return candidates(spark, folder).where("statistic is not null and not isnan(statistic)").select("candidate_id", "family", "statistic", F.row_number().over(w).alias("rank")).where("rank <= 5")


@add("search_page", f"with c as ({CAND}) select candidate_id, family, statistic from c where pick = 1 and side = 'long' and family like 'E%' and statistic is not null and not isnan(statistic) order by statistic desc, candidate_id limit 25 offset 10")
def search_page(spark: SparkSession, folder: str) -> DataFrame:
    """Filter, sort and page of the read interface; the page is the feature."""
    c = candidates(spark, folder).where("side = 'long' and family like 'E%' and statistic is not null and not isnan(statistic)")
    return c.select("candidate_id", "family", "statistic").orderBy(F.desc("statistic"), "candidate_id").offset(10).limit(25)


@add("masked_results", f"with c as ({CAND}) select candidate_id, case when stage = 'A' then net_r end as net_r, case when stage = 'A' then trades end as trades, stage is distinct from 'A' as sealed from c where pick = 1")
def masked_results(spark: SparkSession, folder: str) -> DataFrame:
    open_ = F.col("stage") == "A"
    return candidates(spark, folder).select("candidate_id", F.when(open_, F.col("net_r")).alias("net_r"), F.when(open_, F.col("trades")).alias("trades"), (~F.coalesce(open_, F.lit(False))).alias("sealed"))


PAIRS = "p as (select distinct trim(left_id) as a, trim(right_id) as b from pair_similarities where trim(left_id) < trim(right_id))"


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pair_similarities").select(F.trim("left_id").alias("a"), F.trim("right_id").alias("b")).where("a < b").distinct()


@add("pair_correlation", f"""{LATEST}, {PAIRS}, j as (select a, b, x.r as xr, y.r as yr from p join days x on x.candidate_id = p.a join days y on y.candidate_id = p.b and y.session = x.session)
select a, b, count(*) as common_days, round(case when count(*) >= 5 and var_pop(xr) > 1e-12 and var_pop(yr) > 1e-12 then corr(xr, yr) end, 6) + 0.0 as correlation from j group by 1, 2""")
def pair_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Daily correlation of reported pairs over their common days: equi-joins only."""
    d = days(spark, folder)
    x, y = d.select(F.col("entity").alias("a"), "day", F.col("r").alias("xr")), d.select(F.col("entity").alias("b"), "day", F.col("r").alias("yr"))
    j = pairs(spark, folder).join(x, "a").join(y, ["b", "day"])
    ok = (F.count("*") >= 5) & (F.var_pop("xr") > 1e-12) & (F.var_pop("yr") > 1e-12)
    return j.groupBy("a", "b").agg(F.count("*").alias("common_days"), (F.round(F.when(ok, correlation(F.col("xr"), F.col("yr"))), 6) + 0.0).alias("correlation"))


@add("position_overlap", f"""with c as ({CAND}), {PAIRS}, t as (select distinct candidate_id, e, x from (select candidate_id, unnest(entry_indices) as e, unnest(exit_indices) as x from c where pick = 1) where e is not null and x >= e)
select a, b, cast(sum(least(s.x, t2.x) - greatest(s.e, t2.e) + 1) as bigint) as common_bars from p join t s on s.candidate_id = a join t t2 on t2.candidate_id = b and t2.e <= s.x and t2.x >= s.e group by 1, 2""")
def position_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Bars that both candidates of a reported pair hold: intervals meet inside the pair only."""
    t = candidates(spark, folder).select("candidate_id", F.explode(F.arrays_zip(F.col("entry_indices").alias("e"), F.col("exit_indices").alias("x"))).alias("i")).select("candidate_id", "i.e", "i.x").where("e is not null and x >= e").distinct()
    one, two = t.toDF("a", "e1", "x1"), t.toDF("b", "e2", "x2")
    j = pairs(spark, folder).join(one, "a").join(two, "b").where("e2 <= x1 and x2 >= e1")
    return j.groupBy("a", "b").agg(F.sum(F.least("x1", "x2") - F.greatest("e1", "e2") + 1).cast("bigint").alias("common_bars"))


TESTS = "tests(name, a, b) as (values ('t1', 15350, 15360), ('t2', 15380, 15390), ('t3', 15420, 15430))"


def tests(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([("t1", 15350, 15360), ("t2", 15380, 15390), ("t3", 15420, 15430)], "name string, a int, b int"))


@add("purge_embargo", f"{LATEST}, {TESTS}, l as (select candidate_id, session, session as s, session + 5 as e from days) select candidate_id, session from l where not exists (select 1 from tests where s <= b and e >= a) and not exists (select 1 from tests where s > b and s <= b + 3)")
def purge_embargo(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of five days that touch no test interval and don't start in the three days after one (the fixed test table is broadcast)."""
    lab = days(spark, folder).select(F.col("entity").alias("candidate_id"), F.col("day").alias("session"), F.col("day").alias("s"), (F.col("day") + 5).alias("e"))
    t = tests(spark)
    kept = lab.join(t, (lab.s <= t.b) & (lab.e >= t.a), "left_anti")
    return kept.join(t, (kept.s > t.b) & (kept.s <= t.b + 3), "left_anti").select("candidate_id", "session")


@add("purge_leaks", f"{LATEST}, {TESTS} select candidate_id, session, min(name) as test from days join tests on session <= b and session + 5 >= a group by 1, 2")
def purge_leaks(spark: SparkSession, folder: str) -> DataFrame:
    lab = days(spark, folder)
    return lab.join(tests(spark), F.expr("day <= b and day + 5 >= a")).groupBy(F.col("entity").alias("candidate_id"), F.col("day").alias("session")).agg(F.min("name").alias("test"))


@add("walk_forward_splits", "select k as fold, a + k * 20 as train_first, a + k * 20 + 39 as train_last, a + k * 20 + 41 as test_first, least(a + k * 20 + 60, b) as test_last from (select min(session) as a, max(session) as b, unnest(range(0, (max(session) - min(session) - 41) // 20 + 1)) as k from daily_streams) where a + k * 20 + 41 <= b")
def walk_forward_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling folds: 40 days of training, one purged, 20 of test."""
    span = table(spark, folder, "daily_streams").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    folds = span.select("a", "b", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("b") - F.col("a") - 41) / 20).cast("int")))).alias("k")).where("a + k * 20 + 41 <= b")
    at = lambda d: (F.col("a") + F.col("k") * 20 + d)
    return folds.select(F.col("k").alias("fold"), at(0).alias("train_first"), at(39).alias("train_last"), at(41).alias("test_first"), F.least(at(60), F.col("b")).alias("test_last"))


L = 5


def hac_sql(days: str, lags: int) -> str:
    gs = ", ".join(f"avg(z * lag{k}) as g{k}" for k in range(1, lags + 1))
    return f"""{days}, z as (select *, r - avg(r) over (partition by candidate_id) as z from days), l as (select *, {", ".join(f"lag(z, {k}) over (partition by candidate_id order by session) as lag{k}" for k in range(1, lags + 1))} from z),
a as (select candidate_id, count(*) as n, avg(r) as mean, avg(z * z) as g0, {gs} from l group by 1),
hac as (select candidate_id, n, mean, mean / sqrt(greatest(g0 + {" + ".join(f"2 * {1 - k / (lags + 1)}::double * coalesce(g{k}, 0)" for k in range(1, lags + 1))}, 1e-12) / n) as t from a)"""


HAC = hac_sql(LATEST, L)


@add("hac_t", HAC + " select candidate_id, n, round(mean, 6) + 0.0 as mean, round(t, 4) + 0.0 as t from hac where n >= 10")
def hac_t(spark: SparkSession, folder: str) -> DataFrame:
    return t_of(inf.hac_t(days(spark, folder), L))


def t_of(hac: DataFrame) -> DataFrame:
    return hac.where("n >= 10").select(F.col("entity").alias("candidate_id"), "n", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("t", 4) + 0.0).alias("t"))


def p_values(t: DataFrame) -> DataFrame:
    """A bounded monotone p for each candidate from its HAC t, equal in both engines: 1 / (1 + exp(1.702 t))."""
    return t.select(F.col("candidate_id").alias("id"), F.round(1 / (1 + F.exp(1.702 * F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("t"))))), 10).alias("p"))


RANKED = ", pv as (select candidate_id as id, round(1 / (1 + exp(1.702 * greatest(-30, least(30, round(t, 4))))), 10) as p, row_number() over (order by round(1 / (1 + exp(1.702 * greatest(-30, least(30, round(t, 4))))), 10), candidate_id) as rank, count(*) over () as m from hac where n >= 10)"
PV = HAC + RANKED
HOLM = " select id, rank, round(least(1, max((m - rank + 1) * p) over (order by rank)), 8) as adjusted from pv"
BH_BY = ", h as (select sum(1.0::double / k) as c from range(1, (select max(m) + 1 from pv)) t(k)) select id, rank, round(least(1, min(m * p / rank) over (order by rank desc)), 8) as bh, round(least(1, min(m * p / rank * c) over (order by rank desc)), 8) as by_adjusted from pv, h"


@add("holm", PV + HOLM)
def holm(spark: SparkSession, folder: str) -> DataFrame:
    return holm_of(hac_t(spark, folder))


def holm_of(t: DataFrame) -> DataFrame:
    return inf.holm(p_values(t)).select("id", "rank", F.round("adjusted", 8).alias("adjusted"))


@add("bh_by", PV + BH_BY)
def bh_by(spark: SparkSession, folder: str) -> DataFrame:
    return bh_by_of(hac_t(spark, folder))


def bh_by_of(t: DataFrame) -> DataFrame:
    return inf.benjamini_both(p_values(t)).select("id", "rank", F.round("bh", 8).alias("bh"), F.round("by", 8).alias("by_adjusted"))


# The same over every calendar day of a stream, days without rows as 0, and with the operator's 20 lags.
DENSE = LATEST.replace("with days as", "with given as") + """, span as (select candidate_id, unnest(range(min(session), max(session) + 1)) as session from given group by 1),
days as (select candidate_id, session, coalesce(r, 0) as r from span left join given using (candidate_id, session))"""
HAC_DENSE = hac_sql(DENSE, 20)


def dense_days(spark: SparkSession, folder: str) -> DataFrame:
    return trailing_totals(days(spark, folder), (1,)).select("entity", "day", "r")


@add("hac_t_calendar", HAC_DENSE + " select candidate_id, n, round(mean, 6) + 0.0 as mean, round(t, 4) + 0.0 as t from hac where n >= 10")
def hac_t_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return t_of(inf.hac_t(dense_days(spark, folder)))


@add("holm_calendar", HAC_DENSE + RANKED + HOLM)
def holm_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return holm_of(hac_t_calendar(spark, folder))


@add("bh_by_calendar", HAC_DENSE + RANKED + BH_BY)
def bh_by_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return bh_by_of(hac_t_calendar(spark, folder))


BOOT = f"""{LATEST}, cal as (select session, row_number() over (order by session) - 1 as pos, count(*) over () as n from (select distinct session from days)),
fam as (select session, substr(candidate_id, 4, 1) as family, avg(r) as r from days group by 1, 2),
boot as (select rep, pos, ((rep * 7919 + (pos // 10) * 104729 + rep * (pos // 10) * 1299709 + 1) + pos % 10) % n as src from cal, range(50) t(rep)),
means as (select rep, family, sum(r) as s from boot join cal c on c.pos = boot.src join fam f on f.session = c.session group by 1, 2),
real_ as (select family, sum(r) as s from fam group by 1)"""


@add("bootstrap_max", BOOT + " select family, round(real_.s, 6) as total, cast(1 + count(*) filter (d >= real_.s) as integer) as above, 51 as worlds from real_, (select m.rep, max(m.s - r2.s) as d from means m join real_ r2 using (family) group by 1) mx group by family, real_.s")
def bootstrap_max(spark: SparkSession, folder: str) -> DataFrame:
    """Block bootstrap of the families' daily means: how many of 50 worlds have a centred maximum above each total.

    (rep, pos, src) is a table of the calendar's size times the worlds, joined by position."""
    d = days(spark, folder)
    fam = d.groupBy(F.col("day"), F.substring("entity", 4, 1).alias("family")).agg(F.avg("r").alias("r"))
    cal = d.select("day").distinct().withColumn("pos", F.row_number().over(Window.orderBy("day")) - 1)  # one row for each calendar day
    n = cal.count()
    boot = cal.select("pos").join(F.broadcast(spark.range(50).withColumnRenamed("id", "rep"))).select("rep", F.expr(inf.block_positions(50, max(n, 1), 10)).cast("int").alias("src"))
    worlds = boot.join(cal.withColumnRenamed("pos", "src"), "src").join(fam, "day").groupBy("rep", "family").agg(F.sum("r").alias("s"))
    real = fam.groupBy("family").agg(F.sum("r").alias("total"))
    largest = worlds.join(real, "family").groupBy("rep").agg(F.max(F.col("s") - F.col("total")).alias("d"))
    # families times 50 worlds: small whatever the streams' size
    return real.join(F.broadcast(largest)).groupBy("family", "total").agg((F.lit(1) + F.count_if(F.col("d") >= F.col("total"))).cast("int").alias("above")).select("family", F.round("total", 6).alias("total"), "above", F.lit(51).alias("worlds"))


@add("monthly_table", f"{LATEST} select strftime(date '1970-01-01' + session, '%Y%m') as yyyymm, count(*) filter (n > 0) as active_days, round(sum(r), 4) + 0.0 as r, cast(sum(n) as bigint) as trades from days group by 1")
def monthly_table(spark: SparkSession, folder: str) -> DataFrame:
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))
    return days(spark, folder).groupBy(F.date_format(date, "yyyyMM").alias("yyyymm")).agg(F.count_if(F.col("n") > 0).alias("active_days"), (F.round(F.sum("r"), 4) + 0.0).alias("r"), F.sum("n").alias("trades"))


@add("rolling_months", f"""{LATEST}, m as (select candidate_id, (year(date '1970-01-01' + session) * 12 + month(date '1970-01-01' + session)) as ym, sum(r) as r from days group by 1, 2), s as (select candidate_id, unnest(range(min(ym), max(ym) + 1)) as ym from m group by 1)
select candidate_id, cast(ym as integer) as ym, round(sum(coalesce(r, 0)) over (partition by candidate_id order by ym rows 2 preceding), 4) + 0.0 as r_3m from s left join m using (candidate_id, ym)""")
def rolling_months(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling three-month sums on a continuous month index."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))
    m = days(spark, folder).groupBy("entity", (F.year(date) * 12 + F.month(date)).alias("ym")).agg(F.sum("r").alias("r"))
    o = Window.partitionBy("entity").orderBy("ym")
    filled = m.withColumn("until", F.coalesce(F.lead("ym").over(o), F.col("ym") + 1)).select("entity", "r", F.posexplode(F.sequence("ym", F.col("until") - 1)).alias("gap", "ym"))
    return filled.select(F.col("entity").alias("candidate_id"), "ym", (F.round(F.sum(F.when(F.col("gap") == 0, F.col("r")).otherwise(0.0)).over(o.rowsBetween(-2, 0)), 4) + 0.0).alias("r_3m"))


@add("by_clock_quantiles", f"with {CLEAN}, r as (select *, {q.ln(f'c / {q.lag('c')}')} as r1 from b) select instrument, sm, count(r1) as n, round(quantile_cont(abs(r1), 0.5), 9) as median, round(quantile_cont(abs(r1), 0.9), 9) as p90, round(avg((r1 = 0)::int::double), 6) as zero_share from r where r1 is not null group by 1, 2")
def by_clock_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    r = clean(spark, folder).withColumn("r1", F.ln(F.col("c") / R.lag(F.col("c")))).where("r1 is not null")
    return r.groupBy("instrument", "sm").agg(F.count("r1").alias("n"), F.round(F.percentile(F.abs("r1"), 0.5), 9).alias("median"), F.round(F.percentile(F.abs("r1"), 0.9), 9).alias("p90"), F.round(F.avg((F.col("r1") == 0).cast("double")), 6).alias("zero_share"))


@add("lag_autocorr", f"with {CLEAN}, r as (select *, {q.ln(f'c / {q.lag('c')}')} as r1 from b), l as (select *, {q.lag('r1')} as l1, {q.lag('r1', 5)} as l5 from r) select instrument, round(corr(r1, l1), 5) + 0.0 as lag1, round(corr(abs(r1), abs(l5)), 5) + 0.0 as abs_lag5, count(*) as n from l group by 1")
def lag_autocorr(spark: SparkSession, folder: str) -> DataFrame:
    r = clean(spark, folder).withColumn("r1", F.ln(F.col("c") / R.lag(F.col("c"))))
    lags = r.withColumns({"l1": R.lag(F.col("r1")), "l5": R.lag(F.col("r1"), 5)})
    return lags.groupBy("instrument").agg((F.round(correlation(F.col("r1"), F.col("l1")), 5) + 0.0).alias("lag1"), (F.round(correlation(F.abs("r1"), F.abs("l5")), 5) + 0.0).alias("abs_lag5"), F.count("*").alias("n"))


def sign(expr: str) -> str:
    """+1 or -1 by arithmetic that both engines share."""
    return f"(1 - 2 * (((({expr}) * 48271 + 11) % 2147483647 * 16807 % 2147483647) % 2))"


def flipped(key: str) -> str:
    return f"""with {CLEAN}, f as (select *, lag(c) over w as pc, lag(seg) over w as pseg, {sign(key)} as s from b window w as (partition by instrument order by tmin)),
g as (select *, case when pc is null or seg is distinct from pseg then o else pc end as ref, case when pc is not null and seg is distinct from pseg then o - pc else 0 end as gap from f),
p as (select *, sum(case when pc is null then o else 0 end + gap + s * (c - ref)) over (partition by instrument order by tmin rows unbounded preceding) as path from g), r as (select *, path - s * (c - ref) as at_ from p)
select instrument, tmin, round(at_ + s * (o - ref), 4) + 0.0 as o, round(at_ + case when s > 0 then h - ref else ref - l end, 4) + 0.0 as h, round(at_ + case when s > 0 then l - ref else ref - h end, 4) + 0.0 as l, round(path, 4) + 0.0 as c from r"""


def world_prices(w: DataFrame) -> DataFrame:
    return w.select("instrument", "tmin", *[(F.round(c, 4) + 0.0).alias(c) for c in "ohlc"])


@add("null_sign_flip", flipped("tmin // 30"))
def null_sign_flip(spark: SparkSession, folder: str) -> DataFrame:
    """A surrogate world: each half hour's steps keep or turn their sign."""
    return world_prices(nulls.block_sign_flip(clean(spark, folder), 30))


@add("null_minute_flip", flipped("tmin"))
def null_minute_flip(spark: SparkSession, folder: str) -> DataFrame:
    return world_prices(nulls.minute_sign_flip(clean(spark, folder)))


@add("null_reflection", f"with {CLEAN}, f as (select *, first_value(o) over ({G}) as o0 from b) select instrument, tmin, round(2 * o0 - o, 6) as o, round(2 * o0 - l, 6) as h, round(2 * o0 - h, 6) as l, round(2 * o0 - c, 6) as c from f")
def null_reflection(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.operators.nulls import session_reflection

    w = session_reflection(clean(spark, folder))
    return w.select("instrument", "tmin", *[F.round(c, 6).alias(c) for c in "ohlc"])


@add("null_donor", f"""with {CLEAN}, s as (select distinct instrument, sday, seg from b), n as (select *, row_number() over (partition by instrument order by sday, seg) - 1 as k, count(*) over (partition by instrument) as m from s),
d as (select a.instrument, a.sday, a.seg, z.sday as dday, z.seg as dseg from n a join n z on z.instrument = a.instrument and z.k = (a.k * 5 + 3) % a.m)
select b.instrument, b.tmin, x.c is not null as donated, coalesce(x.v, b.v) as v from b join d using (instrument, sday, seg) left join b x on x.instrument = b.instrument and x.sday = dday and x.seg = dseg and x.sm = b.sm""")
def null_donor(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.operators.nulls import donor_resample

    return donor_resample(clean(spark, folder)).select("instrument", "tmin", "donated", "v")


@add("null_permutation", f"""with {CLEAN}, s as (select instrument, sday, seg, md5(string_agg(cast(sm as varchar), ',' order by sm)) as sig from b group by 1, 2, 3),
n as (select *, row_number() over (partition by instrument, sig order by sday, seg) - 1 as k, count(*) over (partition by instrument, sig) as m from s)
select a.instrument, a.sday, a.seg, z.sday as source_sday, z.seg as source_seg from n a join n z on z.instrument = a.instrument and z.sig = a.sig and z.k = (a.k + 1) % a.m""")
def null_permutation(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.operators.nulls import session_permutation

    return session_permutation(clean(spark, folder))


@add("family_inference")
def family_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Max-t over all candidates' streams by the stationary bootstrap with 500 worlds, and its step-down."""
    out = inf.family_inference(days(spark, folder).select("entity", "day", "r"))
    return out.select(F.col("entity").alias("candidate_id"), "t", "p", "global_p")


@add("winner_bounds")
def winner_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Exact bounds of each family's share of candidates with a net gain."""
    k = candidates(spark, folder).groupBy("family").agg(F.count_if((F.col("net_r") > 0) & ~F.isnan("net_r")).alias("winners"), F.count("*").alias("n"))

    def bounds(frames):  # noqa: ANN001, ANN202
        for f in frames:
            low_high = [inf.clopper_pearson(int(a), int(b)) for a, b in zip(f["winners"], f["n"], strict=True)]
            yield f.assign(low=[x for x, _ in low_high], high=[x for _, x in low_high])

    return k.mapInPandas(bounds, "family string, winners bigint, n bigint, low double, high double")
