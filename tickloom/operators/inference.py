"""Dependence-aware statistics of daily streams and families of p-values."""

from __future__ import annotations

import math
from functools import lru_cache, partial
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sequential import by_group
from tickloom.session import cut_lineage

NORMAL = NormalDist()


def hac_t(days: DataFrame, lags: int = 20, key: str = "entity", order: str = "day", x: str = "r") -> DataFrame:
    """t of each key's mean with Bartlett weights over ``lags`` autocovariances, each the mean of its n - k terms."""
    w = Window.partitionBy(key)
    z = days.withColumn("z", F.col(x) - F.avg(x).over(w))
    o = Window.partitionBy(key).orderBy(order)
    terms = z.withColumns({f"p{k}": F.col("z") * (F.lag("z", k).over(o) if k else F.col("z")) for k in range(lags + 1)})
    a = terms.groupBy(key).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), *[F.avg(f"p{k}").alias(f"g{k}") for k in range(lags + 1)])
    long_run = F.col("g0")
    for k in range(1, lags + 1):
        long_run = long_run + 2.0 * (1 - k / (lags + 1)) * F.coalesce(f"g{k}", F.lit(0.0))
    se = F.sqrt(F.greatest(long_run, F.lit(1e-12)) / F.col("n"))
    return a.select(key, "n", "mean", se.alias("se"), (F.col("mean") / se).alias("t"))


def holm(p: DataFrame, value: str = "p", key: str = "id") -> DataFrame:
    """Holm-adjusted values: running maximum of (m - rank) p in the order of p, ties by the key, at most 1.

    The order is global, so p-values are ranked within ranges first: only counts of ranges meet in one task.
    """
    ranked = ordered(p, value, key)
    return _running(ranked, (F.col("m") - F.col("rank") + 1) * F.col(value), "rank", F.max).withColumn("adjusted", F.least("running", F.lit(1.0))).drop("running", "range")


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed up to a thousand terms, by its expansion (exact to a double's last digits) beyond."""
    x = m.cast("double")
    summed = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.least(m, F.lit(1000)).cast("bigint")), F.lit(0.0), lambda s, k: s + 1.0 / k)
    return F.when(m <= 1000, summed).otherwise(F.ln(x) + float(np.euler_gamma) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def benjamini_both(p: DataFrame, value: str = "p", key: str = "id") -> DataFrame:
    """``bh`` and ``by``: running minimum from the largest p of m p / rank, for BY times the harmonic sum, at most 1."""
    ranked = ordered(p, value, key)
    made = _running(ranked, F.col("m") * F.col(value) / F.col("rank"), "rank", F.min, reverse=True)
    return made.withColumns({"bh": F.least("running", F.lit(1.0)), "by": F.least(F.col("running") * harmonic(F.col("m")), F.lit(1.0))}).drop("running", "range")


def benjamini(p: DataFrame, value: str = "p", key: str = "id", dependent: bool = False) -> DataFrame:
    """BH (or BY) adjusted values."""
    return benjamini_both(p, value, key).withColumn("adjusted", F.col("by" if dependent else "bh")).drop("bh", "by")


def ordered(p: DataFrame, value: str, key: str, ranges: int = 512) -> DataFrame:
    """Global rank from 1 and total m, without a single-task sort: ranks in value ranges plus the counts before."""
    cut = p.where(F.col(value).isNotNull()).withColumn("range", F.floor(F.col(value) * ranges))
    counts = cut.groupBy("range").agg(F.count("*").alias("k"))
    every = Window.partitionBy()
    before = counts.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("m", F.sum("k").over(every)).drop("k")
    inside = Window.partitionBy("range").orderBy(value, key)
    return cut.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.row_number().over(inside)).drop("before")  # at most ``ranges`` + 1 rows


def _running(ranked: DataFrame, expr: Column, order: str, fn, reverse: bool = False) -> DataFrame:  # noqa: ANN001
    """Running max or min over ranges: inside a range by a window, carried over by the ranges' own extremes."""
    x = ranked.withColumn("_x", expr)
    best = x.groupBy("range").agg(fn("_x").alias("best"))
    direction = F.desc("range") if reverse else F.asc("range")
    carried = best.withColumn("carried", fn("best").over(Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1))).select("range", "carried")
    w = Window.partitionBy("range").orderBy(F.desc(order) if reverse else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.least if reverse else F.greatest
    return x.join(F.broadcast(carried), "range").withColumn("running", pick(fn("_x").over(w), F.col("carried"))).drop("_x", "carried")


def normal_p(t: float | None) -> float | None:
    """One-sided p of a t by the normal distribution."""
    return None if t is None or t != t else 0.5 * math.erfc(t / math.sqrt(2))


def block_positions(reps: int, n: int, block: int, seed: int = 1) -> str:
    """SQL for (rep, pos, src): a circular block bootstrap whose blocks start at arithmetic positions.

    Both engines compute it alike: no random state, the table is data.
    """
    mixed = f"(rep * 7919 + (pos div {block}) * 104729 + rep * (pos div {block}) * 1299709 + {seed})"
    return f"pmod({mixed} + pos % {block}, {n})"


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by the continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, f = 1.0, 1.0 / max(1e-300, 1 - (a + b) * x / (a + 1)), 0.0
    f = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact bounds of a share of k in n."""

    def solve(a: float, b: float, p: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if incomplete_beta(a, b, middle) < p else (low, middle)
        return (low + high) / 2

    tail = (1 - level) / 2
    return (0.0 if k == 0 else solve(k, n - k + 1, tail)), (1.0 if k == n else solve(k + 1, n - k, 1 - tail))


@lru_cache(maxsize=2)
def stationary_blocks(n: int, block: int, reps: int, seed: int) -> np.ndarray:
    """Rows of day positions: blocks of geometric length with the mean ``block`` from random starts, around the end."""
    rng = np.random.default_rng(seed)
    starts = rng.random((reps, n)) < 1.0 / block
    starts[:, 0] = True
    places = np.arange(n)
    since = np.maximum.accumulate(np.where(starts, places, 0), axis=1)
    fresh = rng.integers(n, size=(reps, n))
    return ((np.take_along_axis(fresh, since, axis=1) + places - since) % n).astype(np.int32)


def bartlett_t(x: np.ndarray, lags: int) -> float:
    """The same t of one stream: all weighted autocovariances by one pass with as many taps as lags."""
    n, z = len(x), x - x.mean()
    k = np.arange(min(lags, n - 1) + 1)
    taps = np.where(k == 0, 1.0, 2.0 * (1 - k / (lags + 1))) / (n - k)
    v = z @ np.convolve(z[::-1], taps)[:n][::-1]
    return float(x.mean() / math.sqrt(max(v, 1e-12) / n))


def _worlds(g: dict[str, np.ndarray], first: int, n: int, block: int, reps: int, lags: int, seed: int) -> dict[str, np.ndarray]:
    x = np.zeros(n)
    x[g["day"].astype(int) - first] = np.nan_to_num(g["r"])
    centred = x - x.mean()
    t = [bartlett_t(x, lags), *(bartlett_t(centred[i], lags) for i in stationary_blocks(n, block, reps, seed))]
    return {"entity": np.full(reps + 1, g["entity"][0], object), "rep": np.arange(-1, reps), "t": np.array(t)}


def family_inference(days: DataFrame, *, reps: int = 500, block: int = 20, lags: int = 20, seed: int = 0) -> DataFrame:
    """(entity, t, p, global_p): HAC t of every stream and its Romano-Wolf step-down p among all of them.

    ``days`` has one row for each (entity, day) with r; days of the common calendar without a row are 0. All
    streams are resampled by the same stationary bootstrap and centred at a mean of zero; the maxima are over the
    streams that are not larger. Streams are spread over tasks; for the maxima, ranks are cut into ranges and only
    a range's maxima of a world meet those of other ranges. Fewer than three calendar days: no rows.
    """
    known = days.where("entity is not null and day is not null")
    first, last = known.agg(F.min("day"), F.max("day")).first()
    if first is None or last - first < 2:
        return days.sparkSession.createDataFrame([], "entity string, t double, p double, global_p double")
    made = by_group(known.select("entity", "day", "r"), partial(_worlds, first=int(first), n=int(last - first + 1), block=block, reps=reps, lags=lags, seed=seed), "entity string, rep int, t double", keys=("entity",), order=("day",))
    made = cut_lineage(made)  # used for the ranks and for the worlds
    ranked = ordered(made.where("rep < 0").select("entity", "t", (1 / (1 + F.exp("t"))).alias("v")), "v", "entity")
    null = made.where("rep >= 0").select("entity", "rep", F.col("t").alias("x")).join(ranked.select("entity", "rank", "range", "t"), "entity")
    tops = null.groupBy("rep", "range").agg(F.max("x").alias("best"))
    below = tops.withColumn("carried", F.max("best").over(Window.partitionBy("rep").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1))).select("rep", "range", "carried")
    inside = Window.partitionBy("rep", "range").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    largest = F.greatest(F.max("x").over(inside), F.col("carried"))
    beaten = null.join(below, ["rep", "range"]).withColumn("largest", largest).groupBy("entity").agg(((1 + F.count_if(F.col("largest") >= F.col("t"))) / (reps + 1)).alias("raw"))
    adjusted = _running(ranked.join(beaten, "entity"), F.col("raw"), "rank", F.max)
    # the largest stream's own value is that of all streams together
    return adjusted.select("entity", "t", F.col("running").alias("p")).join(F.broadcast(adjusted.where("rank = 1").select(F.col("raw").alias("global_p"))))
