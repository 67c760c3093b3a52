"""Causal rolling operations within groups, with the guard semantics of the feature library.

A group is a run of one instrument's bars of the same session and contract. A window of n bars
gives NULL until the group has n bars, and NULL where fewer than max(1, ceil(min_frac * n)) of
its values are there. NaN must have become NULL before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

GROUP = ("instrument", "sday", "seg")


class Rolling:
    """Window expressions over one partitioning; every one of them shares a single sort."""

    def __init__(self, group: Sequence[str] = GROUP, order: str = "tmin", pos: str = "pos") -> None:
        self.group, self.order, self.pos = list(group), order, pos

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(self.order)

    @property
    def so_far(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def last_bars(self, n: int, until: int = 0) -> WindowSpec:
        return self.ordered.rowsBetween(until - n + 1, until)

    def position(self) -> Column:
        return (F.row_number().over(self.ordered) - 1).cast("int")

    def lag(self, x: Column, n: int = 1) -> Column:
        return x if n == 0 else F.lag(x, n).over(self.ordered)

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.ordered)

    def diff(self, x: Column) -> Column:
        return x - self.lag(x)

    def guarded(self, value: Column, x: Column, n: int, min_frac: float = 1.0) -> Column:
        need = max(1, math.ceil(min_frac * n - 1e-9))
        return F.when((F.col(self.pos) >= n - 1) & (F.count(x).over(self.last_bars(n)) >= need), value)

    def sum(self, x: Column, n: int, min_frac: float = 1.0) -> Column:
        return self.guarded(F.sum(x).over(self.last_bars(n)), x, n, min_frac)

    def mean(self, x: Column, n: int, min_frac: float = 1.0) -> Column:
        return self.guarded(F.avg(x).over(self.last_bars(n)), x, n, min_frac)

    def std(self, x: Column, n: int, min_frac: float = 1.0) -> Column:
        w = self.last_bars(n)
        return self.guarded(F.sqrt(F.greatest(F.avg(x * x).over(w) - F.avg(x).over(w) * F.avg(x).over(w), F.lit(0.0))), x, n, min_frac)

    def max(self, x: Column, n: int) -> Column:
        return self.guarded(F.max(x).over(self.last_bars(n)), x, n, 0.0)

    def min(self, x: Column, n: int) -> Column:
        return self.guarded(F.min(x).over(self.last_bars(n)), x, n, 0.0)

    def mean_before(self, x: Column, n: int) -> Column:
        """Mean of the n values before the current one, all of them needed."""
        w = self.last_bars(n, -1)
        return F.when(F.count(x).over(w) == n, F.avg(x).over(w))

    def cumulative(self, x: Column) -> Column:
        return F.sum(F.coalesce(x, F.lit(0.0))).over(self.so_far)

    def last_where(self, mask: Column, x: Column) -> Column:
        """The latest x at a bar with the mask, a NULL x included."""
        return F.last(F.when(mask, F.struct(x.alias("x"))), ignorenulls=True).over(self.so_far)["x"]

    def bars_since(self, mask: Column) -> Column:
        return F.col(self.pos) - F.last(F.when(mask, F.col(self.pos)), ignorenulls=True).over(self.so_far)

    def moments(self, x: Column, y: Column, n: int) -> dict[str, Column]:
        """Means over the bars of a window in which both are there."""
        both = x.isNotNull() & y.isNotNull()
        a, b, w = F.when(both, x), F.when(both, y), self.last_bars(n)
        mean = lambda e: F.avg(e).over(w)
        return {"x": mean(a), "y": mean(b), "xx": mean(a * a), "yy": mean(b * b), "xy": mean(a * b), "both": a}

    def corr(self, x: Column, y: Column, n: int, min_frac: float = 1.0) -> Column:
        m = self.moments(x, y, n)
        vx, vy = m["xx"] - m["x"] * m["x"], m["yy"] - m["y"] * m["y"]
        ok = F.when((vx > 1e-18) & (vy > 1e-18), (m["xy"] - m["x"] * m["y"]) / F.sqrt(vx * vy))
        return self.guarded(ok, m["both"], n, min_frac)

    def beta(self, x: Column, y: Column, n: int, min_frac: float = 1.0) -> Column:
        """Slope of y on x."""
        m = self.moments(x, y, n)
        vx = m["xx"] - m["x"] * m["x"]
        return self.guarded(F.when(vx > 1e-18, (m["xy"] - m["x"] * m["y"]) / vx), m["both"], n, min_frac)

    def ols(self, y: Column, n: int) -> dict[str, Column]:
        """Slope, t (within 50), R2 and residual deviation of y on time over n full bars."""
        w, t = self.last_bars(n), F.col(self.pos).cast("double")
        full = F.count(y).over(w) == n
        # time is taken from the window's own end: its mean and variance are constants
        mt, vt = -(n - 1) / 2.0, (n * n - 1) / 12.0
        local = F.sum(t * y).over(w) - t * F.sum(y).over(w)
        my = F.avg(y).over(w)
        vy = F.greatest(F.avg(y * y).over(w) - my * my, F.lit(0.0))
        cov = local / n - mt * my
        slope = cov / vt
        rss = F.greatest(vy - slope * slope * vt, F.lit(0.0))
        r2 = F.when(vy > 1e-18, F.least(F.lit(1.0), slope * slope * vt / vy))
        se = F.sqrt(rss / max(n - 2, 1) / vt)
        keep = lambda e: F.when((F.col(self.pos) >= n - 1) & full, e)
        return {
            "slope": keep(slope),
            "t": keep(F.when(se > 1e-12, F.greatest(F.lit(-50.0), F.least(F.lit(50.0), slope / se)))),
            "r2": keep(r2),
            "resid": keep(F.sqrt(rss)),
        }

    def occupation(self, c: Column, n: int) -> Column:
        """Share of the last n values above the value before them."""
        start = F.lag(c, n).over(self.ordered)
        values = F.collect_list(c).over(self.last_bars(n))
        above = F.size(F.filter(values, lambda v: v > start)) / F.lit(float(n))
        return F.when((F.col(self.pos) >= n) & (F.size(values) == n) & start.isNotNull(), above)


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is above zero, else NULL."""
    return F.when(b > 0, a / b)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate correlation over the rows with both values; NULL where either doesn't vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    vx, vy = F.var_pop(a), F.var_pop(b)
    return F.when((vx > 1e-24) & (vy > 1e-24), F.covar_pop(a, b) / F.sqrt(vx) / F.sqrt(vy))


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def both(fn, a: Column, b: Column) -> Column:  # noqa: ANN001
    """greatest or least that is NULL where either is."""
    return F.when(a.isNotNull() & b.isNotNull(), fn(a, b))


def clock_mean(x: Column, sessions: int, *, min_frac: float = 1.0, instrument: str = "instrument", sm: str = "sm", ordinal: str = "session_no") -> Column:
    """Mean at the same session minute over the ``sessions`` sessions before, by calendar position:
    a session without the minute counts towards them."""
    w = Window.partitionBy(instrument, sm).orderBy(ordinal).rangeBetween(-sessions, -1)
    return F.when(F.count(x).over(w) >= max(1, math.ceil(min_frac * sessions - 1e-9)), F.avg(x).over(w))


def clock_quantile(x: Column, sessions: int, q: float, *, instrument: str = "instrument", sm: str = "sm", ordinal: str = "session_no") -> Column:
    """Quantile at the same session minute over the last ``sessions`` sessions that have it, all needed."""
    w = Window.partitionBy(instrument, sm).orderBy(ordinal).rowsBetween(-sessions, -1)
    return F.when(F.count(x).over(w) == sessions, F.percentile(x, q).over(w))
