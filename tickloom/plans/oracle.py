"""Common table expressions shared by the SQL that queries are compared with."""

from __future__ import annotations

import math

FINITE = " and ".join(f"{x} is not null and not isnan({x}) and {x} > 0 and {x} < 'infinity'::double" for x in ("o", "h", "l", "c"))

CLEAN = f"""
picked as (
  select instrument, tmin, o, h, l, c,
    case when v is not null and not isnan(v) and v >= 0 and v < 'infinity'::double then v end as v, seg, sday, sm, rw,
    row_number() over (partition by instrument, tmin order by recv_ts desc nulls last, bar_id desc nulls last) as pick
  from bars where instrument is not null and tmin is not null and {FINITE}
    and h >= greatest(o, c) - 1e-9 and l <= least(o, c) + 1e-9),
b as (
  select instrument, tmin, o, h, l, c, v, seg, sday, sm, rw,
    cast(row_number() over (partition by instrument, sday, seg order by tmin) - 1 as integer) as pos
  from picked where pick = 1)
"""
G = "partition by instrument, sday, seg order by tmin"


def frame(n: int, until: int = 0) -> str:
    end = "current row" if until == 0 else f"{-until} preceding"
    return f"({G} rows between {n - 1 - until} preceding and {end})"


def guard(expr: str, x: str, n: int, min_frac: float = 1.0) -> str:
    need = max(1, math.ceil(min_frac * n - 1e-9))
    return f"case when pos >= {n - 1} and count({x}) over {frame(n)} >= {need} then {expr} end"


def rsum(x: str, n: int, f: float = 1.0) -> str:
    return guard(f"sum({x}) over {frame(n)}", x, n, f)


def rmean(x: str, n: int, f: float = 1.0) -> str:
    return guard(f"avg({x}) over {frame(n)}", x, n, f)


def rstd(x: str, n: int, f: float = 1.0) -> str:
    w = frame(n)
    return guard(f"sqrt(greatest(avg(({x}) * ({x})) over {w} - (avg({x}) over {w}) * (avg({x}) over {w}), 0))", x, n, f)


def rmax(x: str, n: int) -> str:
    return guard(f"max({x}) over {frame(n)}", x, n, 0.0)


def rmin(x: str, n: int) -> str:
    return guard(f"min({x}) over {frame(n)}", x, n, 0.0)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over ({G})"


def ratio(a: str, b: str) -> str:
    return f"(case when ({b}) > 0 then ({a}) / ({b}) end)"


def ln(x: str) -> str:
    return f"(case when ({x}) > 0 then ln({x}) end)"
