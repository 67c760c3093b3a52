"""Irregular readings onto the regular grid of listed sessions.

Every listed session is a row (source, sday, open, close, step); its periods start at
open, open + step, ... before close. Readings are (source, minute, exact time, value...).
For each period the operator gives the readings inside it and a local polynomial estimate
of each value at the period's start: the readings of the same session closer than
``bandwidth`` periods are weighted by the compact Epanechnikov kernel 1 - (d / bandwidth)^2
and a polynomial of ``degree`` in d is fitted. The effective support is (sum w)^2 / sum w^2;
where it is below ``min_support`` the estimate is NULL and the period is marked ``missing``.

Plan: readings and sessions meet in one shuffle. Time is cut into blocks of eight times
the longest session; a session belongs to the block of its opening and a reading to its
block and, within the longest session's length after the block's start, to the block
before as well, so a (source, block) group is whole without a join and is bounded by time
however hot a source is. The groups arrive sorted and are evaluated with NumPy over whole
Arrow batches: the sorted readings are the index, searched once for each session. A session of
more than ``LONGEST`` minutes (a wrong close) is evaluated in pieces of whole periods of that length, so
it neither widens the blocks nor fills a task; an estimate uses readings of its own piece.

Defined results for odd input
    * NULL source or NULL minute: covers nothing; a session with NULL in any of its fields
      or a step below 1 gives no periods.
    * value NULL or NaN: not usable. An infinite first value counts as a usable reading of its
      period (``n_obs``) but enters no estimate, and ``last`` shows it.
    * repeated rows count again in ``n_obs``; the estimate is the weighted mean, so exact
      repeats only raise the weight. Ties of ``last`` go to the later exact time, then the
      larger value.
    * empty readings: every period is missing; empty sessions: no rows.
    * extra columns are ignored and their names never clash, since only named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = (
    "source string, sday int, tmin bigint, n_obs int, last double, "
    "c_fit double, c_support double, v_fit double, v_support double, mark string"
)
NAMES = ["source", "sday", "tmin", "n_obs", "last", "c_fit", "c_support", "v_fit", "v_support", "mark"]
BLOCK_SESSIONS = 8
#: Minutes of a session that are evaluated together.
LONGEST = 5760


def local_polynomial(cell: np.ndarray, u: np.ndarray, y: np.ndarray, start: np.ndarray, count: np.ndarray, total: int, bandwidth: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimate and effective support at each of ``total`` grid cells.

    A reading i has the position ``u[i]`` in periods of its session, whose cells are
    ``start[i] .. start[i] + count[i] - 1`` of all cells; ``cell[i]`` is floor(u[i]).
    """
    moments = np.zeros((2 * degree + 1, total))
    products = np.zeros((degree + 1, total))
    squares = np.zeros(total)
    for shift in range(1 - bandwidth, bandwidth + 1):
        k = cell + shift
        d = u - k
        w = 1.0 - (d / bandwidth) ** 2
        near = (k >= 0) & (k < count) & (w > 0)
        at, d, w, yy = (start + k)[near], d[near], w[near], y[near]
        squares += np.bincount(at, w * w, total)
        power = w
        for m in range(2 * degree + 1):
            moments[m] += np.bincount(at, power, total)
            if m <= degree:
                products[m] += np.bincount(at, power * yy, total)
            power = power * d
    weight = moments[0]
    some = weight > 0
    with np.errstate(all="ignore"):
        fit = np.where(some, products[0] / weight, np.nan)
        support = np.where(some, weight**2 / squares, 0.0)
        if degree >= 1:
            det = moments[0] * moments[2] - moments[1] ** 2
            good = some & (det > 1e-9 * weight**2)
            fit = np.where(good, (moments[2] * products[0] - moments[1] * products[1]) / det, fit)
        if degree >= 2:
            a = np.empty((total, 3, 3))
            for i in range(3):
                for j in range(3):
                    a[:, i, j] = moments[i + j]
            good = some & (np.abs(np.linalg.det(a)) > 1e-6 * weight**3)
            if good.any():
                fit[good] = np.linalg.solve(a[good], products[:, good].T[..., None])[:, 0, 0]
    return fit, support


def _evaluate(group: pa.Table, bandwidth: int, degree: int, min_support: float, only_unobserved: bool) -> pa.RecordBatch | None:
    """All whole (source, block) groups of a table sorted by source, block, kind, t, x, c."""
    kind = group["kind"].to_numpy()
    is_session = kind == 0
    if not is_session.any():
        return None
    source = group["source"].combine_chunks().dictionary_encode()
    block = group["block"].to_numpy()
    code = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.r_[0, np.cumsum((code[1:] != code[:-1]) | (block[1:] != block[:-1]))]
    t = group["t"].to_numpy()
    # one integer orders group and minute; minutes are taken from the least one of the table
    low = t.min()
    width = int(t.max() - low) + 2
    s_open, s_end = t[is_session], group["t_end"].to_numpy()[is_session]
    s_step, s_key = group["step"].to_numpy()[is_session], key[is_session]
    n_periods = -(-(s_end - s_open) // s_step)
    first = np.r_[0, np.cumsum(n_periods)]
    total = int(first[-1])
    if total == 0:
        return None
    r_at = np.flatnonzero(~is_session)
    place = key[r_at] * width + (t[r_at] - low)
    clip = lambda m: np.clip(m - low, 0, width - 1)
    lo = np.searchsorted(place, s_key * width + clip(s_open))
    hi = np.searchsorted(place, s_key * width + clip(s_open + n_periods * s_step))
    n = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(s_open)), n)
    row = r_at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    step = s_step[owner]
    inside = t[row] - s_open[owner]
    period = inside // step
    if_start = group["on_start"].to_numpy(zero_copy_only=False)[row].astype(bool)
    c, v, x = (group[name].to_numpy()[row].astype(float) for name in ("c", "v", "x"))
    usable = ~np.isnan(c) & (~if_start | (inside % step == 0))
    at = first[owner] + period
    n_obs = np.bincount(at[usable], minlength=total)
    last = np.full(total, np.nan)
    last[at[usable]] = c[usable]  # rows are sorted, so the last one stays
    u = (x - s_open[owner]) / step
    fits = {}
    for name, y in (("c", c), ("v", v)):
        ok = np.isfinite(y) & (usable if name == "c" else True)
        fits[name] = local_polynomial(np.floor(u[ok]).astype(np.int64), u[ok], y[ok], first[owner][ok], n_periods[owner][ok], total, bandwidth, degree)
    of = np.repeat(np.arange(len(s_open)), n_periods)
    start = s_open[of] + (np.arange(total) - first[of]) * s_step[of]
    enough = {name: support >= min_support for name, (_, support) in fits.items()}
    mark = np.where(n_obs > 0, "observed", np.where(enough["c"], "filled", "missing"))
    keep = np.flatnonzero(n_obs == 0) if only_unobserved else np.arange(total)

    def nullable(values: np.ndarray, valid: np.ndarray) -> pa.Array:
        return pa.array(values[keep], pa.float64(), mask=~valid[keep])

    s_at = np.flatnonzero(is_session)[of[keep]]
    columns = [
        group["source"].combine_chunks().take(pa.array(s_at)),
        pa.array(group["sday"].to_numpy()[s_at].astype(np.int32)),
        pa.array(start[keep]),
        pa.array(n_obs[keep].astype(np.int32)),
        nullable(last, n_obs > 0),
        nullable(fits["c"][0], enough["c"]),
        pa.array(fits["c"][1][keep]),
        nullable(fits["v"][0], enough["v"]),
        pa.array(fits["v"][1][keep]),
        pa.array(mark[keep].astype(str), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 0) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (but the last) that end where a group of ``keys`` ends,
    from batches of sorted rows."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        if not held or rows < least:
            held.append(batch)
            rows, last = rows + batch.num_rows, now
            continue
        same = np.ones(batch.num_rows, bool)
        for k, value in zip(keys, last, strict=True):
            column = batch.column(k)
            equal = pc.is_null(column) if value is None else pc.equal(column, pa.scalar(value, column.type)).fill_null(False)
            same &= equal.to_numpy(zero_copy_only=False)
        if same.all():
            held.append(batch)
            rows += batch.num_rows
            continue
        cut = int(np.flatnonzero(~same)[0])
        yield pa.Table.from_batches([*held, batch.slice(0, cut)] if held else [batch.slice(0, cut)])
        held, rows, last = [batch.slice(cut)], batch.num_rows - cut, now
    if held:
        yield pa.Table.from_batches(held)


def regular_grid(
    readings: DataFrame,
    sessions: DataFrame,
    *,
    source: str | Column = "instrument",
    minute: str | Column = "tmin",
    exact_minute: str | Column | None = None,
    value: str | Column = "c",
    second: str | Column = "v",
    session_source: str | Column = "instrument",
    on_start: bool = False,
    bandwidth: int = 3,
    degree: int = 1,
    min_support: float = 2.0,
    only_unobserved: bool = False,
) -> DataFrame:
    """One row for each period of ``sessions``; see the module's text.

    ``on_start``: a reading is usable for a period only at the period's first minute.
    ``only_unobserved``: of the evaluated grid only the periods without a usable reading.
    ``mark`` is observed (a usable reading inside), filled (estimated) or missing.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    listed = sessions.select(
        as_col(session_source).alias("source"),
        F.col("sday").cast("int").alias("sday"),
        F.col("open_tmin").cast("bigint").alias("t"),
        F.col("close_tmin").cast("bigint").alias("t_end"),
        F.col("step_min").cast("bigint").alias("step"),
    ).where("source is not null and sday is not null and t is not null and t_end > t and step >= 1")
    piece = F.expr(f"greatest(step, ({LONGEST} div step) * step)")
    listed = listed.withColumn("piece", piece).withColumn("t", F.explode(F.sequence("t", F.col("t_end") - 1, "piece"))).withColumn("t_end", F.least("t_end", F.col("t") + F.col("piece"))).drop("piece")
    longest = listed.agg(F.max(F.expr("t_end - t + step"))).first()[0]
    if longest is None:
        return sessions.sparkSession.createDataFrame([], OUT)
    span = BLOCK_SESSIONS * int(longest)
    null = lambda kind: F.lit(None).cast(kind)
    minute = as_col(minute).cast("bigint")
    exact = minute.cast("double") if exact_minute is None else F.coalesce(as_col(exact_minute), minute.cast("double"))
    clean = lambda c: F.when(~F.isnan(c), c)
    read = (
        readings.select(as_col(source).alias("source"), minute.alias("t"), exact.alias("x"), clean(as_col(value).cast("double")).alias("c"), clean(as_col(second).cast("double")).alias("v"))
        .where("source is not null and t is not null and (c is not null or v is not null)")
        .withColumn("home", F.floor(F.col("t") / span))
        .withColumn("block", F.explode(F.when(F.col("t") - F.col("home") * span < int(longest), F.array(F.col("home"), F.col("home") - 1)).otherwise(F.array("home"))))
    )
    rows = listed.select("source", F.floor(F.col("t") / span).alias("block"), F.lit(0).alias("kind"), "t", null("double").alias("x"), null("double").alias("c"), null("double").alias("v"), "sday", "t_end", "step", F.lit(False).alias("on_start")).unionByName(
        read.select("source", "block", F.lit(1).alias("kind"), "t", "x", "c", "v", F.lit(0).alias("sday"), F.lit(0).cast("bigint").alias("t_end"), F.lit(1).cast("bigint").alias("step"), F.lit(on_start).alias("on_start"))
    )
    grouped = rows.repartition("source", "block").sortWithinPartitions("source", "block", "kind", "t", "x", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["source", "block"]):
            out = _evaluate(group, bandwidth, degree, min_support, only_unobserved)
            if out is not None and out.num_rows:
                yield out

    return grouped.mapInArrow(run, OUT)


def market_grid(bars: DataFrame, sessions: DataFrame, **options) -> DataFrame:
    """The grid of delivered bars: closes and volumes of each instrument."""
    return regular_grid(bars, sessions, exact_minute=F.unix_micros("ts") / 6e7, **options)


def aligned_grid(aligned: DataFrame, sessions: DataFrame, other: str = "ES", **options) -> DataFrame:
    """The grid of the aligned other market: only rows with evalid true at the period's start count."""
    usable = lambda c: F.when(F.col("evalid"), F.col(c))
    return regular_grid(
        aligned.select("tmin", usable("ec").alias("ec"), usable("ev").alias("ev")),
        sessions.where(F.col("instrument") == other),
        source=F.lit(other), value="ec", second="ev", on_start=True, **options,
    )


def unobserved_periods(bars: DataFrame, aligned: DataFrame, sessions: DataFrame) -> DataFrame:
    """Periods without a usable close: (series, instrument, tmin)."""
    one = market_grid(bars, sessions, only_unobserved=True)
    two = aligned_grid(aligned, sessions, only_unobserved=True)
    return one.select(F.lit("bars").alias("series"), F.col("source").alias("instrument"), "tmin").unionByName(
        two.select(F.lit("aligned").alias("series"), F.lit("NQ").alias("instrument"), "tmin")
    )
