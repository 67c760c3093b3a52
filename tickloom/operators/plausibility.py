"""Implausible readings of a source: hidden Markov chains per measurement, and hard bounds.

Each measurement of a source's readings in time order is a chain with the states normal,
spike, stuck and out-of-range. Three things are seen at a reading:

    * its departure z: the smaller of the distances (in logs) to the median of the ``WINDOW``
      readings before and of those after, if both lie on one side, over the scale of steps at
      that time: the median absolute step nearby, at least ``SCALE_FLOOR`` of the source's own.
      A move that lasts (news, a contract roll, an opening gap) stays close to one side.
    * whether it repeats the reading before,
    * whether it breaks a hard bound.

Emissions: normal has an exponential tail in z and repeats as often as this source otherwise
does (estimated from the source, without the runs that are too long for it); spike is flat in
log z from a least departure on, which differs between prices and volumes; stuck repeats nearly always; out-of-range breaks a bound. Forward-backward gives
each state's probability and a reading is flagged where a state other than normal has more than
``threshold``; hard bounds flag by themselves. The first reading of a stuck run repeats nothing,
so it takes the flag of the second.

Plan: readings are cut in time per source, into blocks of about ``block_readings`` readings with
an eighth of a block to either side, so a source with a third of all rows spreads over tasks;
sources below two blocks stay whole. Readings per source are counted first (a partial aggregate);
the counts are broadcast only where their number is checked to be at most ``broadcast_sources``,
else joined by a shuffle. One shuffle brings the blocks together, sorted. A whole Arrow table of
blocks is evaluated at once: the chains are cut into pieces of ``PIECE`` readings with ``BURN``
more on either side, over which a chain forgets its start, so that all pieces take each step of
the recursion together.

Defined results for odd input
    * NULL source: only hard bounds apply. NULL id or NULL time: a NULL id is left out, a reading
      without time gets hard bounds only.
    * NULL and NaN are missing, never implausible. Readings of one id in one source count once.
    * several readings at one time follow each other by id. Empty table: no rows.
    * a source with fewer than ``LEAST`` usable values of a measurement has hard bounds only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.grid import whole_groups

WINDOW, NEAR, SCALE_FLOOR, LEAST = 7, 15, 0.5, 20
PIECE, BURN = 256, 64
NORMAL, SPIKE, STUCK, OUT = range(4)
#: Chains: the measurement, the least departure of a spike (None: departures don't count), whether repeats count, the rate of normal's tail.
CHAINS = (("c", 9.0, True, 1.35), ("v", 5.0, True, 2.1), ("h", 9.0, False, 1.35), ("l", 9.0, False, 1.35), ("hl", None, True, 1.0))
ENTER = {SPIKE: 1e-3, STUCK: 1e-6, OUT: 1e-5}
LEAVE = {SPIKE: 0.5, STUCK: 0.05, OUT: 0.6}
TABLE = "bar_id bigint, hard boolean, spike double, stuck double, out_of_range double, flag string"
#: Spike is flat in ln z from its least departure to this one.
FARTHEST = 1e5

HARD = (
    "coalesce(o <= 0 or o = double('infinity'), false) or coalesce(h <= 0 or h = double('infinity'), false)"
    " or coalesce(l <= 0 or l = double('infinity'), false) or coalesce(c <= 0 or c = double('infinity'), false)"
    " or coalesce(h < o, false) or coalesce(h < c, false) or coalesce(h < l, false) or coalesce(l > o, false) or coalesce(l > c, false)"
    " or coalesce(v < 0 or v = double('infinity') or v <> floor(v), false)"
)


def departures(x: np.ndarray) -> np.ndarray:
    """z of each value of one source in time order; see the module's text."""
    n = len(x)
    if n < LEAST:
        return np.zeros(n)
    step = np.abs(np.diff(x, prepend=x[0]))
    own = max(1.4826 * np.median(step[1:]), 1e-9)
    blocks = -(-n // NEAR)
    padded = np.r_[step, np.repeat(step[-NEAR:], 1 + 5 * NEAR // min(NEAR, n))][: (blocks) * NEAR]
    wide = np.pad(padded.reshape(blocks, NEAR), ((2, 2), (0, 0)), mode="reflect" if blocks > 2 else "edge")
    near = np.median(np.lib.stride_tricks.sliding_window_view(wide, 5, axis=0).reshape(blocks, -1), axis=1)
    scale = np.maximum(1.4826 * np.repeat(near, NEAR)[:n], SCALE_FLOOR * own)
    middle = np.sort(np.lib.stride_tricks.sliding_window_view(x, WINDOW), axis=1)[:, WINDOW // 2]
    before, after = np.empty(n), np.empty(n)
    before[WINDOW:], after[: n - WINDOW] = middle[: n - WINDOW], middle[1:]
    for i in range(WINDOW):
        before[i] = np.median(x[:i]) if i else np.nan
        after[n - 1 - i] = np.median(x[n - i :]) if i else np.nan
    a, b = x - before, x - after
    with np.errstate(invalid="ignore"):
        s = np.where(np.sign(a) == np.sign(b), np.minimum(np.abs(a), np.abs(b)), 0.0)
    s[0], s[-1] = np.abs(b[0]) / 2, np.abs(a[-1]) / 2
    return s / scale


def repeat_rate(repeats: np.ndarray) -> float:
    """How often a source's value repeats, without the runs that are too long for it.

    A run's length is geometric if repeats are independent; runs beyond what the rate of the
    others makes likely even once in all readings are left out, until none is.
    """
    n = len(repeats)
    edges = np.flatnonzero(np.diff(np.r_[False, repeats, False].astype(np.int8)))
    runs = np.sort(edges[1::2] - edges[::2])
    kept = len(runs)
    while True:
        rate = (runs[:kept].sum() + 1.0) / (n - runs[kept:].sum() + 20.0)
        longest = max(2.0, np.log(max(n, 2)) / -np.log(min(rate, 0.9)) + 1)
        now = int(np.searchsorted(runs[:kept], longest, side="right"))
        if now == kept:
            return float(min(max(rate, 1e-4), 0.6))
        kept = now


def forward_backward(emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """State probabilities of many chains at once: emit is (steps, chains, states)."""
    steps = len(emit)
    alpha = np.empty_like(emit)
    a = start * emit[0]
    alpha[0] = a / a.sum(-1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ move) * emit[t]
        a /= a.sum(-1, keepdims=True)
        alpha[t] = a
    b = np.ones_like(emit[0])
    for t in range(steps - 2, -1, -1):
        b = (b * emit[t + 1]) @ move.T
        b /= b.sum(-1, keepdims=True)
        alpha[t] *= b
    return alpha / alpha.sum(-1, keepdims=True)


def transitions() -> tuple[np.ndarray, np.ndarray]:
    move = np.zeros((4, 4))
    for s, p in ENTER.items():
        move[NORMAL, s] = p
        move[s, NORMAL], move[s, s] = LEAVE[s], 1 - LEAVE[s]
    move[NORMAL, NORMAL] = 1 - sum(ENTER.values())
    return move, move[NORMAL]


def posteriors(emissions: list[np.ndarray]) -> list[np.ndarray]:
    """Probabilities for sequences of emissions (readings, chains, states)."""
    move, start = transitions()
    pieces = []
    for i, e in enumerate(emissions):
        for at in range(0, len(e), PIECE):
            lo, hi = max(0, at - BURN), min(len(e), at + PIECE + BURN)
            pieces.append((i, at, lo, hi))
    out = [np.empty_like(e) for e in emissions]
    for length in sorted({-(-(hi - lo) // 64) for _, _, lo, hi in pieces}):
        mine = [p for p in pieces if -(-(p[3] - p[2]) // 64) == length]
        chains = emissions[0].shape[1]
        emit = np.ones((length * 64, len(mine), chains, 4))
        for k, (i, _, lo, hi) in enumerate(mine):
            emit[: hi - lo, k] = emissions[i][lo:hi]
        p = forward_backward(emit.reshape(length * 64, -1, 4), move, start).reshape(emit.shape)
        for k, (i, at, lo, hi) in enumerate(mine):
            end = min(at + PIECE, hi)
            out[i][at:end] = p[at - lo : end - lo, k]
    return out


def source_emissions(o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """(readings, chains, states) emissions of one source and whether readings repeat, per chain."""
    n = len(c)
    emit = np.ones((n, len(CHAINS), 4))
    repeats = np.zeros((n, len(CHAINS)), bool)
    for k, (name, least, repeated, rate) in enumerate(CHAINS):
        x = {"c": c, "v": v, "h": h, "l": l, "hl": h}[name]
        if name == "hl":
            usable = np.isfinite(h) & np.isfinite(l)
        elif name == "v":
            usable = np.isfinite(x)
        else:
            usable = ~np.isnan(x)
        good = usable & ((x >= 0) if name == "v" else (x > 0)) & np.isfinite(x)
        at = np.flatnonzero(good)
        wrong = np.flatnonzero(usable & ~good)
        emit[wrong, k] = (1e-9, 1e-9, 1e-9, 1.0)
        if len(at) < LEAST:
            continue
        e = np.ones((len(at), 4))
        e[:, OUT] = 1e-9
        if least:
            z = departures(np.log1p(x[at]) if name == "v" else np.log(x[at]))
            normal = rate * np.exp(-rate * np.minimum(z, 300.0))
            e[:, NORMAL] *= normal
            e[:, STUCK] *= normal
            e[:, SPIKE] *= np.where(z >= least, 1 / (np.log(FARTHEST / least) * np.maximum(z, least)), 1e-12)
        else:
            e[:, SPIKE] = 1e-9
        if repeated:
            same = np.r_[False, x[at][1:] == x[at][:-1]]
            if name == "hl":
                same &= np.r_[False, l[at][1:] == l[at][:-1]]
            repeats[at, k] = same
            p = repeat_rate(same)
            usual = np.where(same, p, 1 - p)
            for s in (NORMAL, SPIKE, OUT):
                e[:, s] *= usual
            e[:, STUCK] *= np.where(same, 0.99, 0.01)
        else:
            e[:, STUCK] = 1e-9
        emit[at, k] = e / e.max(axis=1, keepdims=True)
    return np.maximum(emit, 1e-300), repeats


def evaluate(group: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Flagged probabilities of the readings of whole blocks, sorted by source, block, t, id."""
    source = group["source"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    block, t, ident = (group[name].to_numpy() for name in ("block", "t", "bar_id"))
    again = np.zeros(len(t), bool)
    again[1:] = (source[1:] == source[:-1]) & (block[1:] == block[:-1]) & (t[1:] == t[:-1]) & (ident[1:] == ident[:-1])
    rows = np.flatnonzero(~again)
    source, block, ident = source[rows], block[rows], ident[rows]
    core, hard = (group[name].to_numpy(zero_copy_only=False)[rows].astype(bool) for name in ("core", "hard"))
    timed = group["timed"].to_numpy(zero_copy_only=False)[rows].astype(bool)
    values = [np.array(group[name].to_numpy(zero_copy_only=False)[rows], float) for name in "ohlcv"]
    starts = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (block[1:] != block[:-1])])
    ends = np.r_[starts[1:], len(rows)]
    found = np.zeros((len(rows), 4))
    spans, emissions, repeats = [], [], []
    for a, b in zip(starts, ends, strict=True):
        if source[a] >= 0 and timed[a]:
            e, r = source_emissions(*(x[a:b] for x in values))
            spans.append((a, b))
            emissions.append(e)
            repeats.append(r)
    for (a, b), p, r in zip(spans, posteriors(emissions), repeats, strict=True):
        stuck = p[:, :, STUCK]
        stuck[:-1] = np.maximum(stuck[:-1], np.where(r[1:], stuck[1:], 0.0))
        found[a:b] = p.max(axis=1)
    spike, stuck, out = found[:, SPIKE], found[:, STUCK], found[:, OUT]
    keep = np.flatnonzero(core & (hard | (np.maximum(np.maximum(spike, stuck), out) > threshold)))
    if not len(keep):
        return None
    flag = np.where(hard | (out > threshold), "out_of_range", np.where(stuck >= spike, "stuck", "spike"))
    names = ["bar_id", "hard", "spike", "stuck", "out_of_range", "flag"]
    arrays = [pa.array(ident[keep]), pa.array(hard[keep]), pa.array(spike[keep]), pa.array(stuck[keep]), pa.array(out[keep]), pa.array(flag[keep].astype(str), pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def implausible_readings(bars: DataFrame, *, threshold: float = 0.5, block_readings: int = 16384, broadcast_sources: int = 100_000) -> DataFrame:
    """One row for each flagged reading of each source: probabilities and the flag's name."""
    read = bars.where("bar_id is not null").select(
        F.col("instrument").alias("source"), F.col("bar_id").cast("bigint").alias("bar_id"), F.unix_micros("ts").alias("at"),
        *[F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) for c in "ohlcv"],
    ).withColumn("hard", F.expr(HARD))
    spans = (
        bars.where("instrument is not null and ts is not null").groupBy(F.col("instrument").alias("source"))
        .agg(F.count("*").alias("n"), F.min(F.unix_micros("ts")).alias("first"), F.max(F.unix_micros("ts")).alias("last"))
        .where(F.col("n") >= 2 * block_readings)
        # as doubles: microseconds of 18 years times the readings of a block are beyond a bigint
        .select("source", "first", (F.floor((F.col("last") - F.col("first")).cast("double") * block_readings / F.col("n")) + 1).alias("span"))
    )
    few = len(spans.select("source").take(broadcast_sources + 1)) <= broadcast_sources
    cut = read.join(F.broadcast(spans) if few else spans, "source", "left")
    place, into = F.floor((F.col("at") - F.col("first")) / F.col("span")), F.pmod(F.col("at") - F.col("first"), F.col("span"))
    home = F.struct(F.coalesce(place, F.lit(0)).alias("block"), F.lit(True).alias("core"))
    beside = lambda by, where: F.when(where, F.struct((place + by).alias("block"), F.lit(False).alias("core")))
    all_of = F.array_compact(F.array(home, beside(-1, (into < F.col("span") / 8) & (place > 0)), beside(1, into >= F.col("span") * 7 / 8)))
    rows = (
        cut.withColumn("x", F.explode(F.when(F.col("span").isNull() | F.col("at").isNull(), F.array(home)).otherwise(all_of)))
        # readings without source or time meet no others, so they spread by id
        .select("source", F.when(F.col("source").isNull() | F.col("at").isNull(), -1 - F.pmod(F.xxhash64("bar_id"), F.lit(1024))).otherwise(F.col("x.block")).alias("block"),
                F.coalesce("at", F.lit(0)).alias("t"), F.col("at").isNotNull().alias("timed"), "bar_id", F.col("x.core").alias("core"), "hard", *"ohlcv")
        .repartition("source", "block").sortWithinPartitions("source", "block", "t", "bar_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["source", "block"], 65536):
            out = evaluate(group, threshold)
            if out is not None:
                yield out

    return rows.mapInArrow(run, TABLE)


def implausible_ids(bars: DataFrame, **options) -> DataFrame:
    """bar_id of every flagged reading, once each."""
    return implausible_readings(bars, **options).select("bar_id").distinct()
