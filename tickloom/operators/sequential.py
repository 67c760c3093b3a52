"""State that depends on the path: NumPy kernels over whole groups, from sorted Arrow batches.

A kernel gets one group's columns as arrays in order and gives the output's columns. Groups
(session and contract of an instrument, or a candidate's trades of a group) are bounded by time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tickloom.operators.grid import whole_groups
from tickloom.operators.windows import GROUP

Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None]


def by_group(df: DataFrame, kernel: Kernel, schema: str, *, keys: tuple[str, ...] = GROUP, order: tuple[str, ...] = ("tmin",), partitions: int | None = None) -> DataFrame:
    """Apply ``kernel`` to each group of ``keys`` in ``order``. NULL arrives as NaN in double columns."""
    out: StructType = _parse_datatype_string(schema)
    names, arrow = [f.name for f in out], to_arrow_schema(out)
    placed = (df.repartition(partitions, *keys) if partitions else df.repartition(*keys)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, list(keys), 32768):
            columns = {c: table[c].to_numpy() for c in table.column_names}
            change = np.zeros(table.num_rows, bool)
            for k in keys:
                codes = table[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.r_[0, np.flatnonzero(change)]
            made = []
            for a, b in zip(starts, np.r_[starts[1:], table.num_rows], strict=True):
                got = kernel({c: x[a:b] for c, x in columns.items()})
                if got is not None:
                    made.append(got)
            if made:
                joined = [np.concatenate([g[n] for g in made]) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type, from_pandas=True) for x, f in zip(joined, arrow, strict=True)], schema=arrow)

    return placed.mapInArrow(run, schema)


def ewm(x: np.ndarray, span: float, min_obs: int | None = None) -> np.ndarray:
    """Exponential mean seeded by the first finite value; missing values carry it on."""
    alpha, need = 2.0 / (span + 1.0), max(2, int(span) // 2) if min_obs is None else min_obs
    out, state, n = np.full(len(x), np.nan), np.nan, 0
    for i, value in enumerate(x.tolist()):
        if value == value:
            state = value if n == 0 else state + alpha * (value - state)
            n += 1
        if n >= need:
            out[i] = state
    return out


def cusum(x: np.ndarray, drift: float, level: float) -> np.ndarray:
    """+1 or -1 at the first alarm of either side of a two-sided CUSUM, else 0; restarts after an alarm."""
    out, up, down = np.zeros(len(x), np.int8), 0.0, 0.0
    for i, value in enumerate(x.tolist()):
        if value != value:
            continue
        up, down = max(0.0, up + value - drift), max(0.0, down - value - drift)
        if up >= level or down >= level:
            out[i] = 1 if up >= level else -1
            up = down = 0.0
    return out


def technical_ewm(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """RSI, MACD histogram over the usual deviation, ADX with the difference of directions, and the Keltner position."""
    c, h, l = g["c"], g["h"], g["l"]  # noqa: E741
    with np.errstate(all="ignore"):
        step = lambda x: np.nan_to_num(np.diff(x, prepend=np.nan))
        d, up, down, prev = step(c), step(h), -step(l), np.r_[np.nan, c[:-1]]
        tr = np.fmax(h, prev) - np.fmin(l, prev)
        smooth = lambda x: ewm(x, 27, 14)
        gain, loss, atr = smooth(np.maximum(d, 0)), smooth(np.maximum(-d, 0)), smooth(tr)
        macd = ewm(c, 12, 26) - ewm(c, 26, 26)
        plus, minus = (100 * smooth(np.where((a > b) & (a > 0), a, 0.0)) / atr for a, b in ((up, down), (down, up)))
        dx = np.where(plus + minus > 0, 100 * np.abs(plus - minus) / (plus + minus), np.nan)
        over = lambda a, b: np.where(b > 0, a / b, np.nan)
        return {
            "instrument": g["instrument"], "tmin": g["tmin"], "rsi_14": 100 * over(gain, gain + loss), "macd_hist": over(macd - ewm(macd, 9, 9), c * g["sig1"]), "adx_14": smooth(dx),
            "di_diff_14": plus - minus, "keltner_pos": over(c - ewm(c, 20, 20), 2 * ewm(tr, 20, 20)),
        }


TECHNICAL = "instrument string, tmin bigint, rsi_14 double, macd_hist double, adx_14 double, di_diff_14 double, keltner_pos double"
