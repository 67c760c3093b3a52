"""Streaming queries, drained from the tables' files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.registry import Registry
from tickloom.sources.tables import table
from tickloom.streaming import bars as s

REGISTRY = Registry()


SQL = """
with x as (select instrument, ts, any_value(o) as o, any_value(h) as h, any_value(l) as l, any_value(c) as c, bar_id from bars where instrument is not null and ts is not null and c is not null and not isnan(c) group by instrument, ts, bar_id)
select instrument, epoch_us(ts) // 3600000000 * 3600 as start, arg_min(o, (ts, bar_id)) as o, max(h) as h, min(l) as l, arg_max(c, (ts, bar_id)) as c, count(*) as n_bars
from x group by 1, 2 having (start + 3600) * 1000000 <= (select max(epoch_us(ts)) - 2 * 86400000000 from x)"""


@REGISTRY.add("stream_closed_windows", SQL)
def stream_closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The closed hours of the delivered bars: those that end two days or more before the latest one.

    The files are in no order of time, so all that is there is one trigger and nothing of it is late."""
    path = f"{folder}/bars.parquet"
    schema = table(spark, folder, "bars").schema
    source = path if os.path.isdir(path) else f"{folder}/bars.parquet*"
    stream = s.closed_windows(s.read_bars(spark, source, schema), 60, "2 days")
    return s.run_to_table(stream, "windows")
