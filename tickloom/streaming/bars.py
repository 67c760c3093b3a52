"""Structured Streaming over delivered bars: closed windows, an accepting inbox, exact resumption."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import ensure_checkpoint_dir


def read_bars(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:  # noqa: ANN001
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def closed_windows(stream: DataFrame, minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """OHLCV of tumbling windows, given out only after the watermark has passed a window's end.

    Rows later than the watermark are dropped, repeated deliveries of a bar count once.
    """
    x = stream.where("instrument is not null and ts is not null and c is not null and not isnan(c)").withWatermark("ts", delay)
    once = x.dropDuplicatesWithinWatermark(["bar_id"])
    at = F.struct("ts", "bar_id")
    w = once.groupBy("instrument", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.min_by("o", at).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", at).alias("c"), F.count("*").alias("n_bars"))
    return w.select("instrument", F.unix_seconds("w.start").alias("start"), "o", "h", "l", "c", "n_bars")


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Drain what is there into parquet under the shared folder and read it back; the same checkpoint resumes."""
    spark = stream.sparkSession
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    target, checkpoint = target or f"{base}/table", checkpoint or f"{base}/state"
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def accept_batch(batch: DataFrame, first_session: int, known_until: int | None) -> DataFrame:
    """All or nothing: a delivery is taken only if every row is of a session from ``first_session`` on and
    after everything accepted so far; one early row rejects the whole of it."""
    bad = batch.where((F.col("sday") < first_session) | F.col("sday").isNull() | F.col("tmin").isNull() | (F.lit(known_until is not None) & (F.col("tmin") <= F.lit(known_until or 0)))).limit(1).count()
    if bad:
        raise ValueError("the delivery has rows before the accepted range; nothing of it is taken")
    return batch
