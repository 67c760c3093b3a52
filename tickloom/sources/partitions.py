"""Session-range partitions: every row in exactly one, rows accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (name, first session, last session) of the default split.
RANGES = (("discovery", 0, 15344), ("validation", 15345, 15347), ("audit", 15348, 99999))


def with_partition(df: DataFrame, ranges: tuple[tuple[str, int, int], ...] = RANGES, day: str = "sday") -> DataFrame:
    """Rows with their range's name in ``part``; rows outside all ranges are left out."""
    name = None
    for part, low, high in ranges:
        here = F.col(day).between(low, high)
        name = F.when(here, part) if name is None else name.when(here, part)
    return df.withColumn("part", name).where("part is not null")


def write_partitions(df: DataFrame, path: str, ranges: tuple[tuple[str, int, int], ...] = RANGES) -> dict[str, int]:
    """Write one folder for each range and check that rows add up; returns the counts."""
    placed = with_partition(df, ranges)
    if placed.count() != df.count():
        raise ValueError("rows outside all ranges: the partitions do not add up to the source")
    placed.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(placed.schema).parquet(path)
    return {r.part: r.n for r in written.groupBy("part").agg(F.count("*").alias("n")).collect()}


def read_partition(spark, path: str, part: str, first: int, last: int, columns: list[str], day: str = "sday") -> DataFrame:  # noqa: ANN001
    """One range's sessions and columns; partition, filter and columns all reach the scan."""
    return spark.read.parquet(path).where((F.col("part") == part) & F.col(day).between(first, last)).select(*columns)
