"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; column pruning and filters reach the scan because nothing is cast here."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def no_nan(*columns: str) -> list:
    """Columns with NaN as NULL. Missing is NULL from here on: NaN compares as largest in Spark."""
    return [F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns]
