"""Relational scans with an explicit column list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexicue.session import pin_utc


def table(spark: SparkSession, folder: str, name: str, *cols: str) -> DataFrame:
    """Scan one table; only the named columns are read."""
    pin_utc(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*cols) if cols else df
