"""Fixed dimensions of a few rows, as local relations whose size the optimizer knows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def fixed(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A table of constants. Its rows are code, not data, so it may always be broadcast."""
    return spark.createDataFrame(pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)}))


def known(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Add the columns of a fixed dimension by ``key``; a value that it lacks, or a null, stops the job.

    The key itself is checked before the join, where no later filter can drop the row first.
    """
    names = [r[0] for r in dimension.select(key).collect()]  # constants, no job
    unknown = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    checked = F.when(F.col(key).isin(names), F.col(key)).otherwise(unknown.cast(rows.schema[key].dataType))
    return rows.withColumn(key, checked).join(F.broadcast(dimension), key)
