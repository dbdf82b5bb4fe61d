"""Plan helpers: keep an expensive value from being repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from lexicue.session import shared_dir

def staged(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimizer merges neighbouring projections and then repeats an expression at each use; a generator
    is not merged, so later uses read the value.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def materialized(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results used by several branches of one job: they are computed once, their lineage ends, and a
    lost executor only costs a read. The folder is the one the cluster names for checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
