"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexicue.operators.staging import materialized  # noqa: F401  re-exported


def read(spark: SparkSession, folder: str, name: str, *cols: str) -> DataFrame:
    """Scan one table through Spark's reader; only the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*cols) if cols else df


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text (0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value`` once.

    A plain expression used several times, above all inside a lambda, would be worked out at each use.
    """
    return F.transform(F.array(value), body)[0]


def chunks_for(rows: int, most: int = 200_000) -> int:
    """Parts to number a key of ``rows`` rows in, so that a part has about ``most`` rows."""
    return max(16, -(-rows // most))


def ranked(df: DataFrame, keys: list[str], draw: Column, name: str, chunks: int) -> DataFrame:
    """Add ``name``: a gapless 0-based rank of each row within its key, in the order of ``draw``.

    ``draw`` is a long that spreads evenly over the 64-bit range (a hash). Its leading bits cut each key into
    ``chunks`` parts that are numbered alone; the parts' counts, keys x chunks rows, give the offsets and are
    broadcast. No key meets in one task, however hot it is. Rows of equal draw keep any order among
    themselves. ``draw`` must depend on the row alone, as ``df`` is read twice.
    """
    cut = df.withColumn("_draw", draw).withColumn(
        "_part", F.floor((F.shiftrightunsigned(F.col("_draw"), 11) / F.lit(float(1 << 53))) * chunks).cast("int")
    )
    group = [*keys, "_part"]
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy(*group).agg(F.count("*").alias("_n")).select(
        *[F.col(k).alias(f"_r_{k}") for k in group], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    numbered = cut.withColumn("_row", F.row_number().over(W.partitionBy(*group).orderBy("_draw")))
    same = F.lit(True)
    for k in group:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return numbered.join(F.broadcast(offsets), same, "left").withColumn(name, F.col("_before") + F.col("_row") - 1).drop(
        "_draw", "_part", "_row", "_before", *[f"_r_{k}" for k in group]
    )


def rows_of(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small table of known size from the driver, as one constant."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")))
