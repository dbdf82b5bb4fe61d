"""Stored tables: batches that come again, buckets left alone, writes that fail before the switch."""

import pytest
from pyspark.sql import functions as F

from lexicue.sinks import stored

SCHEMA = "id bigint, at bigint, v string"


def test_batches_apply_once_and_touch_only_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "ROWS", 10)
    t = stored.StoredTable(spark, str(tmp_path / "t"), ["id"], SCHEMA)
    assert t.read().count() == 0
    first = spark.range(100).select("id", F.lit(1).cast("bigint").alias("at"), F.lit("a").alias("v"))
    assert t.put_latest(5, first, F.col("at")) and not t.put_latest(5, first, F.col("at")) and not t.put_latest(4, first, F.col("at"))
    before = t.state()
    assert before["buckets"] == 10 and len(before["folders"]) == 10
    assert t.put_latest(6, spark.createDataFrame([(7, 2, "b"), (7, 0, "old")], SCHEMA), F.col("at"))
    after = t.state()
    assert sum(before["folders"][b] != after["folders"][b] for b in before["folders"]) == 1
    assert {(r.id, r.v) for r in t.read().collect()} == {(i, "b" if i == 7 else "a") for i in range(100)}
    assert t.read().count() == 100


def test_a_batch_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    t = stored.StoredTable(spark, str(tmp_path / "t"), ["id"], SCHEMA)
    t.append(0, spark.createDataFrame([(1, 1, "a")], SCHEMA))
    bad = spark.createDataFrame([(2, 2, "b")], SCHEMA).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        t.append(1, bad)
    assert [tuple(r) for r in t.read().collect()] == [(1, 1, "a")]
    t.append(1, spark.createDataFrame([(2, 2, "b")], SCHEMA))
    assert t.read().count() == 2
