"""A stored table that batches are merged into, each exactly once.

Rows lie in buckets by a hash of their key. A batch rewrites only the buckets it touches, into a folder of its own; at the end one
small file, which names the folder of each bucket and the last batch, is put in place of the old one. Until then readers see
the state before, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexicue.operators import tables as Tb

CURRENT = "_current.json"
#: Rows of a bucket that the first batch's size asks for, and the most buckets.
ROWS, MOST = 1_000_000, 4096


class StoredTable:
    """A keyed table below ``path``. ``schema`` is that of its rows; the number of buckets is set by the first batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self.store, self.folder = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def state(self) -> dict:
        """Last batch, number of buckets and the folder of each bucket that has rows."""
        name = f"{self.folder}/{CURRENT}"
        if self.store.get_file_info(name).type == fs.FileType.NotFound:
            return {"batch": None, "buckets": 0, "folders": {}}
        with self.store.open_input_stream(name) as f:
            return json.loads(f.read())

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._read(list(self.state()["folders"].values()))

    def apply(self, batch: int, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replace the touched buckets by ``merge(stored rows, changes)``; false for a batch that was applied before.

        Batch numbers rise. ``merge`` keeps the keys of rows apart and returns the table's columns.
        """
        state = self.state()
        if state["batch"] is not None and batch <= state["batch"]:
            return False
        n = state["buckets"] or min(MOST, max(1, -(-changes.count() // ROWS)))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")
        touched = [r[0] for r in changes.select(bucket.alias("b")).distinct().collect()]  # at most MOST numbers
        before = [f for b in touched if (f := state["folders"].get(str(b)))]
        columns = [c.name for c in self.spark.createDataFrame([], self.schema).schema]
        version = f"v{batch}-{uuid.uuid4().hex}"
        rows = merge(self._read(before), changes).select(*columns, bucket.alias("bucket"))
        rows.repartition("bucket").write.option("maxRecordsPerFile", 5_000_000).partitionBy("bucket").parquet(f"{self.path}/{version}")
        written = {i.base_name.split("=")[1] for i in self.store.get_file_info(fs.FileSelector(f"{self.folder}/{version}")) if "=" in i.base_name}
        folders = {b: f for b, f in state["folders"].items() if int(b) not in touched} | {b: f"{version}/bucket={b}" for b in written}
        part = f"{self.folder}/_{uuid.uuid4().hex}"
        with self.store.open_output_stream(part) as f:
            f.write(json.dumps({"batch": batch, "buckets": n, "folders": folders}).encode())
        self.store.move(part, f"{self.folder}/{CURRENT}")
        return True

    def put_latest(self, batch: int, changes: DataFrame, order: Column) -> bool:
        """Last write wins: of all rows of a key that of the greatest ``order`` stays."""
        return self.apply(batch, changes, lambda old, new: Tb.latest(old.unionByName(new), self.keys, order))

    def append(self, batch: int, rows: DataFrame) -> bool:
        """Add rows to a log; its keys may repeat."""
        return self.apply(batch, rows, lambda old, new: old.unionByName(new))

    def set_fields(self, batch: int, changes: DataFrame, fields: dict[str, str], order: Column) -> bool:
        """Rows of ``changes`` are (keys, ``field``, ``value``): the last value of each named field replaces that of its column.

        ``fields`` gives the type of each column that may be set. Keys without a stored row change nothing.
        """
        picked = [
            F.max_by(F.struct(F.col("value").try_cast(kind).alias("v")), F.when(F.col("field") == name, order)).alias(f"__{name}") for name, kind in fields.items()
        ]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            last = new.groupBy(*self.keys).agg(*picked)
            joined = old.join(last, self.keys, "left")
            return joined.select(*[
                F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}")["v"]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns
            ])

        return self.apply(batch, changes, merge)
