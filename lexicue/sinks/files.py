"""One file per name, written by the tasks that hold its rows: a Python data source.

Rows are ``name, head, text`` in order. A task streams the texts of a name into a file, so a file may be far larger than memory;
it has one Python worker, which holds an Arrow batch and ROWS of its rows as Python values, whatever the input's size. All
files of a job appear at once: they are written to a staging folder that the commit renames and an abort deletes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "lexicue_named_files"
#: Rows of a batch that are Python values at a time.
ROWS = 256


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, head string, text string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if not overwrite:
            raise ValueError("named files are written in mode overwrite")
        return NamedFilesWriter(self.options["path"].rstrip("/"), self.options.get("between", ""), self.options.get("tail", ""))


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, between: str, tail: str):
        self.path, self.staging, self.between, self.tail = path, f"{path}-staging-{uuid.uuid4().hex}", between, tail

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Texts of a name, one after another. A file gets its own name only when it is whole, so attempts cannot mix."""
        store, folder = _place(self.staging)
        store.create_dir(folder, recursive=True)
        current, out, part, files = None, None, "", 0

        def finish() -> None:
            if out is not None:
                out.write(self.tail.encode())
                out.close()
                store.move(part, f"{folder}/{current}")

        for whole in iterator:
            for at in range(0, whole.num_rows, ROWS):
                for name, head, text in zip(*(c.to_pylist() for c in whole.slice(at, ROWS).columns)):
                    lead = self.between
                    if name != current:
                        finish()
                        current, part, files, lead = name, f"{folder}/_{uuid.uuid4().hex}", files + 1, head
                        out = store.open_output_stream(part)
                    out.write((lead + text).encode())
        finish()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.staging)
        target = _place(self.path)[1]
        store.create_dir(folder, recursive=True)
        if store.get_file_info(target).type != fs.FileType.NotFound:
            store.delete_dir(target)
        store.move(folder, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.staging)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


def write(rows: DataFrame, name: Column, order: list[Column], head: Column, text: Column, between: str, tail: str, path: str) -> None:
    """A file per ``name``: the ``head`` of its first row, the texts in ``order`` with ``between``, and ``tail``.

    ``head`` is the same for all rows of a name. Names are file names; null names are refused.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    named = F.coalesce(name.cast("string"), F.raise_error(F.lit("a file needs a name")).cast("string"))
    keys = [f"__o{i}" for i in range(len(order))]
    ordered = rows.select(named.alias("name"), head.alias("__head"), text.alias("__text"), *[o.alias(k) for o, k in zip(order, keys)])
    ordered = ordered.repartition("name").sortWithinPartitions("name", *keys)
    writer = ordered.select("name", F.col("__head").alias("head"), F.col("__text").alias("text")).write.format(FORMAT)
    writer.option("between", between).option("tail", tail).mode("overwrite").save(path)
