"""Ordered folds for decisions that depend on an evolving state, over keys of any length.

A key is cut into chunks of its order, and all chunks are folded at once, each as if nothing came before it. The state
that a chunk ends with is the state the next one should have begun with, so borders are folded again: from the true state
beside the empty one, until both are the same. From there on everything is as it was, so only the first results of
a chunk are replaced, and the state it ends with stays. Where the states do not meet in a chunk, its new end goes on to
the next one. Rows are streamed through the fold in sorted order, so memory grows neither with a key nor with a chunk.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexicue.operators.staging import materialized

#: Rows of a chunk kept to fold its border again.
BORDER = 64
#: Times that states are handed on from chunk to chunk before the rest of a key is folded in one go.
ROUNDS = 6
#: Rows handled at a time.
BATCH = 512


class Fold:
    """The rule of a fold: pure steps from state to state. A state is None or made of plain tuples, dicts, numbers and text."""

    def step(self, state, row: dict) -> tuple[object, list[dict]]:
        """The state after ``row``, and the results that are final with it. ``state`` must not be changed."""
        raise NotImplementedError

    def close(self, state) -> list[dict]:
        """The results still open at the end of a key."""
        raise NotImplementedError


def packed(state) -> bytes | None:
    """Equal states, equal bytes: without back references, which depend on what was shared in memory."""
    if state is None:
        return None
    out = io.BytesIO()
    writer = pickle.Pickler(out, 5)
    writer.fast = True
    writer.dump(state)
    return out.getvalue()


def unpacked(state: bytes | None):
    return None if state is None else pickle.loads(state)


class _Table:
    """Collects result rows of several kinds and gives them out as Arrow batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def add(self, key, chunk, kind, pos, row=None, out=None, state=None):
        self.rows.append((key, chunk, kind, pos, row, out, state))

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * len(self.schema)
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, self.schema)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, dict]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            for r in whole.slice(at, BATCH).to_pylist():
                yield (*r["key"].values(), r["part"]), r


def _run(fold: Fold, schema: pa.Schema, border: int):
    """One pass over sorted groups of (key, part); a group may begin with a row that carries its state.

    Kinds of rows given out: ``out`` with the place of the row that made it final, ``border`` for the first rows of a
    chunk, ``met`` with the place after which nothing changes, ``end`` with the rows seen and the state at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, group, g = _Table(schema), None, {}

        def finish():
            if group is not None and not g["met"]:
                table.add(g["key"], g["chunk"], "end", g["pos"], state=packed(g["state"]))

        for here, r in _groups(batches):
            if here != group:
                finish()
                group = here
                g = {"key": r["key"], "chunk": r["chunk"], "pos": 0, "state": None, "twin": None, "again": False, "met": False}
            if r["begins"]:
                g["state"], g["again"] = unpacked(r["state"]), r["twin"]
                continue
            if g["met"]:
                continue
            row, pos = r["row"], g["pos"]
            if pos < border:
                table.add(g["key"], r["chunk"], "border", pos, row=row)
            g["state"], done = fold.step(g["state"], row)
            for out in done:
                table.add(g["key"], r["chunk"], "out", pos, out=out)
            g["pos"], g["chunk"] = pos + 1, r["chunk"]
            if g["again"]:
                g["twin"], _ = fold.step(g["twin"], row)
                if g["twin"] == g["state"]:
                    g["met"] = True
                    table.add(g["key"], g["chunk"], "met", pos)
            if len(table.rows) >= BATCH:
                yield table.batch()
        finish()
        yield table.batch()

    return run


def split_fold(
    df: DataFrame, keys: list[str], order: list[str], fold: Fold, schema: str, chunk: Column | None = None,
    border: int | None = None, rounds: int | None = None,
) -> DataFrame:
    """The results of ``fold`` over each key's rows in ``order``, as if each key were folded row by row.

    ``chunk`` is a whole number that never falls along ``order``; without it a key is one chunk. The order must be total.
    ``schema`` names the columns of the results. ``df`` is read once, and again only for chunks in which
    states do not meet within the first ``border`` rows.
    """
    border, rounds = BORDER if border is None else border, ROUNDS if rounds is None else rounds
    number = F.lit(0).cast("bigint") if chunk is None else F.coalesce(chunk.cast("bigint"), F.lit(-(1 << 62)))
    rows = df.select(
        F.struct(*keys).alias("key"), number.alias("part"), number.alias("chunk"), F.lit(False).alias("begins"),
        F.lit(False).alias("twin"), F.lit(None).cast("binary").alias("state"), F.struct(*df.columns).alias("row"),
    )
    key_type, row_type = (rows.schema[c].dataType.simpleString() for c in ("key", "row"))
    out_type = f"struct<{StructType.fromDDL(schema).simpleString()[7:-1]}>"
    result = f"key {key_type}, chunk bigint, kind string, pos bigint, row {row_type}, out {out_type}, state binary"
    arrow = to_arrow_schema(StructType.fromDDL(result))

    def fold_all(rows: DataFrame, keep: int) -> DataFrame:
        ordered = rows.repartition("key", "part").sortWithinPartitions(
            "key", "part", F.desc("begins"), "chunk", *[F.col("row")[o] for o in order]
        )
        return ordered.mapInArrow(_run(fold, arrow, keep), result)

    def starting(pending: DataFrame, twin: bool) -> DataFrame:
        empty = F.lit(None).cast(row_type).alias("row")
        return pending.select("key", "part", "chunk", F.lit(True).alias("begins"), F.lit(twin).alias("twin"), F.col("came").alias("state"), empty)

    first = materialized(fold_all(rows, border if chunk is not None else 0))
    if chunk is None:
        return _opened(first.where("kind = 'out'").select("out").union(_closed(first.where("kind = 'end'"), fold, arrow, result)), schema)
    # a chunk: its rows, the state it was folded from and ends with, and the place up to which ``round`` replaced its results
    chunks = first.where("kind = 'end'").select(
        "key", "chunk", F.col("pos").alias("n"), F.col("state").alias("plain_end"), F.lit(None).cast("binary").alias("used"),
        F.col("state").alias("ends"), F.lit(-1).cast("bigint").alias("upto"), F.lit(0).alias("round"),
    )
    before = W.partitionBy("key").orderBy("chunk")
    again: list[DataFrame] = []

    def waiting(chunks: DataFrame) -> DataFrame:
        came = chunks.withColumn("came", F.lag("ends").over(before))
        return came.where(~F.col("came").eqNullSafe(F.col("used"))).select("key", F.col("chunk").alias("part"), "chunk", "came")

    def settle(chunks: DataFrame, pending: DataFrame, done: DataFrame, n: int) -> DataFrame:
        """Take over what a round found for the chunks it could finish."""
        news = done.where("kind IN ('met', 'end')").select("key", "chunk", F.col("kind").alias("how"), F.col("pos").alias("at"), F.col("state").alias("new"))
        joined = chunks.join(pending.select("key", "chunk", "came"), ["key", "chunk"], "left").join(news, ["key", "chunk"], "left")
        met, whole = F.col("how").eqNullSafe("met"), F.col("how").eqNullSafe("end") & (F.col("at") == F.col("n"))
        ok = met | whole
        return materialized(joined.select(
            "key", "chunk", "n", "plain_end", F.when(ok, F.col("came")).otherwise(F.col("used")).alias("used"),
            F.when(met, F.col("plain_end")).when(whole, F.col("new")).otherwise(F.col("ends")).alias("ends"),
            F.when(ok, F.col("at")).otherwise(F.col("upto")).alias("upto"), F.when(ok, n).otherwise(F.col("round")).alias("round"),
        ))

    for n in range(1, rounds + 1):
        pending = materialized(waiting(chunks))
        if pending.isEmpty():
            break
        if n == 1:
            source = first.where("kind = 'border'").select(
                "key", F.col("chunk").alias("part"), "chunk", F.lit(False).alias("begins"), F.lit(False).alias("twin"), F.lit(None).cast("binary").alias("state"), "row"
            )
        else:
            source = rows
        source = source.join(pending.select("key", "part"), ["key", "part"], "left_semi").select(*rows.columns)
        done = materialized(fold_all(source.unionByName(starting(pending, True)), 0))
        again.append(done.where("kind = 'out'").select("key", "chunk", F.lit(n).alias("made"), "out"))
        chunks = settle(chunks, pending, done, n)
    else:
        pending = materialized(waiting(chunks))
        if not pending.isEmpty():
            # states that meet nowhere: what is left of these keys goes in one pass each
            heads = pending.groupBy("key").agg(F.min("chunk").alias("from"), F.min_by("came", "chunk").alias("came"))
            rest = rows.join(heads.select("key", "from"), "key").where("chunk >= from").withColumn("part", F.col("from")).select(*rows.columns)
            done = materialized(fold_all(rest.unionByName(starting(heads.select("key", F.col("from").alias("part"), F.col("from").alias("chunk"), "came"), False)), 0))
            again.append(done.where("kind = 'out'").select("key", "chunk", F.lit(rounds + 1).alias("made"), "out"))
            ends = done.where("kind = 'end'").select("key", F.col("state").alias("new"))
            chunks = materialized(
                chunks.join(heads.select("key", "from"), "key", "left").join(ends, "key", "left").select(
                    "key", "chunk", *[F.when(F.col("chunk") >= F.col("from"), v).otherwise(F.col(c)).alias(c) for c, v in (("ends", F.col("new")), ("upto", F.lit(1 << 62)), ("round", F.lit(rounds + 1)))]
                )
            )
    kept = first.where("kind = 'out'").join(chunks.where("upto >= 0").select("key", "chunk", "upto"), ["key", "chunk"], "left")
    outs = kept.where("upto IS NULL OR pos > upto").select("out")
    for done in again:
        mine = done.join(chunks.select("key", "chunk", F.col("round").alias("made")), ["key", "chunk", "made"], "left_semi")
        outs = outs.union(mine.select("out"))
    last = chunks.groupBy("key").agg(F.max_by(F.struct("ends"), "chunk").alias("e"), F.max("chunk").alias("chunk"))
    ends = last.select("key", "chunk", F.col("e.ends").alias("state"))
    return _opened(outs.union(_closed(ends, fold, arrow, result)), schema)


def _closed(ends: DataFrame, fold: Fold, arrow: pa.Schema, result: str) -> DataFrame:
    """The results open at the end of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(arrow)
        for b in batches:
            for r in b.to_pylist():
                for out in fold.close(unpacked(r["state"])):
                    table.add(r["key"], r["chunk"], "out", 0, out=out)
            yield table.batch()

    return ends.where("state IS NOT NULL").select("key", "chunk", "state").mapInArrow(run, result).select("out")


def _opened(outs: DataFrame, schema: str) -> DataFrame:
    return outs.select(*[F.col("out")[f.name].alias(f.name) for f in StructType.fromDDL(schema)])
