"""Hard negatives by integer products of anchors and candidates, multiplied by Strassen's scheme.

Anchors go in blocks of bounded size, each broadcast once for two passes over all rows. A task multiplies tiles of its rows
with the block and keeps, per anchor, a heap of the best positives; merged, they give the windows of the second pass,
in which every task keeps a heap per window. Heaps of different tasks merge by order, so no task sees all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexicue.llm.common import materialized
from lexicue.session import shared_dir

#: Anchors per block on average, and per tile; candidates per tile.
BLOCK, TILE, ROWS = 8192, 256, 1024
#: Parts of the tasks' heaps that are merged before they meet per anchor.
PARTS = 64
#: Below this many rows, columns or terms a product is taken directly.
LEAF = 32
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices: seven products of quarters in place of eight, down to small leaves.

    Odd sides are padded with zeros. Sums of quarters may pass 64 bits and wrap; as all is a ring modulo 2^64, the
    result is exact wherever the true product fits.
    """
    rows, inner, cols = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, cols) <= LEAF:
        return a @ b
    r, k, c = (-(-x // 2) for x in (rows, inner, cols))
    if rows % 2 or inner % 2:
        a = np.pad(a, ((0, 2 * r - rows), (0, 2 * k - inner)))
    if inner % 2 or cols % 2:
        b = np.pad(b, ((0, 2 * k - inner), (0, 2 * c - cols)))
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    p4, p5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out[:rows, :cols]


class Heaps:
    """For each of many keys the ``keep`` first of (score falling, id rising, row rising), filled tile by tile."""

    def __init__(self, keys: int, keep: int):
        self.keep = keep
        #: the last place of a key, which a newcomer must precede; NONE while there is room
        self.score, self.id = np.full(keys, NONE), np.full(keys, NONE)
        self.rows = [np.zeros(0, np.int64)] * 4

    def add(self, fits: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Take in the fitting ones of ``score`` (keys x rows of a tile)."""
        last = self.score[:, None]
        # equal ids pass and are told apart by their row below
        early = (score > last) | ((score == last) & (ids <= self.id[:, None])) | (last == NONE)
        i, j = np.nonzero(fits & early)
        if not len(i):
            return
        rows = [np.concatenate(x) for x in zip(self.rows, (i, score[i, j], ids[j], row[j]))]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        key = rows[0][order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        self.rows = [x[order][place < self.keep] for x in rows]
        full = np.flatnonzero(place == self.keep - 1)
        self.score[key[full]], self.id[key[full]] = rows[1][order][full], rows[2][order][full]


def prepared(vectors: DataFrame, key: str, label: str, vector: str, scale: int, noise: Column | None) -> DataFrame:
    """(row, id, label, v) of the rows that take part: whole components, a number per row, ``noise`` in place of the label."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return materialized(
        vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
            F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"),
            (F.col(label) if noise is None else noise).cast("long").alias("label"), whole.alias("v"),
        )
    )


def tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows, ids, labels and the matrix (a column per row, zeros below shorter vectors) of at most ROWS rows at a time.

    A null id becomes the largest number, so that it comes last among equal scores.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            yield b.column(0).to_numpy(), b.column(1).fill_null(np.iinfo(np.int64).max).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3), width).T


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def merged(found: DataFrame, keys: list[str], keep: int, name: str) -> DataFrame:
    """The first ``keep`` of each key over all tasks' heaps, in parts first."""
    order = [F.desc("score"), F.asc_nulls_last("id"), "row"]
    first = lambda df, by: df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= keep)
    parted = found.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(PARTS)))
    return first(first(parted, [*keys, "_part"]).drop("_part", name), keys)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    key: str = "vec_id", label: str = "label", vector: str = "embedding", noise: Column | None = None,
) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of another label with a score from ``low`` to ``high`` percent of the positive's.

    ``anchors`` is a condition on the id, here named ``id``; ``noise`` replaces the label where given. Components are taken times
    ``scale`` and rounded down. Higher scores come first, ties by smaller id, null ids last, then in any fixed order. Rows
    with a null label, a null vector, or a null or non-finite component take no part. Repeated rows are rows of their own: a
    copy of an anchor is an anchor and a positive of the other. Vectors of different lengths are filled up with zeros.
    Scores must fit in 56 bits, or the job stops by name. An empty table, or one without anchors, gives no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, key, label, vector, scale, noise)
    chosen = rows.where(F.coalesce(anchors, F.lit(False)))
    width, most = rows.agg(F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    if width and most is not None and (most >= 1 << 56 or width * most * most >= 1 << 56):
        raise ValueError("inner products of these vectors may pass 56 bits")
    count = chosen.count()
    chosen = materialized(chosen.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(-(-count // BLOCK) or 1)).cast("int")))
    folder = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    blocks = [r[0] for r in chosen.select("block").distinct().orderBy("block").collect()]
    for block in blocks:
        table = chosen.where(F.col("block") == block).drop("block").orderBy("row").toArrow().combine_chunks()
        part = one_block(spark, rows, table, width or 0, positives, negatives, low, high)
        part.write.parquet(f"{folder}/{block}")
    return spark.read.schema(schema).parquet(*[f"{folder}/{b}" for b in blocks]) if blocks else spark.createDataFrame([], schema)


def one_block(spark, rows: DataFrame, table: pa.Table, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    a_row, a_id, a_label = (table.column(i).to_numpy() for i in range(3))
    v = table.column(3)
    a = matrix(v.chunk(0) if v.num_chunks else pa.array([], v.type), width)
    sent = spark.sparkContext.broadcast((a_row, a_label, a))

    def best_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_row, a_label, a = sent.value
        cuts = [slice(at, min(at + TILE, len(a))) for at in range(0, len(a), TILE)]
        heaps = [Heaps(cut.stop - cut.start, positives) for cut in cuts]
        for row, ids, labels, c in tiles(batches, width):
            for cut, heap in zip(cuts, heaps):
                score = strassen(a[cut], c)
                heap.add((a_label[cut, None] == labels) & (a_row[cut, None] != row), score, ids, row)
        yield as_batch([cut.start for cut in cuts], heaps)

    heads = merged(rows.mapInArrow(best_positives, "key long, score long, id long, row long"), ["key"], positives, "place")
    # at most BLOCK x positives numbers
    heads = heads.select("key", "place", "score", "id").toArrow().sort_by([("key", "ascending"), ("place", "ascending")])
    w_key, w_score = heads["key"].to_numpy(), heads["score"].to_numpy()
    windows = spark.sparkContext.broadcast((w_key, w_score))

    def window_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, a_label, a), (w_key, w_score) = sent.value, windows.value
        # low * p <= 100 * n <= high * p
        floor, ceiling = -(-low * w_score // 100), high * w_score // 100
        cuts = [slice(at, min(at + TILE, len(a))) for at in range(0, len(a), TILE)]
        # the windows of TILE anchors, in parts of at most TILE
        parts = [
            [slice(w, min(w + TILE, last)) for w in range(first, last, TILE)]
            for first, last in (np.searchsorted(w_key, (cut.start, cut.stop)).tolist() for cut in cuts)
        ]
        heaps = [[Heaps(w.stop - w.start, negatives) for w in ws] for ws in parts]
        for row, ids, labels, c in tiles(batches, width):
            for cut, ws, hs in zip(cuts, parts, heaps):
                score = strassen(a[cut], c)
                other = a_label[cut, None] != labels
                for w, heap in zip(ws, hs):
                    of = w_key[w] - cut.start
                    own = score[of]
                    heap.add((own >= floor[w, None]) & (own <= ceiling[w, None]) & other[of], own, ids, row)
        yield as_batch([w.start for ws in parts for w in ws], [h for hs in heaps for h in hs])

    found = merged(rows.mapInArrow(window_negatives, "key long, score long, id long, row long"), ["key"], negatives, "rank")
    names = spark.createDataFrame(
        [(n, int(a_id[k]), i, int(s)) for n, (k, i, s) in enumerate(zip(w_key, heads["id"].to_pylist(), w_score))],
        "key long, anchor_id long, positive_id long, positive_score long",
    )
    return found.join(names, "key").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def as_batch(starts: list[int], heaps: list[Heaps]) -> pa.RecordBatch:
    """All heaps of a task as rows; a heap's keys count from its start."""
    none = [np.zeros(0, np.int64)]
    key, score, ids, row = (
        np.concatenate(none + [h.rows[k] + (at if k == 0 else 0) for at, h in zip(starts, heaps)]) for k in range(4)
    )
    lost = ids == np.iinfo(np.int64).max
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(score), pa.array(ids, mask=lost), pa.array(row)], names=["key", "score", "id", "row"])


#: DuckDB over ``embeddings`` for the rows of the registered query.
SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
