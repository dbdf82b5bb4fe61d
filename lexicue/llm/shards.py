"""Sharding by a hypergeometric communication matrix.

A uniform random deal of all rows into shards of exact sizes, in two local steps: how many rows go from each part
to each shard is drawn first, as one matrix; then each part permutes its rows and cuts them by its row of the
matrix, and each shard permutes what it got.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from lexicue.llm.common import chunks_for, materialized, ranked, rows_of

SEED = 20_26
#: numpy draws exactly below this population; above it the distribution is inverted here.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn without replacement.

    Large populations are drawn by inversion over twelve standard deviations around the mode; what lies outside
    is below the precision of a double.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    total = good + bad
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    sd = math.sqrt(n * (good / total) * (bad / total) * (total - n) / (total - 1))
    mode = (n + 1) * (good + 1) // (total + 2)
    low, high = max(0, n - bad, mode - int(12 * sd) - 12), min(n, good, mode + int(12 * sd) + 12)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max()).cumsum()
    return low + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each part to each shard; rows sum to the parts, columns to the shards, uniform among deals."""
    rng = np.random.default_rng(seed)
    left, matrix = list(shards), []
    for size in parts:
        row, rest, n = [], sum(left), size
        for j, room in enumerate(left):
            rest -= room
            take = hypergeometric(rng, room, rest, n)
            row.append(take)
            left[j] -= take
            n -= take
        matrix.append(row)
    return matrix


def deal(
    docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = SEED, part_rows: int = 100_000
) -> DataFrame:
    """Every row's shard and its slot there, gapless from 0; shard sizes differ by one row at most.

    The text goes no further than its size and checksum. Parts are groups of input rows by hash of their place,
    about ``part_rows`` each, so that none is hot; the driver gets parts x shards numbers. Null texts have no
    bytes. Repeated rows are rows of their own, null ids rows like others, an empty table gives an empty result.
    Rows keep the place they were read from in a written table, so a lost executor changes nothing.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    small = materialized(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_seq"),
    ))
    total = small.count()
    n_parts = max(64, -(-total // part_rows))
    cut = small.withColumn("_from", F.pmod(F.xxhash64("_seq", F.lit(seed)), F.lit(n_parts)).cast("int"))
    counts = {r["_from"]: r["n"] for r in cut.groupBy("_from").agg(F.count("*").alias("n")).collect()}
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts.get(i, 0) for i in range(n_parts)], sizes, seed)
    plan = rows_of(
        docs.sparkSession, [{"_to": i, "_ends": np.cumsum(row).tolist()} for i, row in enumerate(matrix)], "_to int, _ends array<bigint>"
    )
    local = W.partitionBy("_from").orderBy(F.xxhash64("_seq", F.lit(seed + 1)))
    sent = (
        cut.withColumn("_place", F.row_number().over(local) - 1)
        .join(F.broadcast(plan), F.col("_from") == F.col("_to"))
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))).cast("int"))
    )
    chunks = chunks_for(total // n_shards + 1, part_rows)
    dealt = ranked(sent.drop("_from", "_to", "_ends", "_place"), ["shard"], F.xxhash64("_seq", F.lit(seed + 2)), "slot", chunks)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
