"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexicue.llm.common import materialized


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def labels(edges: DataFrame, hops: int = 4) -> DataFrame:
    """(node, label): the smallest node within ``hops`` edges of every node that has an edge.

    Nodes of one label are connected; connected nodes that lie further apart may have different ones.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
    for _ in range(hops - 1):
        near = both.join(out, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        out = near.select(F.col("a").alias("node"), F.least("a", "least").alias("label"))
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node it is connected to.

    ``edges`` has columns a and b. Nodes are put together by their labels first; few edges are left between labels.
    There large-star and small-star steps alternate until nothing changes: each node's greater neighbours, then its
    smaller ones, are tied to the least of its neighbours. The number of edges does not grow and a path of n nodes
    takes about log n rounds. Each round is written, so a lost executor costs a read; a node's neighbours never meet
    in one row.
    """
    edges = materialized(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    named = materialized(labels(edges))
    ends = edges.join(named.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(
        named.select(F.col("node").alias("b"), F.col("label").alias("y")), "b"
    )
    edges = materialized(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialized(small.select("e.a", "e.b").where("a <> b").distinct())
        was, state = state, _state(edges)
        if state == was:
            break
    roots = edges.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("root"))
    return named.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
