"""Chunked scans equal plain windows; as-of lookups equal a loop."""

import random

import pytest
from pyspark.sql import functions as F

from lexicue.operators.scans import Look, asof, chunk_of, islands, row_numbers, scan


def rows(seed, n=300, keys=4, span=500):
    r = random.Random(seed)
    # key 0 holds most rows
    return [(0 if r.random() < 0.6 else r.randrange(keys), r.randrange(span), i, r.choice([None, 1, 2, 3])) for i in range(n)]


def looks():
    return [
        Look("last_in", F.col("v")),
        Look("last_ex", F.col("v"), inclusive=False),
        Look("next_ex", F.col("v"), ahead=True, inclusive=False),
        Look("total", F.coalesce("v", F.lit(0)), "sum"),
        Look("total_ex", F.coalesce("v", F.lit(0)), "sum", inclusive=False),
        Look("high", F.col("v"), "max"),
        Look("low_ahead", F.col("v"), "min", ahead=True),
    ]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_scan_matches_plain_window(spark, seed, width):
    df = spark.createDataFrame(rows(seed), "k int, t int, id int, v int")
    plain = scan(df, ["k"], ["t", "id"], looks())
    cut = scan(df, ["k"], ["t", "id"], looks(), chunk_of(F.col("t"), width))
    as_ints = lambda d: sorted([tuple(None if x is None else int(x) for x in r) for r in d.select(*plain.columns).collect()], key=lambda r: r[2])
    assert as_ints(plain) == as_ints(cut)


@pytest.mark.parametrize("width", [5, 60])
def test_islands_match_plain_window(spark, width):
    df = spark.createDataFrame(rows(7), "k int, t int, id int, v int").na.fill(0)
    changed = lambda p, c: p["v"] != c["v"]
    plain = islands(df, ["k"], ["t", "id"], ["v"], changed)
    cut = islands(df, ["k"], ["t", "id"], ["v"], changed, chunk_of(F.col("t"), width))
    key = lambda d: sorted((r.id, int(r.island)) for r in d.collect())
    assert key(plain) == key(cut)


def test_row_numbers(spark):
    df = spark.createDataFrame(rows(3), "k int, t int, id int, v int")
    out = row_numbers(df, ["k"], ["t", "id"], "n", chunk_of(F.col("t"), 20)).collect()
    for k in {r.k for r in out}:
        mine = sorted((r for r in out if r.k == k), key=lambda r: (r.t, r.id))
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof(spark, seed, direction, strict):
    r = random.Random(seed)
    points = [(r.randrange(3), r.randrange(60), i) for i in range(80)]
    targets = [(r.randrange(3), r.randrange(60), i) for i in range(30)]
    out = asof(
        spark.createDataFrame(points, "k int, at int, p int"), spark.createDataFrame(targets, "k int, t int, x int"),
        ["k"], "at", "t", ["x"], {"hit": (direction, strict)}, "x", 9,
    )
    got = {row.p: (row.hit.x if row.hit else None) for row in out.collect()}

    def best(k, at):
        if direction == "backward":
            ok = [(-t, x) for kk, t, x in targets if kk == k and (t < at or (t == at and not strict))]
        else:
            ok = [(t, x) for kk, t, x in targets if kk == k and (t > at or (t == at and not strict))]
        return min(ok)[1] if ok else None

    assert got == {p: best(k, at) for k, at, p in points}


def test_null_keys_stop_a_chunked_scan(spark):
    df = spark.createDataFrame([(None, i) for i in range(3)], "k bigint, t bigint")
    assert [r.n for r in row_numbers(df, ["k"], ["t"], "n").orderBy("t").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="null in key k"):
        row_numbers(df, ["k"], ["t"], "n", F.col("t")).collect()
