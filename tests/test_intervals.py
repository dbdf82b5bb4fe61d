"""Interval lookups against loops over random, overlapping segments."""

import random

import pytest
from pyspark.sql import functions as F

from lexicue.operators import intervals as I


@pytest.fixture(params=range(3))
def data(request, spark):
    r = random.Random(request.param)
    segs = []
    for v in range(3):
        starts = sorted(r.randrange(400) for _ in range(14))
        segs += [(v, i, s, s + r.choice([0, 1, 5, 30, 120])) for i, s in enumerate(starts)]
    points = [(v, v * 1000 + i, r.randrange(520)) for v in range(3) for i in range(60)]
    return (
        spark.createDataFrame(points, "video int, p int, at int"),
        spark.createDataFrame(segs, "video int, seg_idx int, start_ms int, end_ms int"), points, segs,
    )


@pytest.mark.parametrize("width", [None, 17])
def test_covering(data, width):
    p, s, points, segs = data
    got = {r.p: r.segment.seg_idx if r.segment else None for r in I.covering(p, s, ["video"], "at", chunk_width=width).collect()}
    want = {i: next((x[1] for x in segs if x[0] == v and x[2] <= at < x[3]), None) for v, i, at in points}
    assert got == want


@pytest.mark.parametrize("width", [None, 17])
def test_nearest(data, width):
    p, s, points, segs = data
    got = {r.p: (r.segment.distance, r.segment.seg_idx) for r in I.nearest(p, s, ["video"], "at", chunk_width=width).collect()}
    want = {i: min((min(abs(at - x[2]), abs(at - x[3])), x[1]) for x in segs if x[0] == v) for v, i, at in points}
    assert got == want


def test_hold_last(data):
    p, s, points, segs = data
    got = {r.p: r.active_idx for r in I.hold_last(p, s, ["video"], "at", chunk_width=29).collect()}

    def held(v, at):
        mine = [x for x in segs if x[0] == v]
        cover = [x[1] for x in mine if x[2] <= at < x[3]]
        return cover[0] if cover else max((x[1] for x in mine if x[3] <= at), default=-1)

    assert got == {i: held(v, at) for v, i, at in points}


@pytest.mark.parametrize("bucket", [3, 50, 1000])
def test_overlapping_has_each_pair_once(spark, bucket):
    r = random.Random(5)
    mk = lambda n: [(r.randrange(2), i, s, s + r.randrange(40)) for i, s in ((i, r.randrange(300)) for i in range(n))]
    a, b = mk(40), mk(40)
    left = spark.createDataFrame(a, "video int, l int, ls int, le int")
    right = spark.createDataFrame(b, "video int, r int, rs int, re int")
    got = sorted((x.l, x.r) for x in I.overlapping(left, right, ["video"], ("ls", "le"), ("rs", "re"), bucket, 10).collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[3] + 10 >= x[2] and y[2] - 10 <= x[3])
    assert got == want


def test_pairs_are_joined_by_bucket_not_by_nested_loop(spark):
    left = spark.range(10).select((F.col("id") % 2).alias("video"), F.col("id").alias("ls"), (F.col("id") + 1).alias("le"))
    right = left.withColumnsRenamed({"ls": "rs", "le": "re"})
    plan = I.overlapping(left, right, ["video"], ("ls", "le"), ("rs", "re"), 5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_time_buckets_last_listed_wins(spark):
    s = spark.createDataFrame([(1, 0, 0, 100, 200), (1, 1, 60, 200, 200)], "video int, seg_idx int, start_ms int, end_ms int, duration int")
    got = {r.bucket: r.seg_idx for r in I.time_buckets(s, ["video"], "duration", 50).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}
    early = {r.bucket: r.seg_idx for r in I.time_buckets(s, ["video"], "duration", 50, early=50).collect()}
    assert early == {0: 1, 1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("lo,hi", [(0, 1), (0, 0), (5, 3), (-7, 9), (1_700_000_000_123, 1_700_604_800_123), (-1, 1), (0, 1 << 40), (3, 1 << 33)])
def test_dyadic_blocks_are_few_and_fill_the_span(spark, lo, hi):
    row = spark.range(1).select(I.dyadic(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint")).alias("b")).first()
    spans = sorted((n << l, (n + 1) << l) for l, n in (tuple(x) for x in row.b or []))
    if hi <= lo:
        assert spans == []
        return
    assert spans[0][0] == lo and spans[-1][1] == hi and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(spans) <= max(1, 2 * (hi - lo).bit_length())
    if hi - lo == 604_800_000:  # a week in milliseconds
        assert len(spans) < 60


def test_covering_answers_lists_in_any_order(spark):
    r = random.Random(11)
    segs = [(v, i, s, s + r.choice([1, 7, 60, 400]), f"{v}/{i}") for v in range(3) for i, s in enumerate(r.sample(range(500), 40))]
    segs.append(segs[3])  # a repeated row
    points = [(v, v * 1000 + i, r.randrange(-20, 950)) for v in range(4) for i in range(150)]
    p = spark.createDataFrame(points, "video int, p int, at int")
    s = spark.createDataFrame(segs, "video int, seg_idx int, start_ms int, end_ms int, name string")
    for width in (None, 50):
        got = {x.p: (x.segment.seg_idx, x.segment.name) if x.segment else None for x in I.covering(p, s, ["video"], "at", payload=["name"], chunk_width=width).collect()}
        want = {i: min(((x[1], x[4]) for x in segs if x[0] == v and x[2] <= at < x[3]), default=None) for v, i, at in points}
        assert got == want


def test_spans_far_longer_than_a_bucket_meet_once(spark):
    left = [(1, i, i * 100, i * 100 + (1_000_000 if i % 9 == 0 else 40)) for i in range(60)]
    right = [(1, i, i * 90 - 500, i * 90 - 500 + (2_000_000 if i % 7 == 0 else 30)) for i in range(60)]
    got = I.overlapping(
        spark.createDataFrame(left, "video int, l int, ls long, le long"), spark.createDataFrame(right, "video int, r int, rs long, re long"),
        ["video"], ("ls", "le"), ("rs", "re"), 50, 5)
    want = sorted((a[1], b[1]) for a in left for b in right if b[3] + 5 >= a[2] and b[2] - 5 <= a[3])
    assert sorted((x.l, x.r) for x in got.collect()) == want
