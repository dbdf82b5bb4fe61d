"""Split folds against the same rule row by row: borders, chains of chunks, keys that never reset."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicue.operators import collapse as C, folds
from lexicue.operators.scans import chunk_of


def sequential(fold, rows):
    state, out = None, []
    for r in rows:
        state, done = fold.step(state, r)
        out += done
    return out + fold.close(state)


class Sticky(folds.Fold):
    """Sums numbers until a zero; a state that meets only at zeros. Keeps the first row's label, which may be null."""

    def step(self, state, row):
        if row["x"] == 0:
            return None, [] if state is None else [state]
        if state is None:
            return {"v": row["v"], "i": row["i"], "total": row["x"], "big": row["big"]}, []
        return state | {"total": state["total"] + row["x"]}, []

    def close(self, state):
        return [] if state is None else [state]


ROWS = "v int, i bigint, x int, big bigint"


def check(spark, rows, chunk, **limits):
    df = spark.createDataFrame(rows, ROWS)
    got = folds.split_fold(df, ["v"], ["i"], Sticky(), "v int, i bigint, total bigint, big bigint", chunk, **limits)
    want = []
    for v in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == v)
        want += sequential(Sticky(), [dict(zip(("v", "i", "x", "big"), r)) for r in mine])
    assert sorted(tuple(r) for r in got.collect()) == sorted((w["v"], w["i"], w["total"], w["big"]) for w in want)
    return got


@pytest.mark.parametrize("border,rounds,zero", [(64, 6, 0.1), (2, 6, 0.1), (2, 2, 0.02), (1, 1, 0.0), (64, 1, 0.0), (3, 6, 0.0)])
def test_states_that_meet_late_or_never(spark, border, rounds, zero):
    r = random.Random(border * 7 + rounds)
    rows = [(v, i, 0 if r.random() < zero else r.randrange(1, 9), (1 << 60) + 1) for v in range(4) for i in range(r.choice([1, 30, 150]))]
    check(spark, rows, F.floor(F.col("i") / 10), border=border, rounds=rounds)


def test_null_keys_gaps_and_an_empty_table(spark):
    rows = [(1, i * 1000, i % 7, 5) for i in range(60)]
    check(spark, rows, F.floor(F.col("i") / 3000), border=1)
    df = spark.createDataFrame([(None, i, 1, None) for i in range(9)] + [(2, i, 1, None) for i in range(9)], ROWS)
    got = folds.split_fold(df, ["v"], ["i"], Sticky(), "v int, i bigint, total bigint, big bigint", F.floor(F.col("i") / 2))
    assert sorted(map(tuple, got.collect()), key=str) == [(2, 0, 9, None), (None, 0, 9, None)]
    assert folds.split_fold(df.limit(0), ["v"], ["i"], Sticky(), "v int, i bigint, total bigint, big bigint", F.col("i")).count() == 0


def test_a_key_without_a_reset_is_many_tasks(spark, monkeypatch):
    """Similar texts all along: no chunk sees a border of its own, and yet each is folded alone."""
    seen = []
    real = folds.materialized
    monkeypatch.setattr(folds, "materialized", lambda df: seen.append(real(df)) or seen[-1])
    texts = ["abcdefghij", "abcdefghiX"]
    rows = [(1, i, texts[i % 2], i) for i in range(4000)]
    df = spark.createDataFrame(rows, "v int, i bigint, text string, end_ms bigint")
    got = C.drop_near_duplicates(df, ["v"], ["i"], chunk=F.floor(F.col("i") / 500)).collect()
    assert [(r.i, r.end_ms) for r in got] == [(0, 3999)]
    ends = seen[0].where("kind = 'end'")
    assert ends.select("chunk").distinct().count() == 8 and {r.pos for r in ends.collect()} == {500}


def loop_flicker(rows):
    out, last = [], None
    for s, e, low, frame in sorted(rows):
        if not low:
            out.append((s, e, low, frame))
        elif last and s - last[1] <= 1500 and C.similar(low, last[2]):
            last[1:] = [e, low, frame]
        else:
            last = [s, e, low, frame]
            out.append(last)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("width", [700, 5000, None])
def test_flicker_random(spark, monkeypatch, width):
    monkeypatch.setattr(folds, "BORDER", 3)
    r = random.Random(width)
    rows, at = [], 0
    for i in range(300):
        at += r.choice([100, 400, 1400, 1600])
        rows.append((at, at + r.choice([100, 300, 2000]), r.choice(["", "caption one", "caption onE", "other"]), i))
    df = spark.createDataFrame([(1, *x) for x in rows], "video int, start_ms bigint, end_ms bigint, low_text string, last_frame bigint")
    got = C.flicker_merge(df, ["video"], chunk_of(F.col("start_ms"), width) if width else None)
    assert sorted((x.start_ms, x.end_ms, x.low_text, x.last_frame) for x in got.collect()) == loop_flicker(rows)


def test_a_fold_holds_few_rows_of_a_batch():
    row = pa.struct([("i", pa.int64()), ("t", pa.string())])
    kind = pa.schema([("key", pa.struct([("k", pa.int64())])), ("part", pa.int64()), ("row", row)])
    n = 10_000
    batch = pa.RecordBatch.from_pylist([{"key": {"k": 1}, "part": 0, "row": {"i": i, "t": "x" * 1000}} for i in range(n)], kind)
    tracemalloc.start()
    seen = sum(1 for _ in folds._groups(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and peak < 3_000_000  # the batch has 10 MB of text
