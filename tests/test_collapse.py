"""Folds against straightforward loops, and hand cases."""

import random

import pytest
from pyspark.sql import functions as F

from lexicue.operators import collapse as C
from lexicue.operators.scans import chunk_of

INTERVAL, TOLERANCE = 100, 500


def loop_fuzzy(frames):
    """One video's frames in order -> segments, decided frame by frame."""
    out, seg, gap = [], None, None
    for at, text in frames:
        if not text:
            if seg and gap is None:
                gap = at
            elif seg and at - gap + INTERVAL > TOLERANCE:
                out.append(tuple(seg))
                seg = gap = None
            continue
        if seg and C.similar(text, seg[2]):
            seg[1] = at + INTERVAL
        else:
            if seg:
                out.append(tuple(seg))
            seg = [at, at + INTERVAL, text]
        gap = None
    return out + ([tuple(seg)] if seg else [])


def run_fuzzy(spark, rows, chunk=None):
    df = spark.createDataFrame(rows, "video int, ts_ms bigint, frame_id bigint, text string")
    out = C.fuzzy_collapse(df, ["video"], "ts_ms", "text", "frame_id", INTERVAL, TOLERANCE, 100, chunk)
    return sorted((r.video, r.start_ms, r.end_ms, r.match_text) for r in out.collect())


@pytest.mark.parametrize("seed", range(4))
def test_fuzzy_collapse_random(spark, seed):
    r = random.Random(seed)
    texts = ["", "", "abcdefghij", "abcdefghiX", "abcdefgYZX", "abcdWVUYZX", "hello", "hello!"]
    rows, want = [], []
    for v in range(4):
        frames, at = [], 0
        while at < 12_000:
            text = r.choice(texts)
            for _ in range(r.choice([1, 1, 2, 4, 7])):
                frames.append((at, text))
                at += INTERVAL
        rows += [(v, t, t // 100, x) for t, x in frames]
        want += [(v, *s) for s in loop_fuzzy(frames)]
    assert run_fuzzy(spark, rows, chunk_of(F.col("ts_ms"), 1000)) == sorted(want)


def video(*texts):
    return [(1, i * INTERVAL, i, t) for i, t in enumerate(texts)]


def test_gap_within_and_beyond_tolerance(spark):
    assert run_fuzzy(spark, video("ab", "", "", "ab")) == [(1, 0, 400, "ab")]
    assert run_fuzzy(spark, video("ab", *[""] * 5, "ab")) == [(1, 0, 700, "ab")]
    assert run_fuzzy(spark, video("ab", *[""] * 6, "ab")) == [(1, 0, 100, "ab"), (1, 700, 800, "ab")]


def test_drifting_text_is_compared_with_the_first(spark):
    a, b, c = "abcdefghij", "abcdefghXY", "abcdefWVXY"
    assert C.similar(b, a) and C.similar(c, b) and not C.similar(c, a)
    assert run_fuzzy(spark, video(a, b, c)) == [(1, 0, 200, a), (1, 200, 300, c)]


def test_only_empty_frames(spark):
    assert run_fuzzy(spark, video("", "", "")) == []


def test_exact_collapse_drops_short_and_keeps_first_frame(spark):
    df = spark.createDataFrame([(1, i * 250, t, i) for i, t in enumerate(["a", "a", "a", "", "a", "b", "b", "b"])], "video int, ts int, text string, frame int")
    out = C.exact_collapse(df, ["video"], "ts", "text", 250, 750, keep=["frame"])
    assert sorted((r.start_ms, r.end_ms, r.text, r.frame) for r in out.collect()) == [(0, 750, "a", 0), (1250, 2000, "b", 5)]


def flicker(spark, rows, chunk=None):
    df = spark.createDataFrame(rows, "video int, start_ms bigint, end_ms bigint, low_text string, last_frame bigint")
    return sorted((r.start_ms, r.end_ms, r.low_text, r.last_frame) for r in C.flicker_merge(df, ["video"], chunk).collect())


def test_flicker_inside_and_beyond(spark):
    rows = [(1, 0, 1000, "cap", 1), (1, 1000, 1500, "", 2), (1, 2500, 3000, "cap", 3), (1, 4600, 5000, "cap", 4)]
    assert flicker(spark, rows) == [(0, 3000, "cap", 3), (1000, 1500, "", 2), (4600, 5000, "cap", 4)]


def test_flicker_gap_is_measured_from_the_extended_end(spark):
    rows = [(1, 0, 1000, "cap", 1), (1, 2000, 3000, "cap", 2), (1, 4500, 5000, "cap", 3)]
    assert flicker(spark, rows, chunk_of(F.col("start_ms"), 700)) == [(0, 5000, "cap", 3)]


def loop_near(rows, threshold=0.8):
    kept = []
    for i, text, end in rows:
        if kept:
            a, b = set(text), set(kept[-1][1])
            if a and b and len(a & b) / len(a | b) >= threshold:
                kept[-1][2] = max(kept[-1][2], end)
                continue
        kept.append([i, text, end])
    return [tuple(k) for k in kept]


@pytest.mark.parametrize("seed", range(4))
def test_near_duplicates_random(spark, seed):
    r = random.Random(seed)
    rows, text = [], list("abcdefghij")
    for i in range(200):
        if r.random() < 0.5:
            text[r.randrange(10)] = r.choice("abcdefghijklmnop")
        if r.random() < 0.1:
            text = r.sample("abcdefghijklmnopqrstuvwxyz", 10)
        rows.append((i, "".join(text) if r.random() > 0.05 else "", r.randrange(1000)))
    df = spark.createDataFrame([(1, *x) for x in rows], "video int, i int, text string, end_ms int")
    got = C.drop_near_duplicates(df, ["video"], ["i"], chunk=chunk_of(F.col("i"), 13))
    assert sorted((r.i, r.text, r.end_ms) for r in got.collect()) == loop_near(rows)


def test_keyframes_first_every_fifth_and_changes(spark):
    vec = lambda *x: [float(v) for v in x]
    rows = [(1, 0, vec(0, 0, 0, 0)), (1, 1, vec(0, 0, 0, 0)), (1, 2, vec(0, 3, 0, 0)), (1, 3, vec(0, 3, 0, 1.5)), (1, 4, vec(0, 3, 0, 1.5)), (1, 5, vec(0, 3, 0, 1.5))]
    df = spark.createDataFrame(rows, "video int, f int, v array<double>")
    out = C.keyframes(df, ["video"], "f", "v", 4, 2.0, 5)
    assert [r.is_key for r in out.orderBy("f").collect()] == [True, False, True, False, False, True]
