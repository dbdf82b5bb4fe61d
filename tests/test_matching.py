"""Tapped words and dictionary cover."""

import pytest
from pyspark.sql import functions as F

from lexicue.operators import matching as M


def words(spark, *display, times=None):
    rows = [(1, i, w, *(times[i] if times else (i * 1000, i * 1000 + 900))) for i, w in enumerate(display)]
    return spark.createDataFrame(rows, "video int, word_index bigint, display_text string, start_ms bigint, end_ms bigint")


def tap(spark, defs, text, index, time=0):
    df = spark.createDataFrame([(7, 1, text, index, time, text[index])], "tap_id int, video int, full_text string, char_index int, time_ms bigint, tapped string")
    r = M.match_taps(df, defs, 5000).collect()[0]
    return (r.display_text, r.word_start) if r.display_text else None


@pytest.mark.parametrize("index,want", [(0, ("喝酒", 0)), (1, ("喝酒", 0)), (2, ("有害", 2)), (4, ("健康", 4)), (5, ("健康", 4))])
def test_unsegmented_text(spark, index, want):
    assert tap(spark, words(spark, "喝酒", "有害", "健康"), "喝酒有害健康", index) == want


@pytest.mark.parametrize("text,index,want", [("你好，世界", 3, "世界"), ("你好。世界", 0, "你好"), ("你好 世界", 3, "世界"), ("你好，世界", 2, "世界")])
def test_punctuation_is_ignored(spark, text, index, want):
    assert tap(spark, words(spark, "你好", "世界"), text, index)[0] == want


def test_far_time_still_matches(spark):
    assert tap(spark, words(spark, "你好", times=[(5000, 7000)]), "你好", 0, 99_000) == ("你好", 0)


def test_repeated_word_takes_the_nearest_time(spark):
    defs = words(spark, "自己", "一个人", "自己", times=[(0, 2000), (2000, 3000), (3000, 5000)])
    r = lambda i, t: tap(spark, defs, "自己一个人自己", i, t)
    assert r(0, 1000) == ("自己", 0) and r(5, 4000) == ("自己", 5)


def test_latin_and_no_match(spark):
    assert tap(spark, words(spark, "hello", "world"), "hello world", 6) == ("world", 6)
    assert tap(spark, words(spark, "你好"), "xyz", 1) is None


def test_single_character_fallback(spark):
    defs = words(spark, "天天", "好天", times=[(0, 1000), (50_000, 51_000)])
    assert tap(spark, defs, "天", 0, 50_500) == ("好天", 0)
    assert tap(spark, defs, "天", 0, 200_000) == ("天天", 0)


def test_greedy_cover(spark):
    d = spark.createDataFrame([("你好", "ni hao"), ("好", "hao"), ("世界", "shi jie"), ("你", "ni")], "w string, r string")
    t = spark.createDataFrame([(1, "你好，世界好"), (2, "abc"), (3, "")], "id int, text string")
    out = {r.id: (r.readings, [tuple(s) for s in r.syllables]) for r in M.greedy_cover(t, "id", "text", d, "w", "r").collect()}
    assert out[1] == ("ni hao shi jie hao", [(0, "ni"), (1, "hao"), (3, "shi"), (4, "jie"), (5, "hao")])
    assert out[2] == ("", []) and out[3] == ("", [])


def test_a_very_long_word_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 40)
    monkeypatch.setattr(M, "SLICE", 2)
    long = "ab" * 10_000
    defs = words(spark, long, "ab", "bab", "zz", "a", "q" * 30, "r" * 30)
    rows = [(i, 1, "zz" + long + "zz", c, 0, "x") for i, c in enumerate((0, 2, 3, 9000, 20_001, 20_002))] + [(9, 2, "ab", 0, 0, "a")]
    taps = spark.createDataFrame(rows, "tap_id int, video int, full_text string, char_index int, time_ms bigint, tapped string")
    got = {r.tap_id: (r.display_text, r.word_start) for r in M.match_taps(taps, defs).collect()}
    assert got == {0: ("zz", 0), **{i: (long, 2) for i in (1, 2, 3, 4)}, 5: ("zz", 20_002), 9: (None, None)}


def test_greedy_cover_of_long_texts_equals_a_loop(spark):
    import random

    r = random.Random(3)
    d = {w: w.upper() for w in ("a", "ab", "abc", "bca", "cab", "ba")}
    texts = [(i, "".join(r.choice("abcx") for _ in range(n))) for i, n in enumerate((0, 1, 2, 3, 4, 5, 31, 32, 33, 2000))]

    def loop(text):
        at, out = 0, []
        while at < len(text):
            hit = next((text[at : at + n] for n in (4, 3, 2, 1) if text[at : at + n] in d), None)
            out += [d[hit]] if hit else []
            at += len(hit or "x")
        return " ".join(out)

    words_ = spark.createDataFrame(list(d.items()), "w string, r string")
    got = M.greedy_cover(spark.createDataFrame(texts, "id int, text string"), "id", "text", words_, "w", "r")
    assert {x.id: x.readings for x in got.collect()} == {i: loop(t) for i, t in texts}


def test_greedy_cover_deals_texts_to_tasks(spark, monkeypatch):
    """The tasks grow with the characters, whatever the session's number of shuffle partitions; results stay."""
    texts = spark.createDataFrame([(i, "abcx" * (i % 5)) for i in range(200)], "id int, text string")
    d = spark.createDataFrame([("ab", "AB"), ("c", "C")], "w string, r string")
    want = {(i, " ".join(["AB C"] * (i % 5))) for i in range(200)}
    monkeypatch.setattr(M, "COVERED", 50, raising=False)
    got = M.greedy_cover(texts, "id", "text", d, "w", "r").select("id", "readings", F.spark_partition_id().alias("task")).collect()
    assert {(x.id, x.readings) for x in got} == want
    assert len({x.task for x in got}) > 16


def test_words_are_not_repeated_for_letters_nobody_asks_for(spark):
    """A shuffle by (video, letter) in front of the choice would repeat each word once per letter."""
    defs = words(spark, "abcdef", "xyz")
    asked = spark.createDataFrame([(1, 1, "a!", 1, 0, "z")], "tap_id int, video int, full_text string, char_index int, time_ms bigint, tapped string")
    out = M._by_character(asked, defs, None)
    assert [(r.display_text, r.word_index) for r in out.collect()] == [("xyz", 1)]
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_split_behind_the_shuffle(spark):
    from lexicue.operators.scans import chunk_of
    from lexicue.operators.vocab import occurrences

    segs = spark.createDataFrame([(1, 0, "one two"), (1, 1, "three"), (2, 0, ""), (2, 1001, "x y")], "video int, seg_idx int, text string")
    out = occurrences(segs, ["video"], ["seg_idx"], "text", chunk_of(F.col("seg_idx"), 1000))
    assert sorted((r.video, r.word_index, r.word) for r in out.collect()) == [(1, 0, "one"), (1, 1, "two"), (1, 2, "three"), (2, 0, "x"), (2, 1, "y")]
    assert "__tokens" not in out._jdf.queryExecution().optimizedPlan().toString()
