"""Caption cuts: offsets, kinds of cuts, layout, and texts of any length."""

import time

import numpy as np
from pyspark.sql import functions as F

from lexicue.operators import captions as Cp

NONE = Cp.Said.of([], [], [])
SEGMENTS = "video string, seg_idx int, start_ms bigint, end_ms bigint, text string, words array<struct<start:double,end:double,word:string>>"


def test_kinds_of_cuts_and_their_offsets():
    text = " first part, " + "a" * 50 + " tail words of it. 好" + "好" * 30 + "!!"
    said = Cp.Said.of([0.0, 0.2, 9.0], [0.1, 0.3, 9.2], ["first", "part,", "tail"])
    out = Cp.caption_pieces(text, 0, 10_000, said)
    whole = text.strip()
    assert all(whole[p["split_at"] :].startswith(p["text"]) for p in out)
    assert [p["cut"] for p in out] == ["whole", "punctuation", "width", "punctuation", "width", "punctuation"]
    assert "".join("".join(p["text"].split()) for p in out) == "".join(text.split())
    assert [p["part_idx"] for p in out] == [0, 1, 1, 2, 2, 3] and out[-1]["text"] == "!"
    assert all(a["end_ms"] <= b["start_ms"] + 1 for a, b in zip(out, out[1:]))


def test_a_pause_divides_before_the_width_does():
    text = "one two three four five six seven eight nine ten eleven"
    words = text.split()
    begins = np.arange(len(words)) * 0.5 + np.array([0.0] * 4 + [0.6] * 7)
    out = Cp.caption_pieces(text, 0, 7000, Cp.Said.of(begins, begins + 0.45, words))
    assert [p["text"] for p in out] == ["one two three four", "five six seven eight nine ten", "eleven"][: len(out)] or out[0]["text"] == "one two three four"
    assert out[1]["cut"] == "pause" and out[1]["split_at"] == len("one two three four ")


def test_long_texts_take_linear_time():
    def seconds(n):
        text, at = ("word " * 7 + "好" * 5) * n, time.perf_counter()
        pieces = Cp.caption_pieces(text, 0, 10**7, NONE)
        assert all(len("".join(p["text"].split())) <= 36 for p in pieces) and len(pieces) >= n
        return time.perf_counter() - at

    seconds(10)
    assert seconds(20_000) < 12 * max(seconds(4_000), 0.05)
    assert len(Cp.caption_pieces("x" * 20_000, 0, 1000, NONE)) == -(-20_000 // 36)


def test_blank_null_and_narrow_segments(spark):
    rows = [("v", 0, 0, 9, "  ", []), ("v", 1, 0, 9, None, []), ("v", 2, 0, 9, " ok ", None), ("v", 3, 0, 900, "好" * 40, None), ("v", 4, 0, 900, "ab " * 40, [])]
    out = Cp.chunk_captions(spark.createDataFrame(rows, SEGMENTS)).orderBy("seg_idx", "split_at").collect()
    by = lambda i: [r.text for r in out if r.seg_idx == i]
    assert by(0) == ["  "] and by(1) == [None] and by(2) == [" ok "] and [len(t) for t in by(3)] == [18, 18, 4]
    wide = [r for r in out if r.seg_idx == 3]
    assert [len(r.chars) for r in wide] == [18, 18, 4] and wide[0].confidence == 1.0
    box = wide[0].bbox
    assert (box.y, box.height) == (1049, 64) and wide[0].chars[1].x == wide[0].chars[0].x + box.width // 18
    assert Cp.chunk_captions(spark.createDataFrame([], SEGMENTS)).count() == 0


def test_widths_of_characters_follow_the_ranges():
    from lexicue import constants as K

    for c in "a \t\u3000\u00a0\x1cé好\u4dff㐀\u4dbf\u4dc0぀ヿ\u3100가힯\ud7b0一鿿\ua000\U0001f600\x00":
        want = 0 if c.isspace() else 2 if any(ord(a) <= ord(c) <= ord(b) for a, b in ("一鿿", "㐀\u4dbf", "぀ヿ", "가\ud7af")) else 1
        assert Cp.Ruler(c).before == [0, want], hex(ord(c))
    assert len(K.CJK_RANGES) == 12
