"""Wide captions cut into short ones: after punctuation, at the longest pause, at a word boundary.

All cuts of a text are planned over offsets: prefix widths, ends of units and silences are arrays made once. Only texts
that are too wide reach the row-level helper, in Arrow batches.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from functools import reduce
from operator import le, sub
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexicue import constants as K
from lexicue.functions import geometry as G
from lexicue.functions import text as T
from lexicue.operators import intervals as I
from lexicue.operators.staging import staged

_WIDE = [(ord(a), ord(b)) for a, b in re.findall("(.)-(.)", K.CJK_RANGES)]
_BLANK = [(c, c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
#: Code points at which the width of a character changes, and the widths from each on: blanks have none.
_STEPS = sorted([(0, 1), *((lo, w) for w, spans in ((0, _BLANK), (2, _WIDE)) for lo, _ in spans), *((hi + 1, 1) for _, hi in _BLANK + _WIDE)], key=lambda s: (s[0], -abs(s[1] - 1)))
_STEPS = [s for i, s in enumerate(_STEPS) if not i or s[0] != _STEPS[i - 1][0]]
_EDGES, _WIDTHS = np.array([c for c, _ in _STEPS], np.uint32), np.array([1, *(w for _, w in _STEPS)])
_UNIT = re.compile(rf"{T.CJK}|[^ {K.CJK_RANGES}]+ ?| +")
#: A part ends with its first mark; blanks behind it belong to none.
_PART = re.compile(rf"[^\s{K.SPLIT_AFTER}][^{K.SPLIT_AFTER}]*[{K.SPLIT_AFTER}]?|[{K.SPLIT_AFTER}]")


def interpolated(total: Column, at: Column, start: Column, end: Column) -> Column:
    """Time of a character offset, linear over the segment, truncated."""
    return start + (at / F.greatest(total, F.lit(1)) * (end - start)).cast("bigint")


def attach_words(segments: DataFrame, words: DataFrame, bucket_s: float = 4.0) -> DataFrame:
    """Add the spoken words inside each segment as ``words array<struct<start,end,word>>``.

    Words: ``video, word, start, end`` in seconds. The list belongs to one segment, so it is short.
    """
    timed = segments.select(
        "video", "seg_idx", (F.col("start_ms") / 1000).alias("s0"), (F.col("end_ms") / 1000).alias("s1")
    )
    pairs = I.contained(
        words, timed, ["video"], ("start", "end"), ("s0", "s1"), bucket_s, K.WORD_SLACK_S
    )
    lists = pairs.groupBy("video", "seg_idx").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "word"))).alias("words")
    )
    empty = F.array().cast("array<struct<start:double,end:double,word:string>>")
    return segments.join(lists, ["video", "seg_idx"], "left").withColumn("words", F.coalesce("words", empty))


def _with_parts(segments: DataFrame) -> DataFrame:
    """Add ``parts array<struct<part_idx,text,start_ms,end_ms>>``.

    Times are interpolated; offsets ignore white space lost at the cuts.
    """
    text = T.strip(F.col("text"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<part:string,at:int>>").alias("out"))
    offsets = F.aggregate(
        T.split_after_punctuation(text),
        zero,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.array_append(acc["out"], F.struct(p.alias("part"), acc["at"].alias("at"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    cut = staged(segments, __n=F.length(text), __cuts=offsets)
    n, s, e = F.col("__n"), F.col("start_ms"), F.col("end_ms")
    parts = F.transform(
        "__cuts",
        lambda p, i: F.struct(
            i.alias("part_idx"), T.strip(p["part"]).alias("text"),
            interpolated(n, p["at"], s, e).alias("start_ms"),
            interpolated(n, p["at"] + F.length(p["part"]), s, e).alias("end_ms"),
        ),
    )
    return staged(cut, parts=parts).drop("__n", "__cuts")


def punctuation_parts(segments: DataFrame) -> DataFrame:
    """Parts of each text with their times, one row per part."""
    rest = [c for c in segments.columns if c not in ("text", "start_ms", "end_ms")]
    return _with_parts(segments).select(*rest, F.inline("parts"))


class Ruler:
    """Offsets of one text: widths before each character and ends of units. Built once, read by all cuts."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        widths = _WIDTHS[np.searchsorted(_EDGES, codes, "right")]
        self.text, self.before = text, [0, *np.cumsum(widths).tolist()]
        self.units = [m.end() for m in _UNIT.finditer(text)]

    def trimmed(self, lo: int, hi: int) -> tuple[int, int]:
        """The span without blanks at its ends, which have no width; empty where there is nothing else."""
        while lo < hi and self.before[lo + 1] == self.before[lo]:
            lo += 1
        while lo < hi and self.before[hi] == self.before[hi - 1]:
            hi -= 1
        return lo, hi

    def fits(self, lo: int, hi: int) -> bool:
        return self.before[hi] - self.before[lo] <= K.MAX_VISUAL_WIDTH

    def line(self, lo: int, hi: int) -> int:
        """Where a line from ``lo`` must end: after the last whole unit that fits, else after the last character."""
        most = bisect_right(self.before, self.before[lo] + K.MAX_VISUAL_WIDTH, lo, hi + 1) - 1
        whole = bisect_right(self.units, most)
        end = self.units[whole - 1] if whole else lo
        return end if end > lo else most


class Span(NamedTuple):
    """A stretch of the text with its time and the way it was cut off what stands before it."""

    lo: int
    hi: int
    start: int
    end: int
    cut: str

    def at(self, chars: int) -> int:
        """Time of a number of characters after the start, linear and truncated."""
        return self.start + int(chars / (self.hi - self.lo) * (self.end - self.start))


class Said(NamedTuple):
    """Words with the times they begin and end, in seconds; ``sorted`` where they begin in order and none ends before it begins."""

    begins: list[float]
    ends: list[float]
    words: list[str]
    sorted: bool

    @classmethod
    def of(cls, begins, ends, words) -> Said:
        begins, ends = list(begins), list(ends)
        return cls(begins, ends, list(words), all(map(le, begins, begins[1:])) and all(map(le, begins, ends)))

    def during(self, start: int, end: int) -> Said:
        low, high = start / 1000 - K.WORD_SLACK_S, end / 1000 + K.WORD_SLACK_S
        near = range(bisect_left(self.begins, low), bisect_right(self.begins, high)) if self.sorted else range(len(self.words))
        inside = [i for i in near if self.begins[i] >= low and self.ends[i] <= high]
        return Said(*([column[i] for i in inside] for column in self[:3]), self.sorted)


def _silence(text: str, span: Span, said: Said) -> int | None:
    """The offset after the longest silence, if that is longer than a pause; the first wins ties.

    Only words up to the silence are located, each behind the one before. A word that the text lacks moves nothing.
    """
    silent = list(map(sub, said.begins[1:], said.ends))
    if not silent or (most := max(silent)) <= K.PAUSE_S:
        return None
    longest = silent.index(most)

    def past(at: int, word: str) -> int:
        there = text.find(word, at, span.hi)
        return at if there < 0 else there + len(word)

    return reduce(past, said.words[: longest + 1], span.lo)


def plan_cuts(text: str, ruler: Ruler, span: Span, said: Said) -> list[Span]:
    """Narrow enough spans that make up ``span`` of ``text``, in order, with their times.

    Silences divide a span in two, in which the words of each are looked at again. A span without one is laid out in lines
    over the widths known from the start, so its cost is one search per line.
    """
    out, todo = [], [(span, said)]
    while todo:
        span, said = todo.pop()
        while span.hi > span.lo:
            if ruler.fits(span.lo, span.hi):
                out.append(span)
                break
            at = _silence(text, span, said)
            (a, b), (c, d) = ((span.lo, span.lo),) * 2 if at is None else (ruler.trimmed(span.lo, at), ruler.trimmed(at, span.hi))
            if a < b and c < d:
                first = Span(a, b, span.at(0), span.at(b - a), span.cut)
                second = Span(c, d, span.at(at - span.lo), span.at(at - span.lo + d - c), "pause")
                todo.append((second, said.during(second.start, second.end)))
                span, said = first, said.during(first.start, first.end)
                continue
            stop = ruler.line(span.lo, span.hi)
            (a, b), (c, d) = ruler.trimmed(span.lo, stop), ruler.trimmed(stop, span.hi)
            n = b - a
            out.append(Span(a, b, span.at(0), span.at(n), span.cut))
            span = Span(c, d, span.at(n), span.at(n + d - c), "width")
    return sorted(out)


def caption_pieces(text: str, start: int, end: int, said: Said) -> list[dict]:
    """All pieces of one wide text: parts after punctuation, each planned alone.

    A part's time follows from the characters of the parts before it; white space lost at the cuts does not count. ``split_at``
    is the piece's offset in the text.
    """
    text = text.strip()
    ruler, whole = Ruler(text), Span(0, len(text), start, end, "whole")
    parts = [m.span() for m in _PART.finditer(text)]
    out, gone = [], 0
    for i, (lo, hi) in enumerate(parts):
        part = Span(lo, hi, whole.at(gone), whole.at(gone + hi - lo), "punctuation" if i else "whole")
        gone += hi - lo
        if ruler.fits(lo, hi):
            spans = [part]
        else:
            spans = plan_cuts(text, ruler, part, said if len(parts) == 1 else said.during(part.start, part.end))
        out += [
            {"part_idx": i, "cut_idx": k, "split_at": p.lo, "start_ms": p.start, "end_ms": p.end, "text": text[p.lo : p.hi], "cut": p.cut}
            for k, p in enumerate(spans)
        ]
    return out


_PIECES = "array<struct<part_idx int, cut_idx int, split_at int, start_ms bigint, end_ms bigint, text string, cut string>>"


def chunk_captions(segments: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """One row per caption that is narrow enough, with its layout.

    Segments: ``video, seg_idx, start_ms, end_ms, text, words array<struct<start,end,word>>`` with the words spoken inside the
    segment. Output: ``video, seg_idx, part_idx, cut_idx, split_at`` (offset in the segment's text), ``cut`` (``whole``,
    ``punctuation``, ``pause`` or ``width``), ``start_ms, end_ms, text, confidence, bbox, chars``. Texts that are narrow
    enough stay as they are and never reach Python.
    """

    @F.pandas_udf(_PIECES)
    def pieces(text: pd.Series, start: pd.Series, end: pd.Series, begins: pd.Series, ends: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else caption_pieces(t, int(s), int(e), Said.of(b, d, w))
            for t, s, e, b, d, w in zip(text, start, end, begins, ends, words)
        ], dtype=object)

    wide = T.too_wide(T.strip(F.col("text")))
    # no list of words is a list of none
    heard = F.filter("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull() & w["word"].isNotNull())
    said = lambda field: F.when(F.col("__wide"), F.transform(F.coalesce(heard, F.array().cast(segments.schema["words"].dataType)), lambda w: w[field]))
    whole = F.array(F.struct(
        F.lit(0).alias("part_idx"), F.lit(0).alias("cut_idx"), F.lit(0).alias("split_at"), F.col("start_ms").cast("bigint").alias("start_ms"),
        F.col("end_ms").cast("bigint").alias("end_ms"), F.col("text").alias("text"), F.lit("whole").alias("cut"),
    ))
    marked = staged(segments.select("video", "seg_idx", "start_ms", "end_ms", "text", "words"), __wide=wide)
    cut = marked.withColumn("__cut", pieces(F.when(F.col("__wide"), F.col("text")), "start_ms", "end_ms", said("start"), said("end"), said("word")))
    rows = cut.select("video", "seg_idx", F.inline(F.coalesce("__cut", whole)))
    box = G.caption_layout(F.col("text"), F.lit(720) if width is None else width, F.lit(1280) if height is None else height)
    laid = staged(rows, __box=box)
    b = F.col("__box")
    chars = G.unit_boxes(F.col("text"), b["x"], b["y"], b["char_width"], b["height"], wide_run_stop=False)
    return laid.select(
        "video", "seg_idx", "part_idx", "cut_idx", "split_at", "cut", "start_ms", "end_ms", "text", F.lit(1.0).alias("confidence"),
        F.struct(*[b[k].alias(k) for k in ("x", "y", "width", "height")]).alias("bbox"), chars.alias("chars"),
    )


def longest_pause(words: DataFrame, keys: list[str], start: str, end: str, index: str, min_gap, chunk=None) -> DataFrame:
    """Word before the longest gap over ``min_gap`` per key; the first wins ties."""
    from lexicue.operators.scans import Look, scan

    looked = scan(words, keys, [start, index], [Look("__next", F.col(start), ahead=True, inclusive=False)], chunk)
    gap = F.col("__next") - F.col(end)
    return looked.filter(gap > min_gap).groupBy(*keys).agg(
        F.max(gap).alias("gap"), F.max_by(index, F.struct(gap, -F.col(index))).alias(index)
    )
