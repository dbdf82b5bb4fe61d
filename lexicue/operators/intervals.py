"""Joins on time intervals ``[start, end)``.

Point lookups (covering, nearest, last ended) are scans over the union of points and interval ends:
linear in both sides, no pairs. Spans are cut into dyadic blocks, of which even a long one needs few. Joins whose result
*is* pairs (overlaps, words inside a segment) are equi-joins on such a block, which Spark can hash, sort and
split when skewed; a plain inequality would plan a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexicue.operators.scans import Look, asof, chunk_of, scan


def dyadic(lo: Column, hi: Column) -> Column:
    """The whole numbers from ``lo`` to below ``hi`` as the fewest aligned blocks: ``array<struct<level, node>>``.

    A block of a level is 2^level numbers. On each level at most two blocks are not part of a larger one inside the span, one at
    either end, so a span of n numbers has at most 2 log2(n) blocks.
    """
    at = lambda x, level: F.call_function("shiftright", x, level)
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("bigint")) == 1

    def ends(level: Column) -> Column:
        first, last = -at(-lo.cast("bigint"), level), at(hi.cast("bigint"), level)
        block = lambda keep, node: F.when(keep & (first < last), F.struct(level.alias("level"), node.alias("node")))
        return F.array(block(odd(first), first), block(odd(last), last - 1))

    top = F.floor(F.log2((hi - lo).cast("double"))).cast("int")
    found = F.flatten(F.transform(F.sequence(F.lit(0), top), ends))
    return F.when(hi > lo, F.filter(found, lambda b: b.isNotNull()))


def levels_of(blocks: Column) -> Column:
    """The levels that occur, as bits of a number."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(blocks, F.lit(0).cast("bigint"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", one, b["level"])))


# Blocks are listed by outer generators: for inner ones the optimizer adds filters that work the blocks out again.
def blocks_with(at: Column, levels: Column) -> Column:
    """The block of each of the ``levels`` that holds the whole number ``at``."""
    wanted = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda level: F.call_function("getbit", levels, level) == 1)
    return F.transform(wanted, lambda level: F.struct(level.alias("level"), F.call_function("shiftright", at.cast("bigint"), level).alias("node")))


def covering(
    points: DataFrame,
    segments: DataFrame,
    keys: list[str],
    at: str,
    start: str = "start_ms",
    end: str = "end_ms",
    index: str = "seg_idx",
    payload: list[str] | None = None,
    chunk_width: int | None = None,
    out: str = "segment",
) -> DataFrame:
    """First listed segment that covers each point, or null; the list may have any order. Times are whole numbers.

    The answer changes only where a segment starts or ends. It is found there, from the smallest index of each dyadic
    block, and a scan hands it to the points: no point meets more than one row, and no segment is listed more often than
    twice the logarithm of its length.
    """
    payload = payload or []
    live = segments.filter(F.col(end) > F.col(start))
    spans = live.select(*keys, index, dyadic(F.col(start), F.col(end)).alias("__blocks"))
    # bare numbers keep these in hash aggregates; the segment's columns follow at the end
    best = spans.select(*keys, index, F.inline_outer("__blocks")).groupBy(*keys, "level", "node").agg(F.min(index).alias(index))
    levels = spans.groupBy(*keys).agg(F.bit_or(levels_of(F.col("__blocks"))).alias("__levels"))
    stops = live.select(*keys, F.explode(F.array(start, end)).alias("__stop")).distinct().join(levels, keys)
    asked = stops.select(*keys, "__stop", F.inline_outer(blocks_with(F.col("__stop"), F.col("__levels"))))
    steps = asked.join(best, [*keys, "level", "node"], "left").groupBy(*keys, "__stop").agg(F.min(index).alias(index))
    steps = steps.join(live.select(*keys, index, start, end, *payload).dropDuplicates([*keys, index]), [*keys, index], "left")
    found = asof(
        points, steps, keys, at, "__stop", [index, start, end, *payload], {out: ("backward", False)}, index, chunk_width, unique=True
    )
    return found.withColumn(out, F.when(F.col(out)[index].isNotNull(), F.col(out)))


def nearest(
    points: DataFrame,
    segments: DataFrame,
    keys: list[str],
    at: str,
    start: str = "start_ms",
    end: str = "end_ms",
    index: str = "seg_idx",
    payload: list[str] | None = None,
    chunk_width: int | None = None,
    out: str = "segment",
) -> DataFrame:
    """Segment whose start or end is closest to the point; the first listed wins ties."""
    cols = [index, start, end, *(payload or [])]
    both_ends = segments.withColumn("__edge", F.explode(F.array(start, end)))
    found = asof(
        points,
        both_ends,
        keys,
        at,
        "__edge",
        cols,
        {"__back": ("backward", False), "__ahead": ("forward", True)},
        index,
        chunk_width,
    )

    def candidate(side: str) -> Column:
        hit = F.col(side)
        return F.when(
            hit.isNotNull(),
            F.struct(
                F.abs(hit["at"] - F.col(at)).alias("distance"),
                hit[index].alias("index"),
                F.struct(*[hit[c].alias(c) for c in cols]).alias("row"),
            ),
        )

    best = F.array_min(F.filter(F.array(candidate("__back"), candidate("__ahead")), lambda s: s.isNotNull()))
    return (
        found.withColumn("__best", best)
        .withColumn(
            out,
            F.when(
                F.col("__best").isNotNull(),
                F.struct(*[F.col("__best.row")[c].alias(c) for c in cols], F.col("__best.distance")),
            ),
        )
        .drop("__back", "__ahead", "__best")
    )


def hold_last(
    points: DataFrame,
    segments: DataFrame,
    keys: list[str],
    at: str,
    start: str = "start_ms",
    end: str = "end_ms",
    index: str = "seg_idx",
    chunk_width: int | None = None,
    out: str = "active_idx",
) -> DataFrame:
    """Index of the covering segment; in a gap the highest-listed one that already ended; else -1."""
    covered = covering(points, segments, keys, at, start, end, index, [], chunk_width, "__cover")
    rest = [c for c in covered.columns if c not in keys]
    left = covered.select(
        *keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*rest).alias("__p")
    )
    right = segments.select(
        *keys, F.col(end).alias("__at"), F.lit(0).alias("__side"), F.col(index).alias("__idx")
    )
    chunk = chunk_of(F.col("__at"), chunk_width) if chunk_width else None
    held = scan(
        left.unionByName(right, allowMissingColumns=True),
        keys,
        ["__at", "__side"],
        [Look("__held", F.col("__idx"), "max")],
        chunk,
    ).filter(F.col("__side") == 1)
    return held.select(
        *keys,
        *[F.col("__p")[c].alias(c) for c in rest if c != "__cover"],
        F.coalesce(F.col("__p.__cover")[index], F.col("__held"), F.lit(-1)).alias(out),
    )


def _coarse(x: Column, bucket: int | float) -> Column:
    return F.floor(x / bucket).cast("bigint")


def _met(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a point (``__at``) and a span (``__blocks``) that share a block, each pair once."""
    levels = spans.filter("__blocks IS NOT NULL").groupBy(*keys).agg(F.bit_or(levels_of(F.col("__blocks"))).alias("__levels"))
    p = points.join(levels, keys)
    p = p.select(*[c for c in points.columns if c != "__at"], F.inline_outer(blocks_with(F.col("__at"), F.col("__levels"))))
    s = spans.select(*[c for c in spans.columns if c != "__blocks"], F.inline_outer("__blocks"))
    return p.join(s, [*keys, "level", "node"]).drop("level", "node")


def overlapping(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bucket: int | float,
    tolerance: int | float = 0,
) -> DataFrame:
    """Pairs whose closed spans meet within ``tolerance``.

    Of two spans that meet, one holds the start of the other. A span is listed in the dyadic blocks of the buckets it touches,
    a start in the block of each level that holds it, so a pair meets once and a long span is listed seldom.
    ``bucket`` is the finest block, best near the usual span: spans that share one without meeting are compared.
    """
    (ls, le), (rs, re_) = left_span, right_span
    lo, hi = F.col(rs) - tolerance, F.col(re_) + tolerance
    l = left.filter(F.col(le) >= F.col(ls))
    r = right.filter(F.col(re_) >= F.col(rs))
    l_blocks = dyadic(_coarse(F.col(ls), bucket), _coarse(F.col(le), bucket) + 1).alias("__blocks")
    r_blocks = dyadic(_coarse(lo, bucket), _coarse(hi, bucket) + 1).alias("__blocks")
    later_right = _met(r.select("*", _coarse(lo, bucket).alias("__at")), l.select("*", l_blocks), keys)
    later_left = _met(l.select("*", _coarse(F.col(ls), bucket).alias("__at")), r.select("*", r_blocks), keys)
    cols = [*keys, *[c for c in [*left.columns, *right.columns] if c not in keys]]
    return later_right.filter((lo >= F.col(ls)) & (lo <= F.col(le))).select(*cols).unionByName(
        later_left.filter((F.col(ls) > lo) & (F.col(ls) <= hi)).select(*cols)
    )


def contained(
    words: DataFrame,
    segments: DataFrame,
    keys: list[str],
    word_span: tuple[str, str],
    segment_span: tuple[str, str],
    bucket: int | float,
    slack: int | float = 0,
) -> DataFrame:
    """Pairs where the word lies inside the segment widened by ``slack`` on both sides.

    A word looks up the dyadic blocks that hold its start; ``bucket`` is the finest one.
    """
    (ws, we), (ss, se) = word_span, segment_span
    lo, hi = F.col(ss) - slack, F.col(se) + slack
    blocks = dyadic(_coarse(lo, bucket), _coarse(hi, bucket) + 1).alias("__blocks")
    met = _met(words.select("*", _coarse(F.col(ws), bucket).alias("__at")), segments.filter(hi >= lo).select("*", blocks), keys)
    return met.filter((F.col(ws) >= lo) & (F.col(we) <= hi)).select(
        *keys, *[c for c in [*words.columns, *segments.columns] if c not in keys]
    )


def time_buckets(
    segments: DataFrame,
    keys: list[str],
    duration: str,
    width: int,
    early: int = 0,
    start: str = "start_ms",
    end: str = "end_ms",
    index: str = "seg_idx",
) -> DataFrame:
    """Lookup table: fixed-width bucket -> last listed segment that touches it."""
    first = F.floor(F.greatest(F.col(start) - early, F.lit(0)) / width)
    count = F.ceil(F.col(duration) / width) + 1
    last = F.least(F.ceil(F.col(end) / width), count) - 1
    return (
        segments.filter(last >= first)
        .withColumn("bucket", F.explode(F.sequence(first, last)))
        .groupBy(*keys, "bucket")
        .agg(F.max(index).alias(index))
    )
