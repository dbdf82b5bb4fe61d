"""Interval lookups and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicue.operators import intervals as I
from lexicue.plans import standins as S
from lexicue.plans.registry import job


@job(
    "covering_segment",
    S.with_views("ev", "segs", "points", body="""
SELECT p.video, p.point_id, p.at_ms, coalesce(arg_min(s.seg_idx, CAST(s.start_ms AS HUGEINT) * 10000000 + s.seg_idx), -1) AS seg_idx
FROM points p LEFT JOIN segs s ON s.video = p.video AND p.at_ms >= s.start_ms AND p.at_ms < s.end_ms
GROUP BY ALL"""),
)
def covering_segment(spark, folder):
    found = I.covering(S.points(spark, folder), S.segs(spark, folder), ["video"], "at_ms", chunk_width=S.DAY)
    return found.select(
        "video", "point_id", "at_ms", F.coalesce("segment.seg_idx", F.lit(-1)).alias("seg_idx")
    )


@job(
    "covering_any_order",
    S.with_views("ev", "segs", "points", body="""
, listed AS (SELECT *, CASE WHEN seg_idx % 3 = 0 THEN -1 - seg_idx ELSE seg_idx END AS place FROM segs)
SELECT p.video, p.point_id, p.at_ms, arg_min(s.seg_idx, s.place) AS seg_idx
FROM points p LEFT JOIN listed s ON s.video = p.video AND p.at_ms >= s.start_ms AND p.at_ms < s.end_ms
GROUP BY ALL""").replace(")\n\n,", "),\n"),
)
def covering_any_order(spark, folder):
    """The first listed cover where the list has another order than the starts: every third segment comes first, the last such before others."""
    place = F.when(F.col("seg_idx") % 3 == 0, -1 - F.col("seg_idx")).otherwise(F.col("seg_idx"))
    listed = S.segs(spark, folder).withColumn("place", place)
    found = I.covering(S.points(spark, folder), listed, ["video"], "at_ms", index="place", payload=["seg_idx"], chunk_width=S.DAY)
    return found.select("video", "point_id", "at_ms", F.col("segment.seg_idx").alias("seg_idx"))


@job(
    "nearest_segment",
    S.with_views("ev", "segs", "points", body="""
SELECT video, point_id, seg_idx, distance_ms FROM (
  SELECT p.video, p.point_id, s.seg_idx,
         least(abs(p.at_ms - s.start_ms), abs(p.at_ms - s.end_ms)) AS distance_ms,
         row_number() OVER (PARTITION BY p.point_id
           ORDER BY least(abs(p.at_ms - s.start_ms), abs(p.at_ms - s.end_ms)), s.seg_idx) AS rn
  FROM points p JOIN segs s ON s.video = p.video) WHERE rn = 1"""),
)
def nearest_segment(spark, folder):
    found = I.nearest(S.points(spark, folder), S.segs(spark, folder), ["video"], "at_ms", chunk_width=S.DAY)
    return found.filter("segment IS NOT NULL").select(
        "video", "point_id", "segment.seg_idx", F.col("segment.distance").alias("distance_ms")
    )


@job(
    "hold_last",
    S.with_views("ev", "segs", "points", body="""
SELECT p.video, p.point_id, coalesce(
  (SELECT arg_min(s.seg_idx, CAST(s.start_ms AS HUGEINT) * 10000000 + s.seg_idx) FROM segs s
    WHERE s.video = p.video AND p.at_ms >= s.start_ms AND p.at_ms < s.end_ms),
  (SELECT max(s.seg_idx) FROM segs s WHERE s.video = p.video AND s.end_ms <= p.at_ms), -1) AS active_idx
FROM points p"""),
)
def hold_last(spark, folder):
    return I.hold_last(
        S.points(spark, folder), S.segs(spark, folder), ["video"], "at_ms", chunk_width=S.DAY
    ).select("video", "point_id", "active_idx")


@job(
    "overlap_join",
    S.with_views("ev", "segs", "segs2", body="""
SELECT a.video, a.seg_idx AS left_idx, b.seg_idx AS right_idx
FROM segs a JOIN segs2 b ON a.video = b.video
 AND b.end_ms + 500 >= a.start_ms AND b.start_ms - 500 <= a.end_ms"""),
)
def overlap_join(spark, folder):
    left = S.segs(spark, folder).select(
        "video", F.col("seg_idx").alias("left_idx"), F.col("start_ms").alias("ls"), F.col("end_ms").alias("le")
    )
    right = S.segs(spark, folder, "purchase").select(
        "video", F.col("seg_idx").alias("right_idx"), F.col("start_ms").alias("rs"), F.col("end_ms").alias("re")
    )
    return I.overlapping(left, right, ["video"], ("ls", "le"), ("rs", "re"), S.DAY, 500).select(
        "video", "left_idx", "right_idx"
    )


SPEECH_WORDS = """
SELECT user_id AS video, event_id AS word_id, ts_ms / 1000.0 AS w_start, ts_ms / 1000.0 + k * 60 AS w_end
FROM ev WHERE event_type = 'signup'"""
S.SQL["speech_words"] = SPEECH_WORDS


def speech_words(spark, folder):
    return (
        S.ev(spark, folder)
        .filter("event_type = 'signup'")
        .select(
            F.col("user_id").alias("video"),
            F.col("event_id").alias("word_id"),
            (F.col("ts_ms") / 1000.0).alias("w_start"),
            (F.col("ts_ms") / 1000.0 + F.col("k") * 60).alias("w_end"),
        )
    )


@job(
    "words_in_segment",
    S.with_views("ev", "segs", "speech_words", body="""
SELECT w.video, w.word_id, s.seg_idx FROM speech_words w JOIN segs s ON s.video = w.video
 AND w.w_start >= s.start_ms / 1000.0 - 0.05 AND w.w_end <= s.end_ms / 1000.0 + 0.05"""),
)
def words_in_segment(spark, folder):
    segments = S.segs(spark, folder).select(
        "video", "seg_idx", (F.col("start_ms") / 1000.0).alias("s0"), (F.col("end_ms") / 1000.0).alias("s1")
    )
    return I.contained(
        speech_words(spark, folder), segments, ["video"], ("w_start", "w_end"), ("s0", "s1"), 86400, 0.05
    ).select("video", "word_id", "seg_idx")


@job(
    "time_buckets_early",
    S.with_views("ocr_dets", body="""
, s AS (SELECT video, seg_idx, min(start_ms) AS start_ms, min(end_ms) AS end_ms FROM ocr_dets GROUP BY ALL),
d AS (SELECT video, max(end_ms) AS duration FROM s GROUP BY ALL),
b AS (SELECT s.video, s.seg_idx, unnest(range(CAST(floor(greatest(0, start_ms - 50) / 33) AS BIGINT),
   CAST(least(ceil(end_ms / 33), ceil(duration / 33) + 1) AS BIGINT))) AS bucket FROM s JOIN d USING (video))
SELECT video, bucket, max(seg_idx) AS seg_idx FROM b GROUP BY ALL""").replace(")\n\n,", "),\n"),
)
def time_buckets_early(spark, folder):
    return I.time_buckets(_timed(spark, folder), ["video"], "duration", 33, early=50)


@job(
    "time_buckets",
    S.with_views("ocr_dets", body="""
, s AS (SELECT video, seg_idx, min(start_ms) AS start_ms, min(end_ms) AS end_ms FROM ocr_dets GROUP BY ALL),
d AS (SELECT video, max(end_ms) AS duration FROM s GROUP BY ALL),
b AS (SELECT s.video, s.seg_idx, unnest(range(CAST(floor(start_ms / 50) AS BIGINT),
   CAST(least(ceil(end_ms / 50), ceil(duration / 50) + 1) AS BIGINT))) AS bucket FROM s JOIN d USING (video))
SELECT video, bucket, max(seg_idx) AS seg_idx FROM b GROUP BY ALL""").replace(")\n\n,", "),\n"),
)
def time_buckets(spark, folder):
    return I.time_buckets(_timed(spark, folder), ["video"], "duration", 50)


def _timed(spark, folder):
    s = S.ocr_dets(spark, folder).groupBy("video", "seg_idx").agg(
        F.min("start_ms").alias("start_ms"), F.min("end_ms").alias("end_ms")
    )
    return s.join(s.groupBy("video").agg(F.max("end_ms").alias("duration")), "video")
