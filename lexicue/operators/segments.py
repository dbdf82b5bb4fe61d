"""Segment sets: persistent text, best match, merged transcript, coverage, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexicue import constants as K
from lexicue.functions import geometry as G
from lexicue.functions import text as T
from lexicue.operators import intervals as I
from lexicue.operators.collapse import drop_near_duplicates, gap_groups
from lexicue.operators.feed import top_per_key
from lexicue.operators.staging import materialized


def persistent_texts(
    detections: DataFrame, share: float = K.PERSISTENT_SHARE, segments: DataFrame | None = None
) -> DataFrame:
    """``(video, text, n_segments)`` of texts shown in at least ``share`` of a video's segments.

    ``segments`` lists all of them (``video, seg_idx``), those without a detection too; without it those with one count.

    Two aggregation levels: the pair (text, segment) is reduced before it is counted, so neither a long
    video nor a text shown everywhere gathers raw rows in one task.
    """
    shown = detections.select("video", "seg_idx", T.strip(F.col("text")).alias("text"))
    total = (shown if segments is None else segments).select("video", "seg_idx").distinct().groupBy("video").agg(F.count("*").alias("total"))
    per_text = shown.filter("text <> ''").distinct().groupBy("video", "text").agg(F.count("*").alias("n_segments"))
    return per_text.join(total, "video").filter(
        F.col("n_segments") / F.greatest("total", F.lit(1)) >= share
    ).select("video", "text", "n_segments")


def best_match(
    speech: DataFrame,
    detections: DataFrame,
    height: Column,
    tolerance: int = K.MERGE_TOLERANCE_MS,
    bucket: int = 4000,
    segments: DataFrame | None = None,
) -> DataFrame:
    """For each speech row the most similar detection that overlaps it in time.

    Speech: ``video, stt_idx, start_ms, end_ms, text``. Detections: ``video, seg_idx, det_idx, start_ms,
    end_ms, text, y``. Persistent texts and the upper part of the picture do not compete. Adds
    ``similarity``, ``matched_text`` (first listed wins ties), ``source`` and ``merged_text``.
    """
    said = speech.select(
        "video", "stt_idx", "start_ms", "end_ms", T.strip(F.col("text")).alias("text")
    ).filter("text <> ''")
    lasting = persistent_texts(detections, segments=segments).select("video", F.col("text").alias("det_text"))
    shown = (
        detections.filter(F.col("y") / height >= K.UPPER_AREA)
        .select(
            "video", "seg_idx", "det_idx", F.col("start_ms").alias("ocr_start"), F.col("end_ms").alias("ocr_end"),
            T.strip(F.col("text")).alias("det_text"),
        )
        .join(lasting, ["video", "det_text"], "left_anti")
    )
    # sets once per row, not per pair
    left = said.withColumn("said_set", T.char_set(F.col("text")))
    right = shown.withColumn("det_set", T.char_set(F.col("det_text")))
    pairs = I.overlapping(
        left.select("video", "stt_idx", "start_ms", "end_ms", "said_set"), right, ["video"],
        ("start_ms", "end_ms"), ("ocr_start", "ocr_end"), bucket, tolerance,
    ).withColumn("similarity", T.set_jaccard(F.col("said_set"), F.col("det_set")))
    best = (
        pairs.filter("similarity > 0")
        .groupBy("video", "stt_idx")
        .agg(
            F.max("similarity").alias("similarity"),
            F.max_by("det_text", F.struct("similarity", -F.col("seg_idx"), -F.col("det_idx"))).alias("matched_text"),
        )
    )
    accepted = F.coalesce(F.col("similarity"), F.lit(0.0)) >= K.MATCH_ACCEPT
    return said.join(best, ["video", "stt_idx"], "left").select(
        "video", "stt_idx", "start_ms", "end_ms",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.when(accepted, "ocr+stt").otherwise("stt_only").alias("source"),
        F.when(accepted, F.col("matched_text")).otherwise(F.col("text")).alias("text"),
    )


def merged_transcript(
    speech: DataFrame, detections: DataFrame, width: Column, height: Column, chunk: Column | None = None
) -> DataFrame:
    """Recognized text on speech timing, near-duplicate neighbours merged, with a caption layout."""
    merged = best_match(speech, detections, height).select(
        "video", "stt_idx", "start_ms", "end_ms", "source", "text"
    )
    kept = drop_near_duplicates(merged, ["video"], ["start_ms", "stt_idx"], chunk=chunk)
    return kept.withColumn("bbox", G.caption_layout(F.col("text"), width, height))


def coverage(segments: DataFrame, keys: list[str], duration: str) -> DataFrame:
    """Segments and share of the duration they cover; overlaps count twice, so it may pass 100 %."""
    return segments.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"),
        F.max(duration).alias("duration_ms"),
    ).withColumn(
        "coverage",
        F.when(F.col("duration_ms") > 0, F.bround(F.col("covered_ms") / F.col("duration_ms") * 100, 1)).otherwise(0.0),
    )


def diagnose(
    frames: DataFrame, segments: DataFrame, chunk_width: int | None = None
) -> DataFrame:
    """Text frames with their covering segment, or the nearest one, and the texts the segment lacks.

    Frames: ``video, frame_id, ts_ms, texts``. Segments: ``video, seg_idx, start_ms, end_ms, seg_texts``.
    """
    texted = frames.filter(F.size("texts") > 0)
    covered = I.covering(
        texted, segments, ["video"], "ts_ms", payload=["seg_texts"], chunk_width=chunk_width, out="seg"
    )
    return covered.select(
        "video", "frame_id", "ts_ms", "texts",
        F.col("seg.seg_idx").alias("seg_idx"),
        F.when(F.col("seg").isNotNull(), F.array_except("texts", "seg.seg_texts")).alias("new_texts"),
    )


def diagnosis_totals(diagnosed: DataFrame) -> DataFrame:
    covered = F.col("seg_idx").isNotNull()
    return diagnosed.groupBy("video").agg(
        F.count("*").alias("text_frames"),
        F.count_if(covered).alias("covered"),
        F.count_if(~covered).alias("missed"),
        F.count_if(F.size("new_texts") > 0).alias("mismatched"),
    ).withColumn("coverage", F.bround(F.col("covered") / F.greatest("text_frames", F.lit(1)) * 100, 1))


def missed_gaps(
    diagnosed: DataFrame, segments: DataFrame, interval: int, chunk_width: int | None = None
) -> DataFrame:
    """Groups of missed frames: span, first texts and the segment nearest to the first frame."""
    from lexicue.operators.scans import chunk_of

    # the report's rows are read by the grouping and by the nearest-segment lookup
    missed = materialized(diagnosed.filter("seg_idx IS NULL").select("video", "frame_id", "ts_ms", "texts"))
    chunk = chunk_of(F.col("ts_ms"), chunk_width) if chunk_width else None
    grouped = gap_groups(missed, ["video"], "ts_ms", 2 * interval, "frame_id", chunk, "gap")
    groups = grouped.groupBy("video", "gap").agg(
        F.min("ts_ms").alias("start_ms"),
        F.max("ts_ms").alias("end_ms"),
        F.min_by("texts", F.struct("ts_ms", "frame_id")).alias("first_texts"),
    ).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms") + interval)
    near = I.nearest(
        groups.withColumnRenamed("start_ms", "gap_start").withColumnRenamed("end_ms", "gap_end"),
        segments.select("video", "seg_idx", "start_ms", "end_ms"), ["video"], "gap_start", chunk_width=chunk_width,
    )
    return near.select(
        "video", F.col("gap_start").alias("start_ms"), F.col("gap_end").alias("end_ms"), "duration_ms",
        F.array_join("first_texts", " | ").alias("first_texts"),
        F.coalesce("segment.seg_idx", F.lit(-1)).alias("nearest_idx"),
        F.coalesce("segment.distance", F.lit(-1)).alias("distance_ms"),
    )


def first_mismatches(diagnosed: DataFrame, n: int = 10) -> DataFrame:
    bad = diagnosed.filter(F.size("new_texts") > 0)
    return top_per_key(bad, ["video"], [F.col("ts_ms"), F.col("frame_id")], n)


def first_title(detections: DataFrame) -> DataFrame:
    """First text of at least two characters per video, else ``Untitled``."""
    text = T.strip(F.col("text"))
    usable = F.length(text) >= 2
    return detections.groupBy("video").agg(
        F.coalesce(
            F.min_by(text, F.when(usable, F.struct("seg_idx", "det_idx"))), F.lit("Untitled")
        ).alias("title")
    )


def first_available(options: DataFrame, keys: list[str], priority: dict[str, int], kind: str) -> DataFrame:
    """Row of the best-ranked kind per key."""
    rank = F.lit(None).cast("int")
    for name, p in priority.items():
        rank = F.when(F.col(kind) == name, F.lit(p)).otherwise(rank)
    from lexicue.operators.tables import first_per_key

    return first_per_key(options.filter(F.col(kind).isin(list(priority))), keys, rank)


def source_vote(frames: DataFrame, durations: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``ocr`` when at least two of the sampled moments show text, else ``stt``.

    Frames: ``video, ts_ms, has_text``; each sample takes the last frame at or before it.
    """
    from lexicue.operators.scans import asof

    samples = durations.select(
        "video", F.explode(F.array(*[(F.col("duration_ms") * p).cast("bigint") for p in at])).alias("at_ms")
    )
    seen = asof(samples, frames, ["video"], "at_ms", "ts_ms", ["has_text"], {"hit": ("backward", False)})
    votes = seen.groupBy("video").agg(F.count_if(F.coalesce("hit.has_text", F.lit(False))).alias("votes"))
    return votes.withColumn("source", F.when(F.col("votes") >= 2, "ocr").otherwise("stt"))
