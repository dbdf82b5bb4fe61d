"""Distributed writes. Nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexicue.sinks import files


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None, **defaults: Column) -> None:
    """Append rows with default columns filled in; long files are split by row count."""
    for name, value in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    writer = rows.write.mode("append").option("maxRecordsPerFile", 5_000_000)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_documents(segments: DataFrame, meta: DataFrame, path: str) -> None:
    """Flat segments (``video, kind, seg_idx, start_ms, end_ms, detections``) to one JSON document per video and kind.

    ``meta`` has one row per video. Segments stream into their file in order; a video is never held as one row.
    Files are named ``<video>_<kind>.json``.
    """
    m = [c for c in meta.columns if c != "video"]
    about = F.to_json(F.struct("video", *m))
    head = F.concat(F.substring(about, F.lit(1), F.length(about) - 1), F.lit(',"segments":['))
    rows = segments.join(meta, "video")
    name = F.concat(F.col("video").cast("string"), F.lit("_"), F.col("kind"), F.lit(".json"))
    text = F.to_json(F.struct("start_ms", "end_ms", "detections"))
    files.write(rows, name, [F.col("seg_idx")], head, text, ",", "]}", path)


def clock(ms: Column) -> Column:
    """``hh:mm:ss.mmm``"""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    s = F.floor(ms / 1000)
    return F.concat(
        pad(F.floor(s / 3600), 2), F.lit(":"), pad(F.floor(s / 60) % 60, 2), F.lit(":"), pad(s % 60, 2), F.lit("."), pad(ms % 1000, 3)
    )


def write_captions(segments: DataFrame, path: str) -> None:
    """One timed-caption file ``<video>.vtt`` per video from ``video, seg_idx, start_ms, end_ms, text``, streamed in order."""
    cue = F.concat(clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"), F.col("text"))
    name = F.concat(F.col("video").cast("string"), F.lit(".vtt"))
    files.write(segments, name, [F.col("start_ms"), F.col("seg_idx")], F.lit("WEBVTT\n\n"), cue, "\n\n", "\n", path)
