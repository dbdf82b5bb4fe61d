"""Nested subtitle documents: scan, catalog, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexicue import schemas


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def video_and_model(path: Column) -> list[Column]:
    """``video_N_model.json`` -> (video, model); a name without a suffix is the baseline."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    video = F.regexp_extract(stem, r"^(video_\d+)", 1)
    model = F.regexp_extract(stem, r"^video_\d+_(.+)$", 1)
    return [video.alias("file_video"), F.when(model == "", "baseline").otherwise(model).alias("model")]


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document file, with the video and model its name gives."""
    docs = spark.read.schema(schemas.DOCUMENT).option("multiLine", True).json(folder)
    return docs.select("*", *video_and_model(F.col("_metadata.file_path")), F.col("_metadata.file_size").alias("file_size"))


def segment_text(segment: Column) -> Column:
    """Text of the detections, or the segment's own text in documents without detections."""
    shown = F.array_join(F.transform(segment["detections"], lambda d: d["text"]), "")
    return F.coalesce(F.when(segment["detections"].isNotNull(), shown), segment["text"])


def segments(documents: DataFrame) -> DataFrame:
    return documents.select(
        "file_video", "model", "duration_ms", "subtitle_source", F.posexplode("segments").alias("seg_idx", "s")
    ).select(
        F.col("file_video").alias("video"), "model", "duration_ms", "subtitle_source", "seg_idx",
        "s.start_ms", "s.end_ms", "s.source", "s.spoken", segment_text(F.col("s")).alias("text"), "s.detections",
    )


def detections(segs: DataFrame) -> DataFrame:
    return segs.select(
        "video", "model", "seg_idx", "start_ms", "end_ms", F.posexplode("detections").alias("det_idx", "d")
    ).select("video", "model", "seg_idx", "start_ms", "end_ms", "det_idx", "d.text", "d.confidence", "d.bbox", "d.chars")


def char_boxes(dets: DataFrame) -> DataFrame:
    return dets.select("video", "model", "seg_idx", "det_idx", F.posexplode("chars").alias("char_idx", "c")).select(
        "video", "model", "seg_idx", "det_idx", "char_idx", "c.*"
    )


def catalog(spark: SparkSession, folder: str, suffix: str = ".mp4") -> DataFrame:
    """Files of one kind with their size in MB; cleaned and silent copies are left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    name = file_name(F.col("path"))
    return files.select(name.alias("file_name"), F.bround(F.col("length") / 1048576, 2).alias("size_mb")).filter(
        ~F.contains("file_name", F.lit("_clean")) & ~F.contains("file_name", F.lit("_noaudio"))
    )


def speech_segments(transcripts: DataFrame) -> DataFrame:
    """Speech results in float seconds to millisecond segments, blanks dropped."""
    s = F.col("s")
    return transcripts.select("video", F.posexplode("segments").alias("seg_idx", "s")).select(
        "video", "seg_idx", F.regexp_replace(s["text"], r"(?U)^\s+|\s+$", "").alias("text"),
        (s["start"] * 1000).cast("bigint").alias("start_ms"), (s["end"] * 1000).cast("bigint").alias("end_ms"),
    ).filter("text <> ''")
