"""Nested documents built from, and flattened back to, rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexicue import schemas
from lexicue.plans import standins as S
from lexicue.plans.registry import job
from lexicue.session import shared_dir
from lexicue.sinks import writers as Wr
from lexicue.sources import subtitles as Sub
from lexicue.sources.tables import table


def _documents(spark, folder):
    """Turns as stored documents, one file per conversation, kind by its number: the texts of the files."""
    det = F.struct(F.col("text").alias("text"), (F.col("confidence") / 100.0).alias("confidence"),
                   F.struct(F.lit(0).alias("x"), F.col("y").cast("int").alias("y"), F.length("text").alias("width"), F.lit(40).alias("height")).alias("bbox"))
    d = S.ocr_dets(spark, folder)
    segs = d.groupBy("video", "seg_idx", "start_ms", "end_ms").agg(F.array_sort(F.collect_list(F.struct("det_idx", det.alias("d")))).alias("x")).select(
        "video", F.when(F.col("video") % 2 == 0, "bboxes").otherwise("transcript").alias("kind"), "seg_idx", "start_ms", "end_ms",
        F.transform("x", lambda s: s["d"]).alias("detections"))
    meta = segs.groupBy("video").agg((F.max("end_ms") + 100).alias("duration_ms"))
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    Wr.write_documents(segs, meta, path)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"), F.input_file_name().alias("path"))


DOCUMENT = "video bigint, duration_ms bigint, segments array<struct<start_ms:bigint,end_ms:bigint,detections:array<struct<text:string>>>>"


@job("document_rebuild", S.with_views("ocr_dets", body="""
SELECT video, CASE WHEN video % 2 = 0 THEN 'bboxes' ELSE 'transcript' END AS kind, max(end_ms) + 100 AS duration_ms, count(DISTINCT seg_idx) AS segments,
 count(*) AS detections, md5(string_agg(text, '#' ORDER BY seg_idx, det_idx)) AS text_md5 FROM ocr_dets GROUP BY ALL"""))
def document_rebuild(spark, folder):
    """Rows to documents in files; their text is checked in document order."""
    docs = _documents(spark, folder).select(F.from_json("json", DOCUMENT).alias("d"), F.regexp_extract("path", r"_([a-z]+)\.json$", 1).alias("kind")).select("d.*", "kind")
    dets = F.flatten(F.transform("segments", lambda s: s["detections"]))
    return docs.select("video", "kind", "duration_ms", F.size("segments").cast("bigint").alias("segments"), F.size(dets).cast("bigint").alias("detections"),
                       F.md5(F.array_join(F.transform(dets, lambda d: d["text"]), "#")).alias("text_md5"))


@job("document_scan", S.with_views("ocr_dets", body="""
SELECT 'video_' || video AS video, CASE WHEN video % 2 = 0 THEN 'dense' ELSE 'baseline' END AS model, CAST(seg_idx AS INTEGER) AS seg_idx, CAST(start_ms AS INTEGER) AS start_ms, CAST(end_ms AS INTEGER) AS end_ms,
 md5(string_agg(text, '' ORDER BY det_idx)) AS text_md5 FROM ocr_dets GROUP BY video, seg_idx, start_ms, end_ms"""))
def document_scan(spark, folder):
    """Documents as JSON text parsed with the declared superset schema, then flattened."""
    named = F.regexp_replace(F.regexp_replace("path", r"([0-9]+)_bboxes\.json$", "video_$1_dense.json"), r"([0-9]+)_transcript\.json$", "video_$1.json")
    docs = _documents(spark, folder).select("json", named.alias("path"))
    parsed = docs.select(F.from_json("json", schemas.DOCUMENT).alias("d"), *Sub.video_and_model(F.col("path"))).select("d.*", "file_video", "model")
    return Sub.segments(parsed).select("video", "model", "seg_idx", "start_ms", "end_ms", F.md5("text").alias("text_md5"))


@job("timed_captions", """
SELECT conv_id AS video, md5('WEBVTT' || chr(10) || chr(10) || string_agg(strftime(make_timestamp(turn * 3000000), '%H:%M:%S.%g') || ' --> ' || strftime(make_timestamp((turn * 3000 + 500 + length(text) % 4000) * 1000), '%H:%M:%S.%g') || chr(10) || text,
  chr(10) || chr(10) ORDER BY turn) || chr(10)) AS captions_md5 FROM conversations GROUP BY ALL""")
def timed_captions(spark, folder):
    from lexicue.plans.vocab import segments

    path = f"{shared_dir(spark)}/captions-{uuid.uuid4().hex}"
    Wr.write_captions(segments(spark, folder).select("video", "seg_idx", "start_ms", "end_ms", "text"), path)
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([0-9]+)\.vtt$", 1).cast("bigint").alias("video"), F.md5("value").alias("captions_md5"))


@job("speech_layout", """
SELECT conv_id AS video, turn AS seg_idx, turn * 3000 AS start_ms, turn * 3000 + 1999 AS end_ms, length(trim(text, ' ' || chr(10))) AS n FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''""")
def speech_layout(spark, folder):
    """Speech results in seconds to segments in whole milliseconds, truncated."""
    s = F.struct("text", (F.col("turn") * 3.0).alias("start"), (F.col("turn") * 3.0 + 1.9999).alias("end"))
    t = table(spark, folder, "conversations", "conv_id", "turn", "text").select(F.col("conv_id").alias("video"), "turn", F.array(s).alias("segments"))
    flat = Sub.speech_segments(t.withColumn("video", F.struct("video", "turn")))
    return flat.select("video.video", F.col("video.turn").alias("seg_idx"), "start_ms", "end_ms", F.length("text").cast("bigint").alias("n"))


@job("file_listing")
def file_listing(spark, folder):
    """Table files with their size in MB, by listing only."""
    return Sub.catalog(spark, folder, ".parquet").orderBy("file_name")
