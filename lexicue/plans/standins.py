"""Views that give the general tables the shape of videos, frames, segments, words and reviews.

Every view has a SQL twin in ``SQL`` for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexicue.sources.tables import table

HOUR = 3_600_000
DAY = 24 * HOUR

SQL: dict[str, str] = {}


def with_views(*names: str, body: str) -> str:
    """``body`` preceded by the named views (in order)."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body


def millis(col: str):
    return F.unix_millis(F.col(col).cast("timestamp"))


# --- events ---------------------------------------------------------------------------------
SQL["ev"] = """
SELECT event_id, user_id, epoch_us(ts) // 1000 AS ts_ms, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
FROM events"""


def ev(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        millis("ts").alias("ts_ms"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


# Frames: one per event; error events show no text.
SQL["frames"] = """
SELECT user_id AS video, event_id AS frame_id, ts_ms,
       CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS text
FROM ev"""


def frames(spark, folder) -> DataFrame:
    return ev(spark, folder).select(
        F.col("user_id").alias("video"),
        F.col("event_id").alias("frame_id"),
        "ts_ms",
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"),
    )


# Segments: view events as intervals of half an hour per unit of value.
SQL["segs"] = """
SELECT user_id AS video, event_id AS seg_idx, ts_ms AS start_ms,
       ts_ms + CAST(round_even(value * 100, 0) AS BIGINT) * 18000 AS end_ms, k
FROM ev WHERE event_type = 'view'"""


def segs(spark, folder, kind: str = "view") -> DataFrame:
    return (
        ev(spark, folder)
        .filter(F.col("event_type") == kind)
        .select(
            F.col("user_id").alias("video"),
            F.col("event_id").alias("seg_idx"),
            F.col("ts_ms").alias("start_ms"),
            (F.col("ts_ms") + F.bround(F.col("value") * 100, 0).cast("bigint") * 18000).alias("end_ms"),
            "k",
        )
    )


# A second segment set, for overlaps.
SQL["segs2"] = SQL["segs"].replace("'view'", "'purchase'")

# Points: click events.
SQL["points"] = """
SELECT user_id AS video, event_id AS point_id, ts_ms AS at_ms FROM ev WHERE event_type = 'click'"""


def points(spark, folder) -> DataFrame:
    return (
        ev(spark, folder)
        .filter(F.col("event_type") == "click")
        .select(
            F.col("user_id").alias("video"), F.col("event_id").alias("point_id"), F.col("ts_ms").alias("at_ms")
        )
    )


# Reviews: every event rates card k of its user, 1..4.
SQL["reviews"] = """
SELECT event_id AS review_id, user_id, k AS card_id, ts_ms, k % 4 + 1 AS rating,
       CAST(floor(ts_ms / 86400000) AS BIGINT) AS day, value
FROM ev"""


def reviews(spark, folder) -> DataFrame:
    return ev(spark, folder).select(
        F.col("event_id").alias("review_id"),
        "user_id",
        F.col("k").alias("card_id"),
        "ts_ms",
        (F.col("k") % 4 + 1).alias("rating"),
        F.floor(F.col("ts_ms") / DAY).alias("day"),
        "value",
    )


# --- videos, cards, words -------------------------------------------------------------------
SQL["videos"] = """
SELECT o_orderkey AS id, o_custkey AS creator_id, o_orderstatus AS status, o_orderpriority AS language,
       epoch_us(o_orderdate) // 1000 AS created_ms, o_totalprice AS price
FROM orders"""


def videos(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("creator_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("language"),
        millis("o_orderdate").alias("created_ms"),
        F.col("o_totalprice").alias("price"),
    )


# Word occurrences: an order is a video, its lines are words, parts are the vocabulary.
SQL["video_words"] = """
SELECT l_orderkey AS video_id, l_partkey AS vocab_id, l_linenumber AS word_index,
       CAST(l_quantity AS BIGINT) * 100 AS start_ms, CAST(l_quantity AS BIGINT) * 100 + 400 AS end_ms,
       l_suppkey AS definition_source, l_returnflag AS flag, l_linestatus AS line_status
FROM lineitem"""


def video_words(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        F.col("l_partkey").alias("vocab_id"),
        F.col("l_linenumber").alias("word_index"),
        (F.col("l_quantity").cast("bigint") * 100).alias("start_ms"),
        (F.col("l_quantity").cast("bigint") * 100 + 400).alias("end_ms"),
        F.col("l_suppkey").alias("definition_source"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
    )


# Definitions: lines of status F give a definition of the part in the supplier's nation number.
SQL["definitions"] = """
SELECT l_partkey AS vocab_id, l_orderkey AS video_id, 'n' || CAST(s_nationkey % 3 AS VARCHAR) AS target_language,
       s_name || '/' || CAST(l_linenumber AS VARCHAR) AS translation,
       l_orderkey * 100000000 + l_suppkey * 100 + l_linenumber AS definition_id
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WHERE l_linestatus = 'F'"""


def definitions(spark, folder) -> DataFrame:
    lines = table(
        spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus"
    ).filter("l_linestatus = 'F'")
    sup = table(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey")
    return lines.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("vocab_id"),
        F.col("l_orderkey").alias("video_id"),
        F.concat(F.lit("n"), (F.col("s_nationkey") % 3).cast("string")).alias("target_language"),
        F.concat_ws("/", "s_name", F.col("l_linenumber").cast("string")).alias("translation"),
        (F.col("l_orderkey") * 100000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias(
            "definition_id"
        ),
    )


# --- subtitle corpora from conversations ------------------------------------------------------
# A conversation is a video, a turn a segment, a line of the turn a detection; the conversation's
# number is a watermark shown in every segment.
SQL["ocr_dets"] = """
SELECT conv_id AS video, turn AS seg_idx, turn * 3000 AS start_ms,
       turn * 3000 + 500 + length(text) % 4000 AS end_ms,
       det_idx, det.text AS text, det.y AS y, det.conf AS confidence
FROM (
  SELECT *, unnest(dets) AS det, unnest(range(len(dets))) AS det_idx FROM (
    SELECT conv_id, turn, text,
      [{'text': 'mark ' || CAST(conv_id AS VARCHAR), 'y': CAST(40 AS BIGINT), 'conf': CAST(99 AS BIGINT)}] ||
      list_transform(range(len(string_split(text, chr(10)))), lambda i:
        {'text': string_split(text, chr(10))[i + 1],
         'y': CAST(300 + 250 * (i % 4) AS BIGINT),
         'conf': CAST(40 + (length(string_split(text, chr(10))[i + 1]) * 7) % 60 AS BIGINT)}) AS dets
    FROM conversations))"""


def ocr_dets(spark, folder) -> DataFrame:
    lines = F.split("text", "\n")
    mark = F.struct(
        F.concat(F.lit("mark "), F.col("conv_id").cast("string")).alias("text"),
        F.lit(40).cast("bigint").alias("y"),
        F.lit(99).cast("bigint").alias("conf"),
    )
    body = F.transform(
        lines,
        lambda t, i: F.struct(
            t.alias("text"),
            (300 + 250 * (i % 4)).cast("bigint").alias("y"),
            (40 + (F.length(t) * 7) % 60).cast("bigint").alias("conf"),
        ),
    )
    return (
        table(spark, folder, "conversations", "conv_id", "turn", "text")
        .select(
            F.col("conv_id").alias("video"),
            F.col("turn").alias("seg_idx"),
            (F.col("turn") * 3000).alias("start_ms"),
            (F.col("turn") * 3000 + 500 + F.length("text") % 4000).alias("end_ms"),
            F.posexplode(F.concat(F.array(mark), body)).alias("det_idx", "det"),
        )
        .select(
            "video",
            "seg_idx",
            "start_ms",
            "end_ms",
            F.col("det_idx").cast("bigint").alias("det_idx"),
            F.col("det.text").alias("text"),
            F.col("det.y").alias("y"),
            F.col("det.conf").alias("confidence"),
        )
    )


# Speech: every turn's last line, a little later, without punctuation; system turns garbled.
SQL["speech"] = r"""
SELECT conv_id AS video, turn AS stt_idx, turn * 3000 + 300 AS start_ms,
       turn * 3000 + 300 + 400 + length(text) % 3000 AS end_ms,
       CASE WHEN role = 'system' THEN translate(last_line, 'aeioutnrs', '123456789') ELSE regexp_replace(last_line, '[.,]', '', 'g') END AS text
FROM (SELECT *, string_split(text, chr(10))[-1] AS last_line FROM conversations)"""


def speech(spark, folder) -> DataFrame:
    last = F.element_at(F.split("text", "\n"), -1)
    return table(spark, folder, "conversations", "conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("video"),
        F.col("turn").alias("stt_idx"),
        (F.col("turn") * 3000 + 300).alias("start_ms"),
        (F.col("turn") * 3000 + 300 + 400 + F.length("text") % 3000).alias("end_ms"),
        F.when(F.col("role") == "system", F.translate(last, "aeioutnrs", "123456789"))
        .otherwise(F.regexp_replace(last, "[.,]", ""))
        .alias("text"),
    )
