"""Batch runs of the streaming functions, and streams driven over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexicue.operators.scans import Look, chunk_of, scan
from lexicue.operators.staging import materialized
from lexicue.plans import standins as S
from lexicue.plans.registry import JOBS, job
from lexicue.plans.sequence import turn_frames
from lexicue.session import pin_utc, shared_dir
from lexicue.sinks.stored import StoredTable
from lexicue.sources.tables import table
from lexicue.streaming import streams as St


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _event_stream(spark, folder):
    pin_utc(spark)
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # a pattern matches a single file as well as a folder of files; a stream takes no plain file path
    return (
        spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


@job("view_counts_60s", """
SELECT user_id, epoch_us(time_bucket(INTERVAL 60 SECONDS, ts)) // 1000 AS window_ms, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY ALL""")
def view_counts_60s(spark, folder):
    v = _events(spark, folder).filter("event_type = 'view'")
    return St.view_counts(v, "ts", "user_id").select("user_id", F.unix_millis("window_start").alias("window_ms"), "views")


@job("daily_counters", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS videos, count(*) FILTER (event_type = 'click') AS cards FROM events GROUP BY ALL""")
def daily_counters(spark, folder):
    kind = lambda k: F.col("event_type") == k
    d = St.daily_counters(_events(spark, folder), "ts", "user_id", {"videos": kind("view"), "cards": kind("click")})
    return d.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@job("missed_runs", S.with_views("ev", body="""
, a AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms) > 7200000 THEN 1 ELSE 0 END AS flag FROM ev WHERE event_type <> 'error'),
b AS (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS run FROM a)
SELECT user_id, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM b GROUP BY user_id, run""").replace(")\n\n,", "),\n"))
def missed_runs(spark, folder):
    e = _events(spark, folder).filter("event_type <> 'error'").withColumn("ts", F.date_trunc("millisecond", "ts"))
    r = St.runs(e, "ts", "user_id", 2 * S.HOUR)
    return r.select("user_id", "n", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"))


@job("view_dedup", """
SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS video_id, epoch_us(min(ts)) // 1000 AS first_ms FROM events WHERE event_type = 'view' GROUP BY ALL""")
def view_dedup(spark, folder):
    v = S.ev(spark, folder).filter("event_type = 'view'")
    return v.groupBy("user_id", F.col("k").alias("video_id")).agg(F.min("ts_ms").alias("first_ms"))


@job("latest_message", """
SELECT conv_id AS chat, arg_max(text, turn) AS last_text, max(turn) AS last_ts FROM conversations GROUP BY ALL""")
def latest_message(spark, folder):
    m = table(spark, folder, "conversations", "conv_id", "turn", "text").withColumnRenamed("conv_id", "chat")
    return St.latest_message(m, "chat", "turn", "text")


@job("chats_of_member", """
SELECT chat, n FROM (SELECT conv_id AS chat, count(*) AS n, bool_or(role = 'system') AS has FROM conversations GROUP BY ALL) WHERE has""")
def chats_of_member(spark, folder):
    """Chats whose member list holds the system; roles are the members, of which there are three."""
    c = table(spark, folder, "conversations", "conv_id", "role")
    chats = c.groupBy(F.col("conv_id").alias("chat")).agg(F.collect_set("role").alias("members"), F.count("*").alias("n"))
    return chats.filter(F.array_contains("members", "system")).select("chat", "n")


READY = """
, r AS (SELECT k AS id, ts_ms, CASE WHEN event_type = 'purchase' THEN 'ready' ELSE 'processing' END AS status, event_id FROM ev),
p AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY ts_ms, event_id) AS prev FROM r)
SELECT id, ts_ms FROM p WHERE status = 'ready' AND coalesce(prev, '') <> 'ready'"""


def _status(e):
    return e.select(F.col("k").alias("id"), "ts_ms", F.when(F.col("event_type") == "purchase", "ready").otherwise("processing").alias("status"))


@job("ready_changes", S.with_views("ev", body=READY).replace(")\n\n,", "),\n"))
def ready_changes(spark, folder):
    e = S.ev(spark, folder)
    rows = scan(_status(e), ["id"], ["ts_ms"], [Look("prev", F.col("status"), inclusive=False)], chunk_of(F.col("ts_ms"), S.DAY))
    return rows.filter((F.col("status") == "ready") & (F.coalesce("prev", F.lit("")) != "ready")).select("id", "ts_ms")


@job("stream_latest_views", """
SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS video_id, arg_max(event_id, ts) AS event_id, epoch_us(max(ts)) // 1000 AS ts_ms FROM events GROUP BY ALL""")
def stream_latest_views(spark, folder):
    """A stream over the events table merged into a keyed table: last write wins per user and video.

    The stream runs until its input is used up; the table lives in the shared folder.
    """
    path = f"{shared_dir(spark)}/views-{uuid.uuid4().hex}"
    e = _event_stream(spark, folder).select(
        "user_id", F.get_json_object("props", "$.k").cast("int").alias("video_id"), "event_id", F.unix_millis("ts").alias("ts_ms"))
    return _drained(spark, e, ["user_id", "video_id"], F.struct("ts_ms", "event_id"), path, "append")


#: A backfill reads files in any order, so no row of it is late.
BACKFILL = "36500 days"


def _drained(spark, stream, keys, order, path, mode):
    """Run the stream until its input is used up and read the stored table that its batches were merged into."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    q = (
        stream.writeStream.foreachBatch(St.stored_sink(f"{path}/table", keys, schema, order)).outputMode(mode)
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return StoredTable(spark, f"{path}/table", keys, schema).read()


@job("stream_view_counts", JOBS["view_counts_60s"].sql)
def stream_view_counts(spark, folder):
    """The counter flush as a stream: each update of a window replaces its row in the keyed table. Windows end with the watermark."""
    path = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    v = S.ev(spark, folder).filter("event_type = 'view'").select("user_id", "ts_ms")
    counts = St.view_counts(_arriving(spark, v, path, (-1, NEVER_MS)), "ts", "user_id", late=LATE)
    counts = counts.select("user_id", F.unix_millis("window_start").alias("window_ms"), "views")
    return _drained(spark, counts, ["user_id", "window_ms"], F.col("views"), path, "update").filter("user_id <> -1")


@job("stream_daily_counters", JOBS["daily_counters"].sql)
def stream_daily_counters(spark, folder):
    path = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    kind = lambda k: F.col("event_type") == k
    e = _arriving(spark, S.ev(spark, folder).select("user_id", "event_type", "ts_ms"), path, (-1, "", NEVER_MS))
    d = St.daily_counters(e, "ts", "user_id", {"videos": kind("view"), "cards": kind("click")}, late=LATE)
    d = d.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return _drained(spark, d, ["user_id", "day"], F.col("videos") + F.col("cards"), path, "update").filter("user_id <> -1")


# --- keyed state over rows that arrive out of order -------------------------------------------
#: Rows arrive up to this much after their time; the watermark waits for longer.
SPREAD_MS, LATE = 6 * S.HOUR, "8 hours"
SLICES = 4
#: Files of a slice, whatever its size, and those a batch takes: the number of batches does not grow with the input.
FILES, TOGETHER = 32, 64


def _arriving(spark, df, path, end):
    """A stream over files written in order of arrival, out of time order; ``end`` is a last row that lets the watermark pass all."""
    # stored once, as each slice reads it
    rows = materialized(df.withColumn("__arrives", F.col("ts_ms") + F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD_MS))))
    low, high = rows.agg(F.min("__arrives"), F.max("__arrives")).first()
    width = (high - low) // SLICES + 1 if low is not None else 1
    slices = rows.withColumn("__slice", F.floor((F.col("__arrives") - F.lit(low or 0)) / width))
    for i in range(SLICES):
        slices.filter(F.col("__slice") == i).drop("__arrives", "__slice").repartition(FILES).write.mode("append").parquet(f"{path}/source")
    spark.createDataFrame([end], df.schema).write.mode("append").parquet(f"{path}/source")
    files = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", TOGETHER).parquet(f"{path}/source")
    return files.withColumn("ts", F.timestamp_millis("ts_ms"))


def _appended(spark, stream, path):
    """Run the stream until its files are used up and read what it has appended. Keyed state needs the RocksDB store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, St.ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


#: Far after all rows.
NEVER_MS = 4_000_000_000_000


@job("stream_ready_changes", S.with_views("ev", body=READY).replace(")\n\n,", "),\n"))
def stream_ready_changes(spark, folder):
    """Notices of items that turn ready, from a stream whose rows come up to six hours out of order."""
    path = f"{shared_dir(spark)}/ready-{uuid.uuid4().hex}"
    status = F.when(F.col("event_type") == "purchase", "ready").otherwise("processing")
    changes = S.ev(spark, folder).select(F.col("k").cast("bigint").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), "ts_ms")
    stream = St.ready_notices(_arriving(spark, changes, path, (-1, 0, "processing", NEVER_MS)), "ts", LATE, keep_ms=400 * S.DAY)
    return _appended(spark, stream, path).select(F.col("id").cast("int").alias("id"), "ts_ms")


@job("stream_review_sessions", S.with_views("ev", "reviews", body="""
, a AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w > 43200000 THEN 1 ELSE 0 END AS flag FROM reviews WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, review_id)),
b AS (SELECT *, sum(flag) OVER w AS session FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, review_id)),
c AS (SELECT *, sum(CASE WHEN rating >= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, session ORDER BY ts_ms, review_id) AS run FROM b),
s AS (SELECT user_id, session, run, count(*) FILTER (rating >= 3) AS n FROM c GROUP BY ALL),
t AS (SELECT user_id, session, max(n) AS best_streak FROM s GROUP BY ALL)
SELECT user_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(DISTINCT card_id) AS reviewed, count(*) FILTER (rating >= 3) AS correct, any_value(best_streak) AS best_streak
FROM c JOIN t USING (user_id, session) GROUP BY user_id, session""").replace(")\n\n,", "),\n"))
def stream_review_sessions(spark, folder):
    """Sessions of each user, ended by twelve hours without a review."""
    path = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    reviews = S.reviews(spark, folder).select(
        F.col("user_id").alias("session"), "review_id", F.col("card_id").cast("bigint").alias("card_id"), F.col("rating").cast("bigint").alias("rating"),
        "ts_ms", (F.col("ts_ms") + F.col("card_id") * 60_000).cast("bigint").alias("due_ms"))
    stream = St.review_sessions(_arriving(spark, reviews, path, (-1, 0, 0, 1, NEVER_MS, NEVER_MS)), "ts", 12 * S.HOUR, LATE)
    return _appended(spark, stream, path).filter("session <> -1").select(
        F.col("session").alias("user_id"), "start_ms", "end_ms", "reviewed", "correct", "best_streak")


@job("stream_segments", JOBS["fuzzy_collapse"].sql)
def stream_segments(spark, folder):
    """Frames to segments as they arrive; the fold is that of the batch job."""
    path = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    frames = turn_frames(spark, folder).select("video", "ts_ms", "text")
    stream = St.build_segments(_arriving(spark, frames, path, (-1, NEVER_MS, "")), "ts", 100, 500, LATE)
    return _appended(spark, stream, path).select(
        "video", "start_ms", "end_ms", F.col("text").alias("match_text"), F.floor(F.col("last_ms") / 100).alias("last_frame"))
