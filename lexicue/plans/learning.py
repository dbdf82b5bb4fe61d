"""Reviews, streaks, progress, sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicue.functions import labels
from lexicue.operators import learning as L
from lexicue.operators import tables as Tb
from lexicue.operators.scans import chunk_of
from lexicue.plans import standins as S
from lexicue.plans.registry import job
from lexicue.sources.tables import table

ORDER = ["ts_ms", "review_id"]


def _chunk():
    return chunk_of(F.col("ts_ms"), S.DAY)


RUNS = """
, r AS (SELECT *, sum(CASE WHEN rating < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_ms, review_id) AS run FROM reviews),
g AS (SELECT user_id, run, count(*) FILTER (rating >= 3) AS n FROM r GROUP BY ALL)
"""


def views(*names, body):
    return S.with_views(*names, body=body).replace(")\n\n,", "),\n")


@job("best_streak", views("ev", "reviews", body=RUNS + """
SELECT user_id, max(n) AS best_streak, arg_max(n, run) AS current_streak FROM g GROUP BY ALL"""))
def best_streak(spark, folder):
    return L.streak_runs(S.reviews(spark, folder), ["user_id"], ORDER, F.col("rating") >= 3, _chunk())


@job("session_stats", views("ev", "reviews", body=RUNS + """
, s AS (SELECT user_id, count(DISTINCT card_id) AS reviewed, count(*) FILTER (rating >= 3) AS correct FROM reviews GROUP BY ALL),
b AS (SELECT user_id, max(n) AS best_streak FROM g GROUP BY ALL),
t AS (SELECT user_id, reviewed, correct, reviewed - correct AS to_relearn, best_streak,
   CAST(floor(correct / reviewed * 100 + 0.5) AS BIGINT) AS accuracy FROM s JOIN b USING (user_id))
SELECT *, CASE WHEN accuracy >= 90 THEN 'Outstanding!' WHEN accuracy >= 70 THEN 'Great job!'
 WHEN accuracy >= 50 THEN 'Good effort!' ELSE 'Keep practicing!' END AS message FROM t"""))
def session_stats(spark, folder):
    return L.session_stats(S.reviews(spark, folder), ["user_id"], "card_id", ORDER, _chunk())


@job("day_streak", views("ev", "reviews", body="""
, d AS (SELECT DISTINCT user_id, day FROM reviews),
r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM d),
g AS (SELECT user_id, run, count(*) AS n, max(day) AS last FROM r GROUP BY ALL)
SELECT user_id, max(n) AS longest_streak, arg_max(n, last) AS streak_days, max(last) AS streak_last_day FROM g GROUP BY ALL"""))
def day_streak(spark, folder):
    return L.day_streaks(S.reviews(spark, folder), ["user_id"], "day")


@job("review_replay", views("ev", "reviews", body="""
, a AS (SELECT *, row_number() OVER w AS reps, coalesce(day - lag(day) OVER w, 0) AS elapsed_days FROM reviews
  WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, review_id))
SELECT user_id, review_id, rating, reps, elapsed_days,
 coalesce(lag(elapsed_days) OVER (PARTITION BY user_id ORDER BY ts_ms, review_id), 0) AS last_elapsed_days FROM a"""))
def review_replay(spark, folder):
    rows = S.reviews(spark, folder).select("user_id", "review_id", "ts_ms", "rating")
    return L.replay(rows, ["user_id"], "ts_ms", "review_id", _chunk()).drop("ts_ms")


@job("requeue", views("ev", "reviews", body="""
, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, card_id ORDER BY ts_ms, review_id) AS rn FROM reviews)
SELECT user_id, card_id, review_id, CAST(round_even(value * 100, 0) AS BIGINT) * 200 < 600000 AS requeued FROM f WHERE rn = 1"""))
def requeue(spark, folder):
    """A card falls due a few minutes after its review, by the event's value."""
    rows = S.reviews(spark, folder).select(
        "user_id", "card_id", "review_id", "ts_ms",
        (F.col("ts_ms") + F.bround(F.col("value") * 100, 0).cast("bigint") * 200).alias("due_ms"))
    return L.requeue(rows, ["user_id"], "card_id", "ts_ms", "review_id", "due_ms").select(
        "user_id", "card_id", "review_id", "requeued")


@job("daily_progress", views("ev", body="""
SELECT user_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day,
 count(*) FILTER (event_type = 'view') AS videos_watched, count(*) FILTER (event_type = 'signup') AS words_learned,
 count(*) FILTER (event_type = 'click') AS cards_reviewed, CAST(sum(k) // 60 AS BIGINT) AS minutes_active FROM ev GROUP BY ALL"""))
def daily_progress(spark, folder):
    kind = lambda t: F.count_if(F.col("event_type") == t)
    return S.ev(spark, folder).groupBy(
        "user_id", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day")
    ).agg(kind("view").alias("videos_watched"), kind("signup").alias("words_learned"),
          kind("click").alias("cards_reviewed"), F.floor(F.sum("k") / 60).alias("minutes_active"))


@job("lifetime_stats", views("ev", body="""
SELECT user_id, count(DISTINCT k) FILTER (event_type = 'signup') AS words_learned,
 count(*) FILTER (event_type = 'view') AS videos_watched, count(*) FILTER (event_type = 'click') AS cards_reviewed FROM ev GROUP BY ALL"""))
def lifetime_stats(spark, folder):
    e = S.ev(spark, folder)
    # distinct words first: the counts then need no second shuffle of raw rows per distinct set
    words = e.filter("event_type = 'signup'").groupBy("user_id", "k").agg(F.lit(1).alias("one")).groupBy("user_id").agg(F.count("*").alias("words_learned"))
    rest = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("videos_watched"),
                                    F.count_if(F.col("event_type") == "click").alias("cards_reviewed"))
    return rest.join(words, "user_id", "left").select(
        "user_id", F.coalesce("words_learned", F.lit(0)).alias("words_learned"), "videos_watched", "cards_reviewed")


@job("video_counters", """
SELECT p_partkey AS video_id, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS view_count,
 (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A') AS like_count,
 (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'N') AS bookmark_count FROM part""")
def video_counters(spark, folder):
    lines = table(spark, folder, "lineitem", "l_partkey", "l_returnflag").groupBy(F.col("l_partkey").alias("video_id")).agg(
        F.count("*").alias("view_count"), F.count_if(F.col("l_returnflag") == "A").alias("like_count"),
        F.count_if(F.col("l_returnflag") == "N").alias("bookmark_count"))
    v = table(spark, folder, "part").select(F.col("p_partkey").alias("video_id"))
    return v.join(lines, "video_id", "left").na.fill(0)


@job("latest_per_key", views("ev", body="""
SELECT user_id, k AS card_id, arg_max(event_id, ts_ms * 10000000::HUGEINT + event_id) AS event_id, max(ts_ms) AS client_ms FROM ev GROUP BY ALL"""))
def latest_per_key(spark, folder):
    """Last write wins on the client time; a missing client time loses."""
    rows = S.ev(spark, folder).select("user_id", F.col("k").alias("card_id"), "event_id", F.col("ts_ms").alias("client_ms"))
    return Tb.latest(rows, ["user_id", "card_id"], F.struct(F.coalesce("client_ms", F.lit(-1)), "event_id"))


@job("first_per_key", views("ev", body="""
SELECT user_id, k AS card_id, arg_min(event_id, ts_ms * 10000000::HUGEINT + event_id) AS event_id, min(ts_ms) AS client_ms FROM ev GROUP BY ALL"""))
def first_per_key(spark, folder):
    rows = S.ev(spark, folder).select("user_id", F.col("k").alias("card_id"), "event_id", F.col("ts_ms").alias("client_ms"))
    return Tb.first_per_key(rows, ["user_id", "card_id"], F.struct("client_ms", "event_id"))


@job("likes_count", views("ev", body="""
SELECT user_id, count(*) FILTER (event_type = 'purchase') AS likes FROM ev GROUP BY ALL"""))
def likes_count(spark, folder):
    return S.ev(spark, folder).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("likes"))


@job("job_status_counts", """
SELECT o_orderpriority AS kind, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus = 'O') AS failed,
 count(*) FILTER (o_orderstatus = 'P') AS pending, CAST(sum(o_orderkey % 3) AS BIGINT) AS retries FROM orders GROUP BY ALL""")
def job_status_counts(spark, folder):
    """Pivot over the fixed list of states: no extra pass to find them."""
    o = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    counts = o.groupBy(F.col("o_orderpriority").alias("kind")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    retries = o.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.sum(F.col("o_orderkey") % 3).alias("retries"))
    return counts.join(retries, "kind").select(
        "kind", *[F.coalesce(s, F.lit(0)).alias(n) for s, n in (("F", "ready"), ("O", "failed"), ("P", "pending"))], "retries")


@job("table_growth", """
SELECT 'orders' AS source, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'lineitem', strftime(l_shipdate, '%Y-%m'), count(*) FROM lineitem GROUP BY ALL
UNION ALL SELECT 'events', strftime(ts, '%Y-%m'), count(*) FROM events GROUP BY ALL""")
def table_growth(spark, folder):
    def monthly(name, col):
        return table(spark, folder, name, col).groupBy(F.lit(name).alias("source"), F.date_format(col, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))

    return monthly("orders", "o_orderdate").unionByName(monthly("lineitem", "l_shipdate")).unionByName(monthly("events", "ts"))


@job("rating_labels", views("ev", "reviews", body="""
SELECT user_id, CASE rating WHEN 1 THEN 'Forgot' WHEN 2 THEN 'Tough' WHEN 3 THEN 'Got it' ELSE 'Easy!' END AS label, count(*) AS n FROM reviews GROUP BY ALL"""))
def rating_labels(spark, folder):
    return S.reviews(spark, folder).groupBy("user_id", labels.rating_label(F.col("rating")).alias("label")).agg(F.count("*").alias("n"))


@job("queue_positions", views("ev", "reviews", body="""
, m AS (SELECT *, row_number() OVER (PARTITION BY user_id, card_id ORDER BY ts_ms, review_id) > 1 AS is_repeat FROM reviews)
SELECT user_id, review_id, is_repeat, row_number() OVER (PARTITION BY user_id ORDER BY is_repeat, ts_ms, review_id) AS position FROM m"""))
def queue_positions(spark, folder):
    """Session queue: repeated cards come behind all first tries."""
    from lexicue.operators.scans import row_numbers

    rows = S.reviews(spark, folder).select("user_id", "card_id", "review_id", "ts_ms")
    marked = L.queue_order(rows, ["user_id"], "card_id", "ts_ms", "review_id").withColumn("late", F.col("is_repeat").cast("int"))
    # chunks must follow the order: repeats get days behind every first try
    chunk = F.col("late") * 1_000_000 + chunk_of(F.col("ts_ms"), S.DAY)
    return row_numbers(marked, ["user_id"], ["late", "ts_ms", "review_id"], "position", chunk).select("user_id", "review_id", "is_repeat", "position")
