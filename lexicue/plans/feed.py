"""Feeds, queues, lookups and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicue.operators import feed as Q
from lexicue.operators import learning as L
from lexicue.operators import tables as Tb
from lexicue.plans import standins as S
from lexicue.plans.registry import job
from lexicue.sources.tables import table

READY, LANGUAGE, LIMIT = "F", "2-HIGH", 10
FEED = ["created_ms", "id"]
FILTER = "status = 'F' AND language = '2-HIGH'"
#: Cursor used by the second page: a day inside the data.
CURSOR = (915148800000, 5000)


def _feed(spark, folder):
    return S.videos(spark, folder).filter(FILTER).select("id", "creator_id", "created_ms", "price")


@job("feed_page", S.with_views("videos", body=f"""
SELECT id, creator_id, created_ms, price FROM videos WHERE {FILTER}
ORDER BY created_ms DESC, id DESC LIMIT 10"""))
def feed_page(spark, folder):
    return Q.keyset_page(_feed(spark, folder), FEED, LIMIT)


@job("feed_next_page", S.with_views("videos", body=f"""
SELECT id, creator_id, created_ms, price FROM videos
WHERE {FILTER} AND (created_ms < {CURSOR[0]} OR (created_ms = {CURSOR[0]} AND id < {CURSOR[1]}))
ORDER BY created_ms DESC, id DESC LIMIT 10"""))
def feed_next_page(spark, folder):
    return Q.keyset_page(_feed(spark, folder), FEED, LIMIT, CURSOR)


@job("feed_next_page_simple", S.with_views("videos", body=f"""
SELECT id, creator_id, created_ms, price FROM videos WHERE {FILTER} AND created_ms < {CURSOR[0]}
ORDER BY created_ms DESC, id DESC LIMIT 10"""))
def feed_next_page_simple(spark, folder):
    return Q.keyset_page(_feed(spark, folder), FEED, LIMIT, CURSOR, compound=False)


@job("feed_cursor", S.with_views("videos", body=f"""
SELECT min(created_ms) AS created_ms, arg_min(id, created_ms * 10000000::HUGEINT + id) AS id FROM (
 SELECT id, created_ms FROM videos WHERE {FILTER} ORDER BY created_ms DESC, id DESC LIMIT 10)"""))
def feed_cursor(spark, folder):
    return Q.next_cursor(Q.keyset_page(_feed(spark, folder).select("id", "created_ms"), FEED, LIMIT), FEED, LIMIT)


@job("feed_pages_flat", S.with_views("videos", body=f"""
SELECT id, created_ms FROM videos WHERE {FILTER}
AND (created_ms < {CURSOR[0]} OR (created_ms = {CURSOR[0]} AND id < {CURSOR[1]}))
ORDER BY created_ms DESC, id DESC LIMIT 20"""))
def feed_pages_flat(spark, folder):
    """Two pages in one list: the second starts behind the last row of the first."""
    rows = _feed(spark, folder).select("id", "created_ms")
    first = Q.keyset_page(rows, FEED, LIMIT, CURSOR)
    cur = Q.next_cursor(first, FEED, LIMIT)
    # the cursor is one row: scalar subqueries, no join
    at, last = cur.select("created_ms").scalar(), cur.select("id").scalar()
    behind = rows.filter((F.col("created_ms") < at) | ((F.col("created_ms") == at) & (F.col("id") < last)))
    return first.unionByName(Q.keyset_page(behind, FEED, LIMIT))


@job("unseen_feed", S.with_views("videos", body=f"""
SELECT v.id, v.created_ms FROM videos v LEFT JOIN
 (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 7) s ON s.l_orderkey = v.id
WHERE {FILTER} AND s.l_orderkey IS NULL ORDER BY v.created_ms DESC, v.id DESC LIMIT 10"""))
def unseen_feed(spark, folder):
    """Lines of supplier 7 stand for the videos one user has seen."""
    seen = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey").filter("l_suppkey = 7")
    rows = _feed(spark, folder).select("id", "created_ms")
    return Q.keyset_page(Q.unseen(rows, seen.select(F.col("l_orderkey").alias("id")), "id"), FEED, LIMIT)


@job("unseen_feed_all_users", S.with_views("videos", body=f"""
SELECT u.o_custkey AS user_id, count(*) AS unseen FROM
  (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') u
  WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = u.o_orderkey AND l.l_returnflag = 'R')
GROUP BY ALL"""))
def unseen_feed_all_users(spark, folder):
    """Returned lines stand for views: unseen candidates per user, for every user at once."""
    cand = _feed(spark, folder).select(F.col("creator_id").alias("user_id"), "id")
    seen = table(spark, folder, "lineitem", "l_orderkey", "l_returnflag").filter("l_returnflag = 'R'")
    left = Q.unseen(cand, seen.select(F.col("l_orderkey").alias("id")), "id")
    return left.groupBy("user_id").agg(F.count("*").alias("unseen"))


@job("newest_by_owner", S.with_views("videos", body="""
SELECT creator_id, id, created_ms, row_number() OVER (PARTITION BY creator_id ORDER BY created_ms DESC, id DESC) AS position
FROM videos WHERE status = 'F'"""))
def newest_by_owner(spark, folder):
    from lexicue.operators.scans import chunk_of, scan, Look

    rows = S.videos(spark, folder).filter("status = 'F'").select("creator_id", "id", "created_ms")
    return scan(rows, ["creator_id"], ["created_ms", "id"],
                [Look("position", F.lit(1).cast("bigint"), "sum", ahead=True)], chunk_of(F.col("created_ms"), 365 * S.DAY))


CARDS = """
SELECT o_orderkey AS id, o_custkey AS user_id, epoch_us(o_orderdate) // 1000 AS due_ms,
       o_orderkey % 4 AS state, o_orderkey % 5 = 0 AS starred FROM orders"""
S.SQL["cards"] = CARDS


def cards(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), S.millis("o_orderdate").alias("due_ms"),
        (F.col("o_orderkey") % 4).alias("state"), (F.col("o_orderkey") % 5 == 0).alias("starred"),
    )


AS_OF = 946684800000


@job("due_queue", S.with_views("cards", body=f"""
SELECT id, user_id, due_ms FROM cards WHERE due_ms <= {AS_OF} ORDER BY due_ms, id LIMIT 20"""))
def due_queue(spark, folder):
    return (cards(spark, folder).filter(F.col("due_ms") <= AS_OF).select("id", "user_id", "due_ms")
            .orderBy("due_ms", "id").limit(20))


@job("due_capped_per_user", S.with_views("cards", body=f"""
SELECT id, user_id, due_ms, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY due_ms, id) AS rn
 FROM cards WHERE due_ms <= {AS_OF}) WHERE rn <= 3"""))
def due_capped_per_user(spark, folder):
    due = cards(spark, folder).filter(F.col("due_ms") <= AS_OF).select("id", "user_id", "due_ms")
    capped = Q.top_per_key(due, ["user_id"], [F.col("due_ms"), F.col("id")], 3)
    return capped.withColumn("rank", F.col("rank").cast("bigint"))


#: The greatest daily limit a user may set; the cap by it runs before the shuffle.
MOST_REVIEWS = 4


@job("due_own_limit", S.with_views("cards", body=f"""
SELECT id, user_id, due_ms, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY due_ms, id) AS rn
 FROM cards WHERE due_ms <= {AS_OF}) WHERE rn <= 1 + user_id % 4"""))
def due_own_limit(spark, folder):
    """Each user's own limit, here one to four by id; no limit is above the greatest one that can be set."""
    due = cards(spark, folder).filter(F.col("due_ms") <= AS_OF).select("id", "user_id", "due_ms")
    capped = Q.top_per_key(due, ["user_id"], [F.col("due_ms"), F.col("id")], MOST_REVIEWS)
    return capped.filter(F.col("rank") <= 1 + F.col("user_id") % 4).withColumn("rank", F.col("rank").cast("bigint"))


@job("due_session_plan", S.with_views("cards", body=f"""
SELECT user_id, count(*) AS due, CAST(greatest(1, floor(count(*) * 0.5 + 0.5)) AS BIGINT) AS minutes,
 CASE WHEN count(*) <= 0 THEN '' WHEN count(*) <= 5 THEN 'Quick session ahead'
      WHEN count(*) <= 15 THEN 'Strengthen your memory' ELSE 'Big session today!' END AS motivation
FROM cards WHERE due_ms <= {AS_OF} GROUP BY ALL"""))
def due_session_plan(spark, folder):
    due = cards(spark, folder).filter(F.col("due_ms") <= AS_OF).groupBy("user_id").agg(F.count("*").alias("due"))
    return due.select("user_id", "due", L.estimated_minutes(F.col("due")).alias("minutes"), L.motivation(F.col("due")).alias("motivation"))


@job("card_badges", S.with_views("cards", body="""
SELECT user_id, CASE state WHEN 0 THEN 'New' WHEN 1 THEN 'Learning' WHEN 2 THEN 'Review' WHEN 3 THEN 'Relearning' ELSE '' END AS badge,
 count(*) AS n, count(*) FILTER (starred) AS starred FROM cards GROUP BY ALL"""))
def card_badges(spark, folder):
    from lexicue.functions.labels import state_label

    return cards(spark, folder).groupBy("user_id", state_label(F.col("state")).alias("badge")).agg(
        F.count("*").alias("n"), F.count_if("starred").alias("starred"))


@job("user_search", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_name ILIKE '%12%' OR c_mktsegment ILIKE '%12%' ORDER BY c_custkey LIMIT 20""")
def user_search(spark, folder):
    # the limit is part of the search; the order makes it deterministic
    return (table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
            .filter(Q.contains_text(["c_name", "c_mktsegment"], "12")).orderBy("c_custkey").limit(20))


@job("visible_rows", S.with_views("videos", body="""
SELECT 'content' AS scope, count(*) AS n FROM videos WHERE status = 'F'
UNION ALL SELECT 'own', count(*) FROM videos WHERE creator_id = 42
UNION ALL SELECT 'public', count(*) FROM customer"""))
def visible_rows(spark, folder):
    """What one viewer may read: ready content, own rows, public profiles."""
    v = S.videos(spark, folder)
    ready = v.agg(F.count_if(F.col("status") == "F").alias("content"), F.count_if(F.col("creator_id") == 42).alias("own"))
    public = table(spark, folder, "customer", "c_custkey").agg(F.count("*").alias("n")).select(F.lit("public").alias("scope"), "n")
    return ready.select(F.expr("stack(2, 'content', content, 'own', own) AS (scope, n)")).unionByName(public)


# --- word lookups -----------------------------------------------------------------------------
PICK = """picked AS (SELECT vocab_id, video_id, max_by(translation, definition_id) AS translation, max(definition_id) AS definition_id
 FROM definitions WHERE target_language = 'n1' GROUP BY ALL)"""


def _picked(spark, folder):
    """Definitions in the viewer's language, the last one per word and video."""
    return S.definitions(spark, folder).filter("target_language = 'n1'").groupBy("vocab_id", "video_id").agg(
        F.max_by("translation", "definition_id").alias("translation"), F.max("definition_id").alias("definition_id"))


@job("word_lookup_inner", S.with_views("video_words", "definitions", body=f"""
, {PICK} SELECT w.video_id, w.word_index, w.vocab_id, w.start_ms, p.p_name AS word, d.translation, d.definition_id
FROM video_words w JOIN part p ON p.p_partkey = w.vocab_id
JOIN picked d ON d.vocab_id = w.vocab_id AND d.video_id = w.video_id""").replace(")\n\n,", "),\n"))
def word_lookup_inner(spark, folder):
    words = S.video_words(spark, folder).select("video_id", "vocab_id", "word_index", "start_ms")
    vocab = table(spark, folder, "part").select(F.col("p_partkey").alias("vocab_id"), F.col("p_name").alias("word"))
    return words.join(_picked(spark, folder), ["vocab_id", "video_id"]).join(vocab, "vocab_id").select(
        "video_id", "word_index", "vocab_id", "start_ms", "word", "translation", "definition_id")


@job("word_lookup_left", S.with_views("video_words", "definitions", body=f"""
, {PICK} SELECT w.video_id, w.word_index, w.vocab_id, w.start_ms, coalesce(p.p_name, 'word ' || w.vocab_id) AS word,
 coalesce(d.translation, '') AS translation, coalesce(CAST(d.definition_id AS VARCHAR), '') AS definition_id
FROM video_words w LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p.p_partkey = w.vocab_id
LEFT JOIN picked d ON d.vocab_id = w.vocab_id AND d.video_id = w.video_id""").replace(")\n\n,", "),\n"))
def word_lookup_left(spark, folder):
    """Left joins with defaults; parts up to size 5 are missing from the vocabulary."""
    words = S.video_words(spark, folder).select("video_id", "vocab_id", "word_index", "start_ms")
    vocab = table(spark, folder, "part").filter("p_size > 5").select(F.col("p_partkey").alias("vocab_id"), F.col("p_name").alias("word"))
    shown = F.concat(F.lit("word "), F.col("vocab_id").cast("string"))
    return words.join(_picked(spark, folder), ["vocab_id", "video_id"], "left").join(vocab, "vocab_id", "left").select(
        "video_id", "word_index", "vocab_id", "start_ms", F.coalesce("word", shown).alias("word"),
        F.coalesce("translation", F.lit("")).alias("translation"),
        F.coalesce(F.col("definition_id").cast("string"), F.lit("")).alias("definition_id"))


@job("card_details", """
SELECT o_orderkey AS card_id, o_custkey AS user_id, l_linenumber AS line, p_name AS word, s_name AS translation
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE p_type = 'PROMO' AND o_orderdate <= TIMESTAMP '2000-01-01'""")
def card_details(spark, folder):
    """Due cards with word and definition, filtered on the joined word's language (part type)."""
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").filter(F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp_ntz"))
    l = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_type").filter("p_type = 'PROMO'")
    s = table(spark, folder, "supplier", "s_suppkey", "s_name")
    return (l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("user_id"),
                    F.col("l_linenumber").alias("line"), F.col("p_name").alias("word"), F.col("s_name").alias("translation")))


@job("card_count", """
SELECT o_custkey AS user_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO' GROUP BY ALL""")
def card_count(spark, folder):
    l = table(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    p = table(spark, folder, "part", "p_partkey", "p_type").filter("p_type = 'PROMO'").select("p_partkey")
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    per_order = l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_id")).agg(F.sum("n").alias("n"))


FOLLOWS = """SELECT DISTINCT o_custkey AS follower_id, l_suppkey AS following_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey
 WHERE o_custkey <> l_suppkey"""
S.SQL["follows"] = FOLLOWS


def follows(spark, folder):
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    l = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey")
    return (l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("o_custkey <> l_suppkey")
            .select(F.col("o_custkey").alias("follower_id"), F.col("l_suppkey").alias("following_id")).distinct())


@job("is_following", S.with_views("follows", body="""
SELECT c_custkey AS user_id, (c_custkey * 7) % 100 AS other_id,
 c_custkey <> (c_custkey * 7) % 100 AND EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = c_custkey AND f.following_id = (c_custkey * 7) % 100) AS following
FROM customer"""))
def is_following(spark, folder):
    asked = table(spark, folder, "customer", "c_custkey").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 7 % 100).alias("other_id"))
    known = follows(spark, folder).select(F.col("follower_id").alias("user_id"), F.col("following_id").alias("other_id"), F.lit(True).alias("hit"))
    return asked.join(known, ["user_id", "other_id"], "left").select(
        "user_id", "other_id", (F.coalesce("hit", F.lit(False)) & (F.col("user_id") != F.col("other_id"))).alias("following"))


@job("follow_counters", S.with_views("follows", body="""
SELECT c_custkey AS user_id,
 (SELECT count(*) FROM follows f WHERE f.follower_id = c_custkey) AS following_count,
 (SELECT count(*) FROM follows f WHERE f.following_id = c_custkey) AS follower_count FROM customer"""))
def follow_counters(spark, folder):
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    f = follows(spark, folder)
    return L.counters(users, "user_id", {"following_count": (f, "follower_id"), "follower_count": (f, "following_id")})


@job("counter_delta", S.with_views("follows", body="""
SELECT c_custkey AS user_id, greatest(coalesce(n, 0) + CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END, 0) AS following_count
FROM customer LEFT JOIN (SELECT follower_id, count(*) AS n FROM follows GROUP BY ALL) ON follower_id = c_custkey"""))
def counter_delta(spark, folder):
    """Follow (+1) or unfollow (-1) applied to stored counts, never below zero."""
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    base = L.counters(users, "user_id", {"n": (follows(spark, folder), "follower_id")})
    return base.select("user_id", L.apply_delta(F.col("n"), F.when(F.col("user_id") % 2 == 0, -1).otherwise(1)).alias("following_count"))


@job("profile_with_likes", S.with_views("videos", body="""
SELECT c_custkey AS user_id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS display_name,
 CASE WHEN c_custkey = 42 THEN c_name ELSE '' END AS email, coalesce(n, 0) AS likes, 10 AS daily_goal
FROM customer LEFT JOIN (SELECT creator_id, count(*) AS n FROM videos WHERE status = 'O' GROUP BY ALL) ON creator_id = c_custkey"""))
def profile_with_likes(spark, folder):
    """Profile with defaults and like count; the address only for its owner (viewer 42)."""
    from lexicue.functions.profile import masked

    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    liked = S.videos(spark, folder).filter("status = 'O'")
    out = L.counters(c, "user_id", {"likes": (liked, "creator_id")})
    return out.select("user_id", F.coalesce("seg", F.lit("none")).alias("display_name"),
                      masked(F.col("c_name"), F.col("user_id"), F.lit(42)).alias("email"), "likes", F.lit(10).alias("daily_goal"))


@job("id_selection", S.with_views("videos", body="""
SELECT v.id, v.created_ms FROM videos v WHERE v.id IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1)"""))
def id_selection(spark, folder):
    """Explicit id list as a semi-join; an absent list means all rows."""
    wanted = table(spark, folder, "lineitem", "l_orderkey", "l_discount").filter("l_discount >= 0.1").select(F.col("l_orderkey").alias("id"))
    return S.videos(spark, folder).select("id", "created_ms").join(wanted, "id", "left_semi")


@job("work_left", """
SELECT o_orderkey AS id, model FROM orders, (VALUES ('dense'), ('rapid')) m(model)
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_returnflag = CASE model WHEN 'dense' THEN 'A' ELSE 'N' END)""")
def work_left(spark, folder):
    """Planned outputs (video, model) not listed among the existing ones."""
    planned = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.lit("dense"), F.lit("rapid"))).alias("model"))
    existing = table(spark, folder, "lineitem", "l_orderkey", "l_returnflag").select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "A", "dense").when(F.col("l_returnflag") == "N", "rapid").alias("model")).dropna()
    return Tb.delete(planned, existing, ["id", "model"])


@job("profile_defaults", """
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, 0) AS "streakDays", coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'en') AS "nativeLanguage",
 coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_nationkey END, 10) AS "dailyGoalMinutes", coalesce(CASE WHEN c_custkey % 7 = 0 THEN c_nationkey END, 20) AS "maxReviewsPerDay",
 coalesce(CASE WHEN c_custkey % 11 = 0 THEN true END, false) AS premium, CAST(0 AS DOUBLE) AS stability, coalesce(CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END, 0.0) AS difficulty FROM customer""")
def profile_defaults(spark, folder):
    """Stored rows with gaps to the names and defaults the client reads."""
    from lexicue.functions import profile as P

    c, k = F.col, F.col("c_custkey")
    stored = table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").select(
        k.alias("id"), F.when(k % 2 == 0, c("c_nationkey")).alias("streak_days"), F.when(k % 3 == 0, c("c_mktsegment")).alias("native_language"),
        F.when(k % 5 == 0, c("c_nationkey")).alias("daily_goal_minutes"), F.when(k % 7 == 0, c("c_nationkey")).alias("max_reviews_per_day"),
        F.when(k % 11 == 0, F.lit(True)).alias("premium"), F.lit(None).cast("double").alias("stability"), F.when(k % 2 == 1, c("c_acctbal")).alias("difficulty"))
    named = {n: v for n, v in P.PROFILE_DEFAULTS.items() if v[0] in stored.columns}
    zero = {n: (n, 0.0) for n in P.CARD_ZERO_DEFAULTS if n in stored.columns}
    return stored.select("id", *P.with_defaults(named), *P.with_defaults(zero))
