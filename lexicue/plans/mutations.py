"""Table changes and integrity checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexicue.functions import profile as P
from lexicue.operators import tables as Tb
from lexicue.plans import standins as S
from lexicue.plans.feed import cards, follows
from lexicue.plans.registry import JOBS, job
from lexicue.session import shared_dir
from lexicue.sinks.stored import StoredTable
from lexicue.sources.tables import table

NOW = 978307200000


def _base(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("language"), F.lit(0).alias("n_saved"))


def _incoming(spark, folder):
    """Orders of status P save a card under their customer's key plus 75: some known, some new."""
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").filter("o_orderstatus = 'P'")
    return o.select((F.col("o_custkey") + 75).alias("id"), F.col("o_orderpriority").alias("language"), F.col("o_orderkey").alias("at"))


@job("upsert", """
WITH inc AS (SELECT o_custkey + 75 AS id, arg_max(o_orderpriority, o_orderkey) AS language FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT coalesce(c.c_custkey, i.id) AS id, coalesce(c.c_name, 'new') AS name, coalesce(i.language, c.c_mktsegment) AS language, 0 AS n_saved
FROM customer c FULL JOIN inc i ON i.id = c.c_custkey""")
def upsert(spark, folder):
    changes = Tb.latest(_incoming(spark, folder), ["id"], F.col("at")).drop("at")
    return Tb.upsert(_base(spark, folder), changes, ["id"], {"name": F.lit("new"), "n_saved": F.lit(0)})


@job("upsert_vocabulary", """
WITH w AS (SELECT DISTINCT p_name AS word, p_type AS language FROM part),
known AS (SELECT word, language, min(p_partkey) AS id FROM w JOIN part ON p_name = word AND p_type = language WHERE p_size <= 2 GROUP BY ALL)
SELECT w.word, w.language, known.id IS NOT NULL AS was_known, coalesce(CAST(known.id AS VARCHAR), md5(strlen(w.word) || ':' || w.word || strlen(w.language) || ':' || w.language)) AS id
FROM w LEFT JOIN known USING (word, language)""")
def upsert_vocabulary(spark, folder):
    """Word table keyed by (word, language); words not known yet get a fresh id."""
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_type", "p_size").select(
        F.col("p_name").alias("word"), F.col("p_type").alias("language"), "p_partkey", "p_size")
    known = p.filter("p_size <= 2").groupBy("word", "language").agg(F.min("p_partkey").alias("id"))
    words = p.select("word", "language").distinct()
    return words.join(known, ["word", "language"], "left").select(
        "word", "language", F.col("id").isNotNull().alias("was_known"), F.coalesce(F.col("id").cast("string"), Tb.surrogate_id("word", "language")).alias("id"))


@job("view_upsert", """
SELECT o_custkey AS user_id, l_partkey AS video_id, 1 AS view_count, max(l_orderkey) AS last_viewed
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def view_upsert(spark, folder):
    """Repeat views leave one row per (user, video); the count stays at one."""
    l = table(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("video_id")
    ).agg(F.lit(1).alias("view_count"), F.max("l_orderkey").alias("last_viewed"))


@job("update_by_key", f"""
WITH ch AS (SELECT l_orderkey AS id, max(l_linenumber) % 4 AS state FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT o_orderkey AS id, coalesce(ch.state, o_orderkey % 4) AS state,
 CASE WHEN ch.state IS NOT NULL AND ch.state <> o_orderkey % 4 THEN {NOW} ELSE epoch_us(o_orderdate) // 1000 END AS updated_ms
FROM orders LEFT JOIN ch ON ch.id = o_orderkey""")
def update_by_key(spark, folder):
    """Scheduling state by id; the change time is refreshed only where a value changed."""
    base = cards(spark, folder).select("id", "state", F.col("due_ms").alias("updated_ms"))
    ch = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").filter("l_returnflag = 'R'").groupBy(
        F.col("l_orderkey").alias("id")).agg((F.max("l_linenumber") % 4).cast("bigint").alias("state"))
    return Tb.update(base, ch, ["id"], "updated_ms", F.lit(NOW))


@job("mark_ready", f"""
WITH done AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'F')
SELECT 'video' AS kind, o_orderkey AS id, CASE WHEN done.id IS NOT NULL THEN 'ready' ELSE 'processing' END AS status FROM orders LEFT JOIN done ON done.id = o_orderkey
UNION ALL SELECT 'job', id, 'ready' FROM done JOIN orders ON o_orderkey = id""")
def mark_ready(spark, folder):
    """Status update by key plus one job row per finished video."""
    done = table(spark, folder, "lineitem", "l_orderkey", "l_linestatus").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id")).distinct()
    base = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.lit("processing").alias("status"))
    videos = Tb.update(base, done.withColumn("status", F.lit("ready")), ["id"]).select(F.lit("video").alias("kind"), "id", "status")
    jobs = base.join(done, "id", "left_semi").select(F.lit("job").alias("kind"), "id", F.lit("ready").alias("status"))
    return videos.unionByName(jobs)


@job("review_log_append", """
SELECT 'old' AS batch, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT 'new', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'O'""")
def review_log_append(spark, folder):
    """Append of a snapshot batch behind the stored log."""
    o = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    stored = o.filter("o_orderstatus <> 'O'").withColumn("batch", F.lit("old"))
    fresh = o.filter("o_orderstatus = 'O'").withColumn("batch", F.lit("new"))
    return stored.unionByName(fresh).groupBy("batch").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@job("toggle_star", S.with_views("cards", body="""
SELECT id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09) THEN NOT starred ELSE starred END AS starred FROM cards"""))
def toggle_star(spark, folder):
    base = cards(spark, folder).select("id", "starred")
    asked = table(spark, folder, "lineitem", "l_orderkey", "l_discount").filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("id")).distinct()
    ch = base.join(asked, "id", "left_semi").select("id", (~F.col("starred")).alias("starred"))
    return Tb.update(base, ch, ["id"])


@job("delete_by_key", S.with_views("follows", body="""
SELECT follower_id, following_id FROM follows WHERE (follower_id, following_id) NOT IN (SELECT c_custkey, c_nationkey FROM customer)"""))
def delete_by_key(spark, folder):
    """Unfollow requests: customers stop following the account numbered as their nation."""
    gone = table(spark, folder, "customer").select(F.col("c_custkey").alias("follower_id"), F.col("c_nationkey").cast("bigint").alias("following_id"))
    return Tb.delete(follows(spark, folder), gone, ["follower_id", "following_id"])


@job("delete_cascade", """
WITH failed AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT 'orders' AS source, count(*) AS kept FROM orders WHERE o_orderkey NOT IN (SELECT id FROM failed)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM failed)
UNION ALL SELECT 'events_set_null', count(*) FROM events WHERE event_id NOT IN (SELECT id FROM failed)
UNION ALL SELECT 'restricted', count(DISTINCT l_orderkey) FROM lineitem JOIN failed ON id = l_orderkey""")
def delete_cascade(spark, folder):
    """Failed videos: cascade to their words, null out references, count deletions a child forbids."""
    o = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    failed = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    lines = table(spark, folder, "lineitem", "l_orderkey")
    left_o = Tb.delete(o.select(F.col("o_orderkey").alias("id")), failed, ["id"])
    left_l = Tb.delete(lines.select(F.col("l_orderkey").alias("id")), failed, ["id"])
    nulled = Tb.set_null(table(spark, folder, "events", "event_id"), failed, "event_id", "id").filter("event_id IS NOT NULL")
    kept = Tb.restricted(failed, lines, "id", "l_orderkey")
    count = lambda df, n: df.agg(F.count("*").alias("kept")).select(F.lit(n).alias("source"), "kept")
    return (count(left_o, "orders").unionByName(count(left_l, "lineitem"))
            .unionByName(count(nulled, "events_set_null")).unionByName(count(kept, "restricted")))


@job("profile_update", """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'display_name' WHEN 1 THEN 'daily_goal_minutes' ELSE 'native_language' END AS field,
 CASE WHEN c_custkey % 3 = 1 THEN c_nationkey + 5 ELSE -1 END AS numeric_value, CASE WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END AS text_value
FROM customer""")
def profile_update(spark, folder):
    """Field names mapped to stored columns; two of them are numbers. Unknown names raise."""
    c = table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    asked = F.when(F.col("c_custkey") % 3 == 0, "displayName").when(F.col("c_custkey") % 3 == 1, "dailyGoalMinutes").otherwise("nativeLanguage")
    value = F.when(F.col("c_custkey") % 3 == 1, (F.col("c_nationkey") + 5).cast("string")).otherwise(F.col("c_mktsegment"))
    from lexicue.constants import NUMERIC_PROFILE_FIELDS

    f = c.select(F.col("c_custkey").alias("id"), P.stored_field(asked).alias("field"), value.alias("value"))
    numeric = F.col("field").isin(NUMERIC_PROFILE_FIELDS)
    return f.select("id", "field", F.when(numeric, F.col("value").try_cast("int")).otherwise(-1).alias("numeric_value"),
                    F.when(numeric, "").otherwise(F.col("value")).alias("text_value"))


LANGS = ["en", "zh", "ja", "fr", "es"]


@job("language_settings", """
WITH u AS (SELECT c_custkey AS id, (['en','zh','ja','fr','es'])[c_nationkey % 5 + 1] AS native,
 list_slice(['en','zh','ja','fr','es'], 1, c_custkey % 4 + 1) AS learning, (['en','zh','ja','fr','es'])[c_custkey % 5 + 1] AS code FROM customer),
v AS (SELECT *, list_filter(learning, lambda x: x <> native) AS rest FROM u)
SELECT id, learning[1] AS target, array_to_string(CASE WHEN len(rest) > 0 THEN rest ELSE learning END, ',') AS without_native,
 array_to_string(CASE WHEN NOT list_contains(learning, code) THEN list_append(learning, code) WHEN len(learning) <= 1 THEN learning
   ELSE list_filter(learning, lambda x: x <> code) END, ',') AS toggled,
 NOT (native = 'en' AND len(learning) = 1 AND learning[1] = 'en') AS onboarded FROM v""")
def language_settings(spark, folder):
    langs = F.array(*[F.lit(x) for x in LANGS])
    u = table(spark, folder, "customer", "c_custkey", "c_nationkey").select(
        F.col("c_custkey").alias("id"), F.get(langs, F.col("c_nationkey") % 5).alias("native"),
        F.slice(langs, 1, (F.col("c_custkey") % 4 + 1).cast("int")).alias("learning"), F.get(langs, (F.col("c_custkey") % 5).cast("int")).alias("code"))
    learning, native, code = F.col("learning"), F.col("native"), F.col("code")
    return u.select("id", P.main_target(learning).alias("target"), F.array_join(P.without_native(learning, native), ",").alias("without_native"),
                    F.array_join(P.toggle_learning(learning, code), ",").alias("toggled"), P.onboarding_complete(native, learning).alias("onboarded"))


@job("backfill", """
WITH d AS (SELECT p_name AS word, min(p_brand) AS reading FROM part GROUP BY ALL)
SELECT p_partkey AS id, p_name AS word, CASE WHEN p_size <= 25 THEN p_type ELSE reading END AS reading FROM part JOIN d ON word = p_name""")
def backfill(spark, folder):
    """Fill a missing column from a dictionary: only rows without a value are joined."""
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    base = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("word"), F.when(F.col("p_size") <= 25, F.col("p_type")).alias("reading"))
    dictionary = p.groupBy(F.col("p_name").alias("word")).agg(F.min("p_brand").alias("found"))
    missing = base.filter(F.col("reading").isNull()).join(dictionary, "word", "left").select("id", "word", F.col("found").alias("reading"))
    return base.filter(F.col("reading").isNotNull()).unionByName(missing)


@job("default_rows", """
SELECT id, coalesce(n, 'en') AS native_language, coalesce(g, 10) AS daily_goal FROM
 (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS n, c_nationkey AS g FROM customer
  UNION ALL SELECT DISTINCT o_custkey + 750 , NULL, NULL FROM orders WHERE o_custkey + 750 NOT IN (SELECT c_custkey FROM customer))""")
def default_rows(spark, folder):
    """Every new account gets one row of defaults."""
    base = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("native_language"), F.col("c_nationkey").alias("daily_goal"))
    accounts = table(spark, folder, "orders").select((F.col("o_custkey") + 750).alias("id"))
    return Tb.insert_missing(base, accounts, "id", {"native_language": F.lit("en"), "daily_goal": F.lit(10)})


@job("check_rules", """
SELECT 'duration_positive' AS rule, count(*) FILTER (l_quantity <= 5) AS violations FROM lineitem
UNION ALL SELECT 'end_after_start', count(*) FILTER (l_quantity * 100 <= l_linenumber * 300) FROM lineitem
UNION ALL SELECT 'percent_range', count(*) FILTER (NOT (l_discount * 1000 BETWEEN 0 AND 90)) FROM lineitem
UNION ALL SELECT 'rating_range', count(*) FILTER (NOT (l_linenumber BETWEEN 1 AND 4)) FROM lineitem
UNION ALL SELECT 'source_known', count(*) FILTER (l_returnflag NOT IN ('A', 'R')) FROM lineitem
UNION ALL SELECT 'not_self', count(*) FILTER (l_partkey = l_suppkey) FROM lineitem
UNION ALL SELECT 'body_length', count(*) FILTER (length(text) > 500) FROM documents""")
def check_rules(spark, folder):
    l = table(spark, folder, "lineitem", "l_quantity", "l_linenumber", "l_discount", "l_returnflag", "l_partkey", "l_suppkey")
    c = F.col
    lines = Tb.rule_violations(l, {
        "duration_positive": c("l_quantity") > 5,
        "end_after_start": c("l_quantity") * 100 > c("l_linenumber") * 300,
        "percent_range": (c("l_discount") * 1000).between(0, 90),
        "rating_range": c("l_linenumber").between(1, 4),
        "source_known": c("l_returnflag").isin("A", "R"),
        "not_self": c("l_partkey") != c("l_suppkey"),
    })
    docs = Tb.rule_violations(table(spark, folder, "documents", "text"), {"body_length": F.length("text") <= 500})
    return lines.unionByName(docs)


@job("dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, folder):
    return Tb.duplicate_keys(table(spark, folder, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@job("orphans", """
SELECT d.doc_id AS child, 'label' AS fk FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT o_orderkey, 'lines' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def orphans(spark, folder):
    docs = table(spark, folder, "documents", "doc_id")
    a = Tb.orphans(docs, table(spark, folder, "labels", "doc_id"), "doc_id", "doc_id").select(F.col("doc_id").alias("child"), F.lit("label").alias("fk"))
    b = Tb.orphans(table(spark, folder, "orders", "o_orderkey"), table(spark, folder, "lineitem", "l_orderkey"), "o_orderkey", "l_orderkey")
    return a.unionByName(b.select(F.col("o_orderkey").alias("child"), F.lit("lines").alias("fk")))


# --- batches merged into stored tables --------------------------------------------------------
def _stored(spark, name, keys, schema):
    return StoredTable(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", keys, schema)


@job("stored_views", JOBS["view_upsert"].sql)
def stored_views(spark, folder):
    """Views in three batches, the second of which comes twice: one stored row per (user, video), its count stays at one."""
    l = table(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    views = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("video_id"), F.lit(1).alias("view_count"), F.col("l_orderkey").alias("last_viewed"))
    stored = _stored(spark, "views", ["user_id", "video_id"], "user_id bigint, video_id bigint, view_count int, last_viewed bigint")
    for batch, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        stored.put_latest(batch, views.filter(F.col("last_viewed") % 3 == part), F.col("last_viewed"))
    return stored.read()


@job("stored_review_log", JOBS["review_log_append"].sql)
def stored_review_log(spark, folder):
    """A log that snapshots are appended to; a snapshot that comes again adds nothing."""
    o = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    log = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "new").otherwise("old").alias("batch"))
    stored = _stored(spark, "log", ["o_orderkey"], "o_orderkey bigint, batch string")
    for batch, name in enumerate(("old", "new")):
        for _ in range(2):
            stored.append(batch, log.filter(F.col("batch") == name))
    return stored.read().groupBy("batch").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@job("stored_profiles", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS display_name,
 CAST(CASE WHEN c_custkey % 3 = 1 THEN c_nationkey + 5 ELSE 10 END AS INTEGER) AS daily_goal_minutes,
 CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE 'en' END AS native_language FROM customer""")
def stored_profiles(spark, folder):
    """Stored profiles changed field by field: names mapped to columns, goals to numbers, the later of two changes kept."""
    from lexicue.constants import NUMERIC_PROFILE_FIELDS

    c = table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    stored = _stored(spark, "profiles", ["id"], "id bigint, display_name string, daily_goal_minutes int, native_language string")
    stored.append(0, c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.lit(10).alias("daily_goal_minutes"), F.lit("en").alias("native_language")))
    asked = F.when(F.col("c_custkey") % 3 == 0, "displayName").when(F.col("c_custkey") % 3 == 1, "dailyGoalMinutes").otherwise("nativeLanguage")
    value = F.when(F.col("c_custkey") % 3 == 1, (F.col("c_nationkey") + 5).cast("string")).otherwise(F.col("c_mktsegment"))
    changes = c.select(F.col("c_custkey").alias("id"), P.stored_field(asked).alias("field"), F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("0").alias("value")), F.struct(F.lit(2).alias("at"), value.alias("value")))).alias("x"))
    kinds = {f: "int" if f in NUMERIC_PROFILE_FIELDS else "string" for f in ("display_name", "daily_goal_minutes", "native_language")}
    for _ in range(2):
        stored.set_fields(1, changes.select("id", "field", "x.at", "x.value"), kinds, F.col("at"))
    return stored.read()
