"""Streams against batch runs of the same rows."""

import random

from pyspark.sql import functions as F

from lexicue.operators.collapse import fuzzy_collapse
from lexicue.operators.learning import session_stats
from lexicue.plans import streaming as P
from lexicue.streaming import streams as St


def run(spark, df, fold, tmp_path, name, mode="append", files=3, order="ts_ms"):
    """Write the rows as ordered files, then stream them one file at a time into memory."""
    src = str(tmp_path / f"{name}-src")
    n = df.count()
    cut = df.withColumn("__n", F.row_number().over(__import__("pyspark").sql.Window.orderBy(order)))
    for i in range(files):
        part = cut.filter((F.col("__n") > n * i // files) & (F.col("__n") <= n * (i + 1) // files)).drop("__n")
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = fold(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def events(spark, n=120):
    r = random.Random(1)
    rows = [(r.randrange(3), 1_700_000_000_000 + i * 9_000, r.randrange(6), i) for i in range(n)]
    return spark.createDataFrame(rows, "user_id bigint, ts_ms bigint, k int, id bigint").withColumn("ts", F.timestamp_millis("ts_ms"))


def test_view_counts(spark, tmp_path):
    ev = events(spark)
    got = run(spark, ev, lambda s: St.view_counts(s, "ts", "user_id"), tmp_path, "vc", "update")
    latest = got.groupBy("user_id", "window_start").agg(F.max("views").alias("views"))
    want = St.view_counts(ev, "ts", "user_id")
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.collect()))


def test_first_views(spark, tmp_path):
    ev = events(spark)
    got = run(spark, ev, lambda s: St.first_views(s, "ts", ["user_id", "k"]), tmp_path, "fv")
    assert got.count() == ev.select("user_id", "k").distinct().count() == got.select("user_id", "k").distinct().count()


def shuffled(df, spread, *end):
    """Rows with an event time, arriving up to ``spread`` ms late, and a last row that moves the watermark past all."""
    late = df.withColumn("arrives", F.col("ts_ms") + F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    spark = df.sparkSession
    last = spark.createDataFrame([end], df.schema).withColumn("arrives", F.lit(1 << 60))
    return late.unionByName(last).withColumn("ts", F.timestamp_millis("ts_ms"))


def test_ready_notices_in_any_order(spark, tmp_path):
    ev = events(spark).select(F.col("user_id").alias("id"), F.col("id").alias("seq"), F.when(F.col("k") < 2, "ready").otherwise("processing").alias("status"), "ts_ms")
    rows = shuffled(ev, 60_000, 99, 0, "processing", 1_800_000_000_000)
    got = run(spark, rows, lambda s: St.ready_notices(s, "ts", "2 minutes"), tmp_path, "rn", order="arrives", files=6)
    want, last = [], {}
    for r in sorted(ev.collect(), key=lambda r: r.ts_ms):
        if r.status == "ready" and last.get(r.id) != "ready":
            want.append((r.id, r.ts_ms))
        last[r.id] = r.status
    assert sorted(map(tuple, got.collect())) == sorted(want)


def stored(q):
    """Rows of state of the last batch that ran."""
    return sum(op["numRowsTotal"] for op in q["stateOperators"])


def test_state_of_silent_items_goes(spark, tmp_path):
    ev = spark.createDataFrame([(i, i, "ready", 1_700_000_000_000 + i) for i in range(50)], "id bigint, seq bigint, status string, ts_ms bigint")
    rows = ev.unionByName(spark.createDataFrame([(99, 0, "x", 1_700_100_000_000), (99, 1, "x", 1_700_200_000_000)], ev.schema)).withColumn("ts", F.timestamp_millis("ts_ms"))
    src = str(tmp_path / "src")
    for low, high in ((0, 1_700_000_001_000), (1_700_000_001_000, 1_700_150_000_000), (1_700_150_000_000, 1 << 50)):
        rows.filter((F.col("ts_ms") >= low) & (F.col("ts_ms") < high)).coalesce(1).write.mode("append").parquet(src)
    stream = St.ready_notices(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src), "ts", "1 second", keep_ms=60_000)
    q = stream.writeStream.format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        progress = [p for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    assert spark.table("gone").count() == 50
    most = max(map(stored, progress))
    assert most >= 50 and stored(progress[-1]) < 10


def test_segments_equal_the_batch_fold(spark, tmp_path):
    r = random.Random(4)
    rows, at = [], 0
    while at < 20_000:
        text = r.choice(["", "", "abcdefghij", "abcdefghiX", "hello", "hello!"])
        for _ in range(r.choice([1, 2, 4, 8])):
            rows.append((1, at, text))
            at += 100
    rows.append((1, at + 60_000, "end"))  # moves the watermark past everything before
    rows.append((2, at + 60_000, "end"))
    df = spark.createDataFrame(rows, "video bigint, ts_ms bigint, text string").withColumn("ts", F.timestamp_millis("ts_ms"))
    got = run(spark, df, lambda s: St.build_segments(s, "ts", 100, 500), tmp_path, "sg")
    batch = fuzzy_collapse(df.withColumn("frame", F.col("ts_ms")), ["video"], "ts_ms", "text", "frame", 100, 500, 100)
    want = sorted((x.start_ms, x.end_ms, x.match_text) for x in batch.collect() if x.match_text != "end")
    assert sorted((x.start_ms, x.end_ms, x.text) for x in got.collect() if x.text != "end") == want


def test_review_sessions_end_and_equal_the_batch(spark, tmp_path):
    ev = events(spark).select(
        F.col("user_id").alias("session"), F.col("id").alias("review_id"), F.col("k").cast("bigint").alias("card_id"),
        (F.col("k") % 4 + 1).cast("bigint").alias("rating"), (F.col("ts_ms") + F.floor(F.col("id") / 40) * 3_600_000).alias("ts_ms"))
    ev = ev.withColumn("due_ms", F.col("ts_ms") + F.col("card_id") * 200_000)
    rows = shuffled(ev, 60_000, 99, 0, 0, 1, 1_900_000_000_000, 1_900_000_000_000)
    got = run(spark, rows, lambda s: St.review_sessions(s, "ts", 1_800_000, "2 minutes"), tmp_path, "rs", order="arrives", files=5)
    parts = ev.withColumn("part", F.floor(F.col("review_id") / 40))  # an hour lies between parts
    want = session_stats(parts, ["session", "part"], "card_id", ["ts_ms", "review_id"])
    assert sorted((r.session, r.reviewed, r.correct, r.best_streak) for r in got.collect()) == sorted((r.session, r.reviewed, r.correct, r.best_streak) for r in want.collect())
    assert got.count() == 9


def test_upsert_sink_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = St.upsert_sink(path, ["user_id", "k"], F.struct("ts_ms", "id"), buckets=4)
    ev = events(spark).drop("ts")
    first, second = ev.filter("id < 60"), ev.filter("id >= 60")
    for epoch, batch in enumerate((first, second, second, first)):
        sink(batch, epoch)
    got = spark.read.parquet(path).select("user_id", "k", "id")
    want = ev.groupBy("user_id", "k").agg(F.max_by("id", F.struct("ts_ms", "id")).alias("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_segments_in_any_order_within_the_watermark(spark, tmp_path):
    r = random.Random(9)
    rows = [(1, 1000 + i * 100, r.choice(["", "aaaa", "bbbb"]) if i % 7 == 0 else "aaaa" if i % 40 < 25 else "") for i in range(200)]
    end = [(1, 90_000, "end"), (2, 200_000, "end")]
    ordered = spark.createDataFrame(rows + end, "video bigint, ts_ms bigint, text string")
    # neighbours are swapped within five frames, less than the lateness, and files keep that order
    keyed = [(v, t, x, t + (r.randrange(5) * 100 if t < 21_000 else 0)) for v, t, x in rows + end]
    mixed = spark.createDataFrame(keyed, "video bigint, ts_ms bigint, text string, arrives bigint").withColumn("ts", F.timestamp_millis("ts_ms"))
    got = run(spark, mixed, lambda s: St.build_segments(s, "ts", 100, 500), tmp_path, "so", order="arrives", files=6)
    want = fuzzy_collapse(ordered.withColumn("frame", F.col("ts_ms")), ["video"], "ts_ms", "text", "frame", 100, 500, 100)
    assert sorted((x.start_ms, x.end_ms, x.text) for x in got.collect() if x.text != "end") == sorted(
        (x.start_ms, x.end_ms, x.match_text) for x in want.collect() if x.match_text != "end")


def test_backfill_of_unordered_files_loses_nothing(spark, tmp_path):
    from lexicue.plans.streaming import BACKFILL

    ev = events(spark)
    src = str(tmp_path / "src")
    for day in (3, 1, 2, 0):  # newest file first, one file a batch
        ev.withColumn("ts", F.col("ts") + F.make_interval(days=F.lit(day))).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = St.upsert_sink(str(tmp_path / "t"), ["user_id", "window_start"], F.col("views"), buckets=2)
    q = (
        St.view_counts(stream, "ts", "user_id", late=BACKFILL).writeStream.foreachBatch(sink).outputMode("update")
        .option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    want = St.view_counts(spark.read.parquet(src), "ts", "user_id")
    got = spark.read.parquet(str(tmp_path / "t")).select("user_id", "window_start", "views")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_runs_end_after_a_longer_gap(spark):
    """A gap of exactly the width joins, one millisecond more does not."""
    rows = [(u, t) for u, gap in enumerate((6_999, 7_000, 7_001, 7_002)) for t in (1_700_000_000_000, 1_700_000_000_000 + gap)]
    df = spark.createDataFrame(rows, "user_id int, ts_ms bigint").withColumn("ts", F.timestamp_millis("ts_ms"))
    got = St.runs(df, "ts", "user_id", 7_000).groupBy("user_id").count()
    assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 1), (2, 2), (3, 2)]


def test_batches_do_not_grow_with_the_input_files(spark, tmp_path):
    rows = spark.range(8000).select("id", (F.col("id") * 60_000).alias("ts_ms")).repartition(60)
    P._arriving(spark, rows, str(tmp_path), (-1, P.NEVER_MS))
    stored = spark.read.parquet(f"{tmp_path}/source")
    assert len(stored.inputFiles()) <= 130 and stored.count() == 8001


def test_a_call_for_many_reviews_asks_the_state_a_few_times():
    class State:
        calls = 0

        def __getattr__(self, name):
            State.calls += 1
            return lambda *x: name == "containsKey"

    fold = St.ReviewSession("bigint", 1000)
    fold.stats, fold.cards = State(), State()
    fold.stats.exists = lambda: False
    done, again = fold.take((1,), [(i, i, i % 7, 3, i) for i in range(500)], 600)
    assert not done and again == 1500 and State.calls < 10
