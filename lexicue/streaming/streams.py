"""Streams: view de-duplication and counts, device sync, ready notices, segment building, review sessions.

Functions that take a DataFrame work on a stream and on a batch alike unless they say otherwise. The
event-time and lateness choices are parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexicue.operators import tables as Tb
from lexicue.operators.collapse import FuzzyFold
from lexicue.sinks.stored import StoredTable

#: A card due again within ten minutes comes back in its session.
SOON_MS = 600_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- windows ----------------------------------------------------------------------------------
def view_counts(views: DataFrame, ts: str, key: str, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Views per item and tumbling window, the buffered counter flush."""
    return (
        views.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("views"))
        .select(key, F.col("w.start").alias("window_start"), "views")
    )


def daily_counters(events: DataFrame, ts: str, user: str, kinds: dict[str, Column], late: str = "1 day") -> DataFrame:
    return (
        events.withWatermark(ts, late).groupBy(user, F.window(ts, "1 day").alias("w"))
        .agg(*[F.count_if(cond).alias(n) for n, cond in kinds.items()])
        .select(user, F.to_date("w.start").alias("day"), *kinds)
    )


def runs(events: DataFrame, ts: str, key: str, gap_ms: int, late: str = "10 minutes") -> DataFrame:
    """Groups of events no further apart than ``gap_ms``; the session ends one gap after its last event."""
    width = f"{gap_ms} milliseconds"  # Spark joins an event that comes exactly at a session's end
    return (
        events.withWatermark(ts, late).groupBy(key, F.session_window(ts, width).alias("w"))
        .agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .drop("w")
    )


def latest_message(messages: DataFrame, chat: str, ts: str, text: str) -> DataFrame:
    """Newest message per conversation (complete or update mode)."""
    return messages.groupBy(chat).agg(F.max_by(text, ts).alias("last_text"), F.max(ts).alias("last_ts"))


def first_views(views: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each view once per key while the watermark remembers it (streams only)."""
    return views.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


# --- keyed table sink ---------------------------------------------------------------------------
def upsert_sink(
    path: str, keys: list[str], order: Column, buckets: int = 64
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that merges each batch into a table of files.

    The table is partitioned by a hash of the key. A batch reads and rewrites only the partitions it
    touches. The greatest ``order`` wins, so a batch that is replayed after a failure changes nothing.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        changes = batch.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
        try:
            stored = spark.read.schema(changes.schema).parquet(path)
            touched = F.broadcast(changes.select("bucket").distinct())  # at most ``buckets`` rows
            both = stored.join(touched, "bucket", "left_semi").unionByName(changes)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            both = changes
        merged = Tb.latest(both, [*keys, "bucket"], order)
        (
            merged.repartition("bucket").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        )

    return merge


def stored_sink(path: str, keys: list[str], schema: str, order: Column) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that merges each batch into a stored table, last write wins; a batch that is replayed is left out."""

    def merge(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()  # counted, dealt to buckets and written
        try:
            StoredTable(batch.sparkSession, path, keys, schema).put_latest(epoch, kept, order)
        finally:
            kept.unpersist()

    return merge


# --- keyed state ----------------------------------------------------------------------------------
class InOrder(StatefulProcessor):
    """Feeds the rows of a key in event-time order, whatever order they come in.

    Rows wait until the watermark has passed them and are then sorted, so any order within the lateness gives the same
    result. ``columns`` are those of the rows, ``ts_ms`` first; ``out`` those of the results.
    """

    columns: str
    out: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        """Declare further state."""

    def take(self, key: tuple, due: list[tuple], passed: int) -> tuple[list[tuple], int | None]:
        """Results of rows that are now in order, and the time at which to be called again without rows."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.columns.split(", ")]
        for batch in rows:
            self.waiting.appendList([tuple(r) for r in batch[names].astype(object).itertuples(index=False)])
            self.handle.registerTimer(int(batch["ts_ms"].max()) + 1)
        yield from ()  # a table for each key of each batch would cost more than the rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in waiting if r[0] < passed], [r for r in waiting if r[0] >= passed]
        done, again = self.take(key, due, passed)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if again is not None:
            self.handle.registerTimer(max(again, passed + 1))
        if done:
            yield self._table(done)

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in self.out.split(", ")])

    def close(self) -> None:
        pass


class ReadyNotices(InOrder):
    """Emit ``(id, ts_ms)`` when an item's status turns to ``ready``; forget items silent for longer than ``keep_ms``."""

    columns = "ts_ms bigint, seq bigint, status string"

    def __init__(self, id_type: str, keep_ms: int):
        self.out, self.keep_ms = f"id {id_type}, ts_ms bigint", keep_ms

    def prepare(self, handle):
        self.last = handle.getValueState("last", "status string, ts_ms bigint")

    def take(self, key, due, passed):
        status, seen = self.last.get() if self.last.exists() else (None, None)
        done = []
        for at, _, now in due:
            if seen is not None and at - seen > self.keep_ms:
                status = None
            if now == "ready" and status != "ready":
                done.append((key[0], at))
            status, seen = now, at
        if seen is None:
            return done, None
        if seen + self.keep_ms < passed:
            self.last.clear()
            return done, None
        self.last.update((status, seen))
        return done, seen + self.keep_ms + 1


def ready_notices(changes: DataFrame, ts: str, late: str = "10 minutes", keep_ms: int = 30 * 86_400_000, id_type: str = "bigint") -> DataFrame:
    """Stream of ``id, seq, status, ts_ms`` (and the event-time column ``ts``) to notices; ``seq`` orders equal times."""
    fold = ReadyNotices(id_type, keep_ms)
    return changes.withWatermark(ts, late).groupBy("id").transformWithStateInPandas(fold, fold.out, "Append", "EventTime")


class SegmentBuilder(StatefulProcessor):
    """The batch fold of frames into segments, fed in time order.

    Frames wait until the watermark has passed them, so any order inside it gives the same segments; then they are
    sorted and pushed through the fold that the batch job uses. A segment still open closes after a long silence.
    """

    def __init__(self, interval: int, tolerance: int):
        self.interval, self.tolerance = interval, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_ms bigint, text string")
        self.open = handle.getValueState("open", "start_ms bigint, end_ms bigint, text string, frame bigint, empty_since bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList([(int(t), x) for t, x in zip(batch["ts_ms"], batch["text"])])
            self.handle.registerTimer(int(batch["ts_ms"].max()) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        due, later = [r for r in waiting if r[0] < passed], [r for r in waiting if r[0] >= passed]
        fold, state, done = FuzzyFold(["video"], self.interval, self.tolerance), None, []
        if self.open.exists():
            start, end, text, frame, since = self.open.get()
            state = {"video": key[0], "start_ms": start, "end_ms": end, "match_text": text, "last_frame": frame}, since
        for at, text in due:
            state, closed = fold.step(state, {"video": key[0], "first_ms": at, "last_ms": at, "last_frame": at, "match_text": text or ""})
            done += closed
        if state is not None:
            # nothing older than the watermark can come, so silence up to it is certain
            silent = state[0]["end_ms"] + self.tolerance + 1
            if silent <= passed:
                done += fold.close(state)
                state = None
            else:
                self.handle.registerTimer(max(silent, passed + 1))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if state is None:
            self.open.clear()
        else:
            self.open.update((*(state[0][k] for k in ("start_ms", "end_ms", "match_text", "last_frame")), state[1]))
        if done:
            yield self._table(done)

    @staticmethod
    def _table(done: list[dict]) -> pd.DataFrame:
        rows = [(s["video"], s["start_ms"], s["end_ms"], s["match_text"], s["last_frame"]) for s in done]
        return pd.DataFrame(rows, columns=["video", "start_ms", "end_ms", "text", "last_ms"])

    def close(self) -> None:
        pass


def build_segments(frames: DataFrame, ts: str, interval: int, tolerance: int, late: str = "1 second", video_type: str = "bigint") -> DataFrame:
    """Stream of ``video, ts_ms, text`` (and the event-time column ``ts``) to closed segments."""
    return frames.withWatermark(ts, late).groupBy("video").transformWithStateInPandas(
        SegmentBuilder(interval, tolerance), f"video {video_type}, start_ms bigint, end_ms bigint, text string, last_ms bigint", "Append", "EventTime"
    )


class ReviewSession(InOrder):
    """Statistics of each review session, given out once it has ended: no review for longer than ``idle_ms``.

    Only the open session of a key is kept: unique cards, correct answers, streaks, cards to repeat soon.
    """

    columns = "ts_ms bigint, review_id bigint, card_id bigint, rating bigint, due_ms bigint"

    def __init__(self, session_type: str, idle_ms: int):
        self.idle_ms = idle_ms
        self.out = f"session {session_type}, start_ms bigint, end_ms bigint, reviewed bigint, correct bigint, best_streak bigint, requeued bigint"

    def prepare(self, handle):
        self.stats = handle.getValueState("stats", "start bigint, seen bigint, reviewed bigint, correct bigint, streak bigint, best bigint, requeued bigint")
        self.cards = handle.getListState("cards", "card bigint")

    def take(self, key, due, passed):
        stats, done = self.stats.get() if self.stats.exists() else None, []
        # the state is read and written once a call: asking it for each row costs more than the row
        known = {c for (c,) in self.cards.get()} if stats is not None and self.cards.exists() else set()

        def end():
            start, seen, reviewed, correct, _, best, requeued = stats
            done.append((key[0], start, seen, reviewed, correct, best, requeued))
            known.clear()

        for at, _, card, rating, due_ms in due:
            if stats is not None and at - stats[1] > self.idle_ms:
                end()
                stats = None
            start, _, reviewed, correct, streak, best, requeued = stats or (at, at, 0, 0, 0, 0, 0)
            if card not in known:
                known.add(card)
                reviewed, requeued = reviewed + 1, requeued + int(due_ms - at < SOON_MS)
            streak = streak + 1 if rating >= 3 else 0
            stats = start, at, reviewed, correct + int(rating >= 3), streak, max(best, streak), requeued
        if stats is None:
            return done, None
        if stats[1] + self.idle_ms < passed:
            end()
            self.stats.clear()
            self.cards.clear()
            return done, None
        self.stats.update(stats)
        if due:
            self.cards.put([(c,) for c in known])
        return done, stats[1] + self.idle_ms + 1


def review_sessions(reviews: DataFrame, ts: str, idle_ms: int, late: str = "10 minutes", session_type: str = "bigint") -> DataFrame:
    """Stream of ``session, review_id, card_id, rating, ts_ms, due_ms`` (and the event-time column ``ts``) to ended sessions."""
    fold = ReviewSession(session_type, idle_ms)
    return reviews.withWatermark(ts, late).groupBy("session").transformWithStateInPandas(fold, fold.out, "Append", "EventTime")
