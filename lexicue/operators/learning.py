"""Reviews, streaks, progress and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexicue import constants as K
from lexicue.functions.text import half_up
from lexicue.operators.scans import Look, scan


def streak_runs(
    reviews: DataFrame, keys: list[str], order: list[str], correct: Column, chunk: Column | None = None
) -> DataFrame:
    """``best_streak`` and ``current_streak`` of correct answers per key."""
    marked = reviews.select(*keys, *order, correct.alias("ok"))
    runs = scan(marked, keys, order, [Look("run", (~F.col("ok")).cast("bigint"), "sum")], chunk)
    per_run = runs.groupBy(*keys, "run").agg(F.count_if("ok").alias("n"))
    return per_run.groupBy(*keys).agg(
        F.max("n").alias("best_streak"), F.max_by("n", "run").alias("current_streak")
    )


def session_stats(
    reviews: DataFrame, keys: list[str], card: str, order: list[str], chunk: Column | None = None
) -> DataFrame:
    """Unique cards, correct answers (repeats included), accuracy, message and best streak."""
    ok = F.col("rating") >= 3
    counts = reviews.groupBy(*keys).agg(
        F.countDistinct(card).alias("reviewed"), F.count_if(ok).alias("correct")
    )
    streaks = streak_runs(reviews, keys, order, ok, chunk).select(*keys, "best_streak")
    acc = accuracy(F.col("correct"), F.col("reviewed"))
    return counts.join(streaks, keys).select(
        *keys, "reviewed", "correct", (F.col("reviewed") - F.col("correct")).alias("to_relearn"),
        "best_streak", acc.alias("accuracy"), performance_band(acc).alias("message"),
    )


def accuracy(correct: Column, reviewed: Column) -> Column:
    return F.when(reviewed > 0, half_up(correct / reviewed * 100)).otherwise(F.lit(0)).cast("bigint")


def performance_band(acc: Column) -> Column:
    # fixed values: message per accuracy band
    return (
        F.when(acc >= 90, "Outstanding!")
        .when(acc >= 70, "Great job!")
        .when(acc >= 50, "Good effort!")
        .otherwise("Keep practicing!")
    )


def motivation(n: Column) -> Column:
    # fixed values: message per number of due cards
    return (
        F.when(n <= 0, "")
        .when(n <= 5, "Quick session ahead")
        .when(n <= 15, "Strengthen your memory")
        .otherwise("Big session today!")
    )


def estimated_minutes(n: Column) -> Column:
    return F.greatest(F.lit(1), half_up(n * 0.5)).cast("bigint")


def day_streaks(days: DataFrame, keys: list[str], day: str, as_of: Column | None = None) -> DataFrame:
    """Runs of consecutive active days. A key has at most one row per day, so its window stays short."""
    distinct = days.select(*keys, day).distinct()
    w = Window.partitionBy(*keys).orderBy(day)
    runs = distinct.withColumn("run", F.col(day) - F.row_number().over(w))
    per_run = runs.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.max(day).alias("last"))
    return per_run.groupBy(*keys).agg(
        F.max("n").alias("longest_streak"),
        F.max_by("n", "last").alias("streak_days"),
        F.max("last").alias("streak_last_day"),
    )


def replay(
    reviews: DataFrame, keys: list[str], at: str, tie: str, chunk: Column | None = None
) -> DataFrame:
    """Per review: number so far, days since the previous one, and the days before that."""
    once = scan(
        reviews, keys, [at, tie],
        [
            Look("reps", F.lit(1).cast("bigint"), "sum"),
            Look("__before", F.col(at), inclusive=False),
        ],
        chunk,
    ).withColumn(
        "elapsed_days",
        F.coalesce(F.floor(F.col(at) / 86_400_000) - F.floor(F.col("__before") / 86_400_000), F.lit(0)),
    ).drop("__before")
    return scan(
        once, keys, [at, tie], [Look("__prev", F.col("elapsed_days"), inclusive=False)], chunk
    ).withColumn("last_elapsed_days", F.coalesce("__prev", F.lit(0))).drop("__prev")


def requeue(reviews: DataFrame, keys: list[str], card: str, at: str, tie: str, due: str) -> DataFrame:
    """First review of a card per session decides: due within ten minutes means one more try at the back."""
    rest = [c for c in reviews.columns if c not in (*keys, card)]
    first = reviews.groupBy(*keys, card).agg(
        F.min_by(F.struct(*rest), F.struct(at, tie)).alias("r")
    )
    return first.select(
        *keys, card, *[F.col("r")[c].alias(c) for c in rest]
    ).withColumn("requeued", F.col(due) - F.col(at) < K.REQUEUE_MS)


def queue_order(reviews: DataFrame, keys: list[str], card: str, at: str, tie: str) -> DataFrame:
    """Mark repeats and the order key of the session queue: first tries in time order, repeats behind them."""
    first = reviews.groupBy(*keys, card).agg(F.min(F.struct(at, tie)).alias("__f"))
    return (
        reviews.join(first, [*keys, card])
        .withColumn("is_repeat", F.struct(at, tie) != F.col("__f"))
        .drop("__f")
    )


def counters(base: DataFrame, key: str, facts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left-join one grouped count per fact table; missing means 0."""
    out = base
    for name, (rows, fk) in facts.items():
        n = rows.groupBy(F.col(fk).alias(key)).agg(F.count("*").alias(name))
        out = out.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def apply_delta(old: Column, delta: Column) -> Column:
    return F.greatest(F.coalesce(old, F.lit(0)) + delta, F.lit(0))


RANK_PARTS = 32


def frequency_rank(words: DataFrame, language: str, word: str, count: str, out: str = "frequency_rank") -> DataFrame:
    """``rank()`` by falling count per language without sorting a language in one task.

    Words that share a count share a rank, so ranks are computed over the few distinct counts and joined back. Most words occur once:
    each (language, count) is dealt to RANK_PARTS keys, so that no task gets all words of one count.
    """
    levels = words.groupBy(language, count).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(language).orderBy(F.col(count).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.withColumn(out, F.coalesce(F.sum("__n").over(w), F.lit(0)) + 1).drop("__n")
    dealt = ranks.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(RANK_PARTS - 1))))
    own = words.withColumn("__part", F.pmod(F.xxhash64(word), F.lit(RANK_PARTS)).cast("int"))
    return own.join(dealt, [language, count, "__part"]).select(*words.columns, out)


