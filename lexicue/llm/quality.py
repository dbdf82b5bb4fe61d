"""Quality rules in column expressions: surface counts, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hash buckets of words and word pairs: one of trusted documents, one of
the whole corpus. A document's score is the sum over its n-grams divided by their number, so length does not
matter. The threshold is one number for all documents, taken from trusted documents that the model has not seen.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexicue.llm.common import let, materialized
from lexicue.operators.staging import staged

BUCKETS = 1 << 16
#: Pseudo-count of each bucket.
SMOOTHING = 2.0
#: Weights are kept as whole numbers of 1 / SCALE nats.
SCALE = 10_000
#: Scores are counted in so many cuts of their range until at most ``FEW`` are left around a rank.
CUTS, FEW = 4096, 10_000
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50


class Model(NamedTuple):
    """The buckets' weights, and the least score that is kept (None: no verdict)."""

    weights: list[int]
    threshold: float | None


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _shift(w: Column, by: int) -> Column:
    return F.slice(w, by + 1, F.greatest(F.size(w) - by, F.lit(0)))


def _word_rows(df: DataFrame, w: str, *carried) -> DataFrame:
    """One row per word with the next one (null after the last); a text without words gives one row of nulls."""
    return df.select(
        *carried, F.posexplode_outer(F.arrays_zip(F.col(w).alias("a"), _shift(F.col(w), 1).alias("b"))).alias("_pos", "_pair")
    ).select(*[F.col(c) if isinstance(c, str) else c for c in carried], "_pos", F.col("_pair.a").alias("_a"), F.col("_pair.b").alias("_b"))


def _one() -> Column:
    return F.when(F.col("_a").isNotNull(), F.pmod(F.xxhash64(F.lower("_a")), F.lit(BUCKETS)).cast("int"))


def _two() -> Column:
    return F.when(F.col("_b").isNotNull(), F.pmod(F.xxhash64(F.lower("_a"), F.lower("_b")), F.lit(BUCKETS)).cast("int"))


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more, each word once.

    Windows are sorted by their hash, so that equal ones are neighbours; the places of repeated windows, sorted,
    cover three words each less what the next one covers. Texts without a repeat stop at the first step.
    """
    windows = F.slice(
        F.transform(F.arrays_zip(w.alias("a"), _shift(w, 1).alias("b"), _shift(w, 2).alias("c")), lambda x: F.xxhash64(x)),
        1, F.greatest(F.size(w) - 2, F.lit(0)),
    )

    def covered(places: Column) -> Column:
        gaps = F.zip_with(
            F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))),
            F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))),
            lambda a, b: F.least(b - a, F.lit(3)),
        )
        return F.when(F.size(places) == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda s, g: s + g))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(pairs, lambda p: F.transform(
            F.filter(
                F.transform(p, lambda x, k: F.struct(
                    x["i"].alias("i"),
                    (
                        F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))
                    ).alias("again"),
                )),
                lambda x: x["again"],
            ),
            lambda x: x["i"],
        ))
        return F.sort_array(same)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
        let(places(h), covered)
    )).cast("long")


def surface(text: Column) -> dict[str, Column]:
    """The counts that need no model. ``text`` must not be null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def _scored(rows: DataFrame, weights: list[int], keys: list[str], **more: Column) -> DataFrame:
    """Per key the mean weight of the n-grams (null without any) and further aggregates of its word rows.

    Weights are whole numbers, so sums do not depend on their order.
    """
    # BUCKETS rows of two numbers, written once and broadcast: as a constant they would stand in every text of the plan
    spark = rows.sparkSession
    table = materialized(spark.createDataFrame(pa.table({"_bucket": pa.array(range(BUCKETS), pa.int32()), "_weight": pa.array(weights, pa.int32())})))
    for i, bucket in enumerate((_one(), _two())):
        own = F.broadcast(table.select(F.col("_bucket").alias(f"_bucket{i}"), F.col("_weight").alias(f"_weight{i}")))
        rows = rows.withColumn(f"_bucket{i}", bucket).join(own, f"_bucket{i}", "left")
    total = F.sum(F.coalesce("_weight0", F.lit(0)) + F.coalesce("_weight1", F.lit(0)))
    n = F.count("_a") + F.count("_b")
    return rows.groupBy(*keys).agg((total / F.when(n > 0, n) / SCALE).alias("score"), *[c.alias(k) for k, c in more.items()])


def at_ranks(scores: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values of the column ``score`` (no nulls) at 0-based ``ranks`` of its order, exactly.

    The range is cut evenly and counted, and the cuts that hold a rank are cut again, so the driver sees at most ``CUTS``
    counts or ``FEW`` values at a time however many there are.
    """
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= FEW:
        ordered = sorted(r["score"] for r in scores.collect())
        return {r: ordered[r] for r in ranks}
    cut = F.least(F.floor((F.col("score") - low) / (high - low) * CUTS), F.lit(CUTS - 1))
    parts = scores.groupBy(cut.alias("cut")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n")).collect()
    found, before = {}, 0
    for p in sorted(parts):
        here = [r for r in ranks if before <= r < before + p["n"]]
        if here:
            inside = at_ranks(scores.where(F.col("score").between(p["low"], p["high"])), [r - before for r in here])
            found |= {before + r: v for r, v in inside.items()}
        before += p["n"]
    return found


def percentiles(scores: DataFrame, shares: list[float]) -> list[float] | None:
    """Percentiles of the column ``score``, between two values by linear interpolation; None without any."""
    n = scores.count()
    if not n:
        return None
    at = [(n - 1) * s for s in shares]
    found = at_ranks(scores, sorted({r for x in at for r in (math.floor(x), math.ceil(x))}))
    return [found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in at]


def _counted(texts: DataFrame, name: str) -> dict[int, int]:
    """How often each bucket occurs among the n-grams of ``_text``: at most BUCKETS rows, whatever the corpus."""
    rows = (
        _word_rows(texts.select(words(F.col("_text")).alias("_w")), "_w")
        .select(F.explode(F.array(_one(), _two())).alias("bucket")).where(F.col("bucket").isNotNull())
        .groupBy("bucket").agg(F.count("*").alias(name)).collect()
    )
    return {r["bucket"]: r[name] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Bucket weights from all documents, and the threshold.

    Trusted are all documents labelled of good quality and not toxic; the raw corpus is every document. Three quarters of
    the trusted ones (by hash of the id) give the target, the rest the threshold: one and a half times as far below their
    first percentile as that lies below their median. Without trusted documents there is no threshold.
    """
    chosen = (
        labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
        .select(F.col(key).alias("_id")).where(F.col("_id").isNotNull()).distinct()
        .select("_id", (F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(4)) != 0).alias("_fit"))
    )
    plain = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # read for the target and for the threshold; texts are shuffled once, as the ids grow with the table and are not broadcast
    trusted = materialized(plain.join(chosen.hint("merge"), "_id"))
    targets = _counted(trusted.where("_fit"), "target")
    target = sum(targets.values())
    if not target:
        return Model([0] * BUCKETS, None)
    raws = _counted(plain, "raw")
    raw = sum(raws.values())

    def weight(target_n: int, raw_n: int) -> int:
        return round(SCALE * (
            math.log((target_n + SMOOTHING) / (target + SMOOTHING * BUCKETS)) - math.log((raw_n + SMOOTHING) / (raw + SMOOTHING * BUCKETS))
        ))

    weights = [weight(targets.get(i, 0), raws.get(i, 0)) for i in range(BUCKETS)]
    unseen = staged(
        trusted.where(~F.col("_fit")).select("_id", words(F.col("_text")).alias("_w")), _n=F.size("_w"),
    ).where(F.col("_n") >= MIN_WORDS)
    scores = materialized(_scored(_word_rows(unseen, "_w", "_id"), weights, ["_id"]).select("score").where(F.col("score").isNotNull()))
    q = percentiles(scores, [0.01, 0.5])
    return Model(weights, None if q is None else q[0] - 1.5 * (q[1] - q[0]))


def judge(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts, the score, base_failed, kept, and ``text_hash`` to find its row by.

    A null text counts as empty: it has no words and fails. A score equal to the threshold is kept. Repeated rows
    (same id and text) give repeated rows, an empty table none. Other columns are not read. Texts do not move:
    their words are counted where they are read, one row per document is shuffled.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    counted = staged(base.select("doc_id", "_text", F.xxhash64("_text").alias("text_hash"), words(F.col("_text")).alias("_w")), _n=F.size("_w"))
    local = {**surface(F.col("_text")), "n_repeat_words": repeated_words(F.col("_w"))}
    rows = _word_rows(staged(counted, **local), "_w", "doc_id", "text_hash", *local)
    copies = F.count(F.when(F.coalesce("_pos", F.lit(0)) == 0, 1))
    scored = _scored(
        rows, model.weights, ["doc_id", "text_hash"], _copies=copies, n_words=(F.count("_a") / copies).cast("long"),
        word_chars=(F.coalesce(F.sum(F.char_length("_a")), F.lit(0)) / copies).cast("long"), **{n: F.max(n) for n in local},
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    verdict = F.lit(True) if model.threshold is None else F.coalesce(F.col("score") >= model.threshold, F.lit(False))
    judged = scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)
    return judged.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def accepted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    good = judge(docs, model, key, text).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs[key].eqNullSafe(good["_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == good["_hash"])
    return docs.join(good, same, "left_semi")
