"""I-Match fingerprints in column expressions.

The lexicon is the terms whose share of all documents (and so their inverse document frequency) lies in a band.
A document's distinct terms of the lexicon are sorted and, for each of several randomised subsets of the lexicon,
those in the subset are hashed. A random draw per term places it in one of the subsets and on a level; the terms
from a level up are half of those from the level below. A document uses the two levels at which a subset has about
one of its terms left, so that long and short texts survive edits alike.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexicue.llm.common import let, materialized
from lexicue.operators.staging import staged

#: Shares of documents between which a term's frequency must lie. The lower one bounds the lexicon: it has at most
#: (mean distinct terms of a document) / LEAST terms, however many documents there are.
LEAST, MOST = 0.002, 0.25
#: Randomised subsets of the lexicon (2 to the power of SUBSET_BITS), and terms a document keeps on its own level.
SUBSET_BITS = 4
SUBSETS, KEPT = 1 << SUBSET_BITS, 12
#: Slots of the lexicon's hash table.
SLOTS = 1 << 16
SPLIT = r"[^\p{L}\p{N}]+"
HASH, NONE = 8, "-" * 8


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case words of letters and digits; a term is known by its 64-bit hash."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.lower(text), SPLIT), ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> list[int]:
    """Terms in the band, counted over all documents; a null text counts as an empty one."""
    body = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    counted = body.select(F.explode(terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = docs.count()
    return sorted(r["term"] for r in counted.where((F.col("n") >= least * total) & (F.col("n") <= most * total)).select("term").collect())


def _from_level(t: Column, level: Column) -> Column:
    """Whether the draw above the subset's bits starts with ``level`` zeros."""
    bits = 64 - SUBSET_BITS
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(t, SUBSET_BITS), (F.lit(bits) - level).cast("int")) == 0


def fingerprinted(df: DataFrame, text: str, name: str, known: list[int]) -> DataFrame:
    """Add ``name``: the level, then for each subset the hashes of its terms on that level and the next.

    The level depends on the number of distinct terms. Texts that keep no lexicon term are described by what other
    terms they keep; a subset without a term has no hash. Equal texts get equal fingerprints.
    """
    table: list = [None] * SLOTS
    for t in known:
        at = t % SLOTS
        table[at] = [*(table[at] or []), t]
    slots = F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>")
    df = staged(df, _t=terms(F.col(text)))
    df = staged(df, _level=F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size("_t"), F.lit(1)) / F.lit(float(KEPT))))).cast("int"))
    df = staged(df, _kept=F.sort_array(F.filter("_t", lambda t: _from_level(t, F.col("_level")))))
    df = staged(df, _in=F.filter("_kept", lambda t: F.coalesce(F.array_contains(F.get(slots, F.pmod(t, F.lit(SLOTS)).cast("int")), t), F.lit(False))))
    df = staged(df, _use=F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.col("_kept")))

    def cell(x: Column) -> Column:
        return F.when(F.size(x) == 0, NONE).otherwise(F.substring(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), 1, HASH))

    per_subset = F.transform(
        F.sequence(F.lit(0), F.lit(SUBSETS - 1)),
        lambda r: let(
            F.filter("_use", lambda t: t.bitwiseAND(F.lit(SUBSETS - 1)) == r),
            lambda x: F.concat(cell(x), let(F.filter(x, lambda t: _from_level(t, F.col("_level") + 1)), cell)),
        ),
    )
    out = F.concat(F.lpad(F.col("_level").cast("string"), 2, "0"), F.lit(":"), F.array_join(per_subset, ""))
    return staged(df, **{name: F.lower(out)}).drop("_t", "_level", "_kept", "_in", "_use")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either has, on the higher of both levels; 1 for equal ones.

    Texts whose levels lie two or more apart differ in size by a factor that leaves no likeness.
    """
    la, lb = F.substring(a, 1, 2).cast("int"), F.substring(b, 1, 2).cast("int")

    def at(x: Column, own: Column, r: Column) -> Column:
        return x.substr(r * (2 * HASH) + (F.greatest(la, lb) - own) * HASH + 4, F.lit(HASH))

    pairs = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda r: F.struct(at(a, la, r).alias("a"), at(b, lb, r).alias("b")))
    some = F.filter(pairs, lambda p: (p["a"] != NONE) | (p["b"] != NONE))
    share = let(some, lambda s: F.size(F.filter(s, lambda p: p["a"] == p["b"])) / F.when(F.size(s) > 0, F.size(s)))
    return F.when(a == b, 1.0).when(F.abs(la - lb) > 1, 0.0).otherwise(F.coalesce(share, F.lit(0.0)))


def _before(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Every distinct (id, text) with the one before it by ascending id; the first has the last before it.

    Ids, text hashes and lengths alone are sorted, by range and stored; only the last row of each range goes to the
    next one. Null ids come first, texts under one id go by their hash.
    """
    small = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), F.char_length(text).alias("_n"))
    spread = small.groupBy("_id", "_h").agg(F.max("_n").alias("_n"), F.count("*").alias("_m"))
    sorted_ = materialized(
        spread.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h").withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_at", 33))
    row = F.struct(F.col("_id").alias("id"), F.col("_h").alias("h"), F.col("_n").alias("n"))
    lasts = sorted_.groupBy("_range").agg(F.max_by(row, "_at").alias("_last"))
    every = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = lasts.select(  # one row per range
        F.col("_range").alias("_of"),
        F.coalesce(F.lag("_last").over(W.orderBy("_range")), F.last("_last").over(every)).alias("_carried"),
    )
    inside = F.lag(row).over(W.partitionBy("_range").orderBy("_at"))
    return (
        sorted_.withColumn("_prev", inside).join(F.broadcast(carried), F.col("_range") == F.col("_of"))
        .select("_id", "_h", "_m", F.coalesce("_prev", "_carried").alias("_prev"))
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they and the next one's are.

    The edited text has the last quarter replaced by the start of the next document's text, by ascending id; the
    last document's next is the first. A null text counts as empty. Repeated rows are documents of their own that
    follow each other; null ids come first; an empty table gives no rows; other columns are not read.

    Texts move once, by their id, and their starts once more. Every text's fingerprint is taken where it is read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    known = lexicon(docs, text)
    small = materialized(_before(docs, key, body))
    read = docs.select(F.col(key).alias("_id"), body.alias("_text"), F.xxhash64(body).alias("_h"))
    # one key for id and text: all that follows is dealt by it, so texts stay where their first exchange put them
    keyed = fingerprinted(read, "_text", "_fp", known).select(F.xxhash64("_id", "_h").alias("_k"), "_h", "_text", "_fp")
    numbered = keyed.repartition("_k").withColumn("_copy", F.row_number().over(W.partitionBy("_k", "_h").orderBy("_h")))

    def same(k: str, h: str) -> Column:
        # the bounds on the hash settle keys that collide; as an equality they would be a second key to deal by
        return (F.col("_k") == F.col(k)) & (F.col("_h") >= F.col(h)) & (F.col("_h") <= F.col(h))

    left = small.select(F.xxhash64("_id", "_h").alias("_sk"), F.col("_h").alias("_sh"), "_id", "_m", "_prev")
    placed = numbered.join(left, same("_sk", "_sh")).drop("_sk", "_sh")
    starts = placed.where("_copy = 1").select(
        F.xxhash64("_prev.id", "_prev.h").alias("_pk"), F.col("_prev.h").alias("_ph"),
        F.col("_text").substr(F.lit(1), F.floor(F.col("_prev.n") / 4).cast("int")).alias("_start"), F.col("_fp").alias("_next_fp"),
    )
    n = F.char_length("_text")
    last = F.col("_copy") == F.col("_m")
    own_start = F.col("_text").substr(F.lit(1), F.floor(n / 4).cast("int"))
    joined = placed.join(starts, same("_pk", "_ph")).select(
        "_id", "_fp", n.cast("long").alias("_n"), F.when(last, F.col("_next_fp")).otherwise(F.col("_fp")).alias("_next_fp"),
        F.concat(
            F.col("_text").substr(F.lit(1), (n - F.floor(n / 4)).cast("int")), F.when(last, F.col("_start")).otherwise(own_start)
        ).alias("_edited"),
    )
    both = fingerprinted(joined, "_edited", "_edited_fp", known)
    return both.select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("_fp").alias("fingerprint"), F.col("_edited_fp").alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
    )
