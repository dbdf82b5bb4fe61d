"""Text-to-word matching: tapped positions, greedy dictionary cover, entity match by shared text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexicue import constants as K
from lexicue.functions import text as T
from lexicue.operators import intervals as I
from lexicue.operators.scans import asof
from lexicue.operators.staging import materialized, staged

#: Characters of words in one automaton, and taps that meet one copy of it.
PART, SLICE = 500_000, 20_000
#: Characters of the texts that one task covers by a dictionary; each becomes up to four windows.
COVERED = 250_000


def match_taps(taps: DataFrame, words: DataFrame, chunk_width: int | None = None) -> DataFrame:
    """Word under each tapped character.

    Taps: ``tap_id, video, full_text, char_index, time_ms, tapped``. Words: ``video, word_index,
    display_text, start_ms, end_ms`` in start order. Adds ``word_index`` and ``display_text`` of the match
    (null when none) and ``word_start`` in the full text.

    A word matches where its normalized form covers the tapped position; the occurrence nearest in time
    wins. Words are found by one pass of an automaton over the text instead of by comparing every word of the
    video, and the nearest occurrence by a scan over time. Where nothing
    covers the position, a single tapped character takes the first word that contains it, within three
    seconds if possible.
    """
    norm = T.normalize_for_match(F.col("full_text"))
    before = F.length(T.normalize_for_match(F.substring("full_text", F.lit(1), F.col("char_index"))))
    base = staged(taps, __norm=norm, __before=before).withColumn(
        "__at", F.when(F.col("__before") < F.length("__norm"), F.col("__before")).otherwise(F.col("char_index"))
    )
    vocab = words.select("video", T.normalize_for_match(F.col("display_text")).alias("__w")).filter("__w <> ''").distinct()
    covering = (
        _found_at(base.select("tap_id", "video", "__norm", "__at"), vocab)
        .join(base.select("tap_id", F.col("time_ms").alias("__time")), "tap_id")
        .withColumn("__time2", F.col("__time") * 2)
    )
    covering = materialized(covering)
    # twice the middle of a word's time keeps whole numbers
    timed = words.select(
        "video", "word_index", "display_text", T.normalize_for_match(F.col("display_text")).alias("__w"),
        (F.col("start_ms") + F.col("end_ms")).alias("__mid2"),
    ).join(covering.select("video", "__w").distinct(), ["video", "__w"], "left_semi")
    near = asof(
        covering, timed, ["video", "__w"], "__time2", "__mid2", ["word_index", "display_text"],
        {"__back": ("backward", False), "__ahead": ("forward", True)}, "word_index",
        2 * chunk_width if chunk_width else None,
    )

    def option(side: str):
        hit = F.col(side)
        return F.when(
            hit.isNotNull(),
            F.struct(
                F.abs(hit["at"] - F.col("__time2")).alias("dist"), hit["word_index"].alias("word_index"),
                F.col("__pos").alias("pos"), hit["display_text"].alias("display_text"),
            ),
        )

    best = near.select(
        "tap_id",
        F.array_min(F.filter(F.array(option("__back"), option("__ahead")), lambda s: s.isNotNull())).alias("__o"),
    ).groupBy("tap_id").agg(F.min("__o").alias("__best"))

    # one row per tap, read by the matched and by the unmatched branch
    joined = materialized(taps.join(best, "tap_id", "left"))
    # original position of the pos-th kept character
    kept = F.filter(
        F.transform(T.chars(F.col("full_text")), lambda ch, i: F.when(~ch.rlike(f"[{K.MATCH_IGNORED}]"), i)),
        lambda i: i.isNotNull(),
    )
    found = joined.filter("__best IS NOT NULL").select(
        *taps.columns, F.col("__best.word_index").alias("word_index"), F.col("__best.display_text").alias("display_text"),
        F.get(kept, F.col("__best.pos")).alias("word_start"),
    )
    lost = joined.filter("__best IS NULL").select(*taps.columns)
    return found.unionByName(_by_character(lost, words, chunk_width))


def _found_at(taps: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(tap_id, video, __w, __pos)``: words of the tap's video that cover position ``__at`` of ``__norm``, and their first such start.

    A video's words go in parts of bounded size and its taps in slices. Each (part, slice) streams through one task:
    first the words, which become an automaton, then the taps, each read once around its position. Only the characters that the
    video's longest word can reach from there are sent.
    """
    whole = lambda n, most: F.ceil(n / most).cast("int")
    parts = vocab.groupBy("video").agg(whole(F.sum(F.length("__w")), PART).alias("__parts"), F.max(F.length("__w")).alias("__reach"))
    slices = taps.groupBy("video").agg(whole(F.count("*"), SLICE).alias("__slices"))
    sizes = parts.join(slices, "video")
    w = vocab.join(sizes, "video").select(
        "video", F.pmod(F.xxhash64("__w"), "__parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)).alias("slice"), "__w",
    )
    low = F.greatest(F.lit(0), F.col("__at") - F.col("__reach") + 1)
    near = F.substring(F.col("__norm"), low + 1, 2 * F.col("__reach") - 1)
    t = taps.join(sizes, "video").select(
        "video", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("part"), F.pmod(F.xxhash64("tap_id"), "__slices").cast("int").alias("slice"),
        F.struct("tap_id", near.alias("near"), low.alias("low"), "__at").alias("tap"),
    )
    both = w.unionByName(t, allowMissingColumns=True).repartition("video", "part", "slice").sortWithinPartitions("video", "part", "slice", F.col("tap").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        here, automaton = None, None
        for b in batches:
            out: list[tuple] = []
            for video, part, slice_, word, tap in zip(*(c.to_pylist() for c in b.columns)):
                if (video, part, slice_) != here:
                    here, automaton = (video, part, slice_), ahocorasick.Automaton()
                if word is not None:
                    automaton.add_word(word, word)
                    continue
                if automaton.kind == ahocorasick.TRIE:
                    automaton.make_automaton()
                if automaton.kind != ahocorasick.AHOCORASICK:
                    continue
                at, low, first = tap["__at"], tap["low"], {}
                for end, found in automaton.iter(tap["near"]):
                    start = low + end - len(found) + 1
                    if start <= at <= low + end:
                        first.setdefault(found, start)
                out += [(tap["tap_id"], video, found, start) for found, start in first.items()]
            ids, videos, found, starts = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column(4).type.field("tap_id").type), pa.array(videos, b.column(0).type), pa.array(found, pa.string()), pa.array(starts, pa.int32())],
                names=["tap_id", "video", "__w", "__pos"],
            )

    kinds = {c: taps.schema[c].dataType.simpleString() for c in ("tap_id", "video")}
    return both.mapInArrow(run, f"tap_id {kinds['tap_id']}, video {kinds['video']}, `__w` string, `__pos` int")


def _by_character(taps: DataFrame, words: DataFrame, chunk_width: int | None) -> DataFrame:
    # only the characters of unmatched taps are looked up; they go to the words as one row per video, so that a word is
    # not repeated for characters that nobody asks for
    asked = taps.groupBy("video").agg(F.collect_set("tapped").alias("__asked"))
    lettered = materialized(words.join(asked, "video").select(
        "video", "word_index", "display_text",
        (F.col("start_ms") - K.TAP_WINDOW_MS).alias("start_ms"), (F.col("end_ms") + K.TAP_WINDOW_MS).alias("end_ms"),
        F.explode(F.array_intersect(T.chars(F.col("display_text")), F.col("__asked"))).alias("tapped"),
    ))
    anytime = lettered.groupBy("video", "tapped").agg(
        F.min(F.struct("word_index", "display_text")).alias("__any")
    )
    timed = I.covering(
        taps, lettered, ["video", "tapped"], "time_ms", index="word_index", payload=["display_text"],
        chunk_width=chunk_width, out="__near",
    )
    both = timed.join(anytime, ["video", "tapped"], "left")
    shown = F.coalesce(F.col("__near.display_text"), F.col("__any.display_text"))
    at = F.position(shown, F.col("full_text"))
    return both.select(
        *taps.columns,
        F.coalesce(F.col("__near.word_index"), F.col("__any.word_index")).alias("word_index"),
        shown.alias("display_text"),
        F.when(shown.isNull(), F.lit(None).cast("int")).when(at > 0, at - 1).otherwise(F.col("char_index")).cast("int").alias("word_start"),
    )


def orbit(steps: Column) -> Column:
    """Positions reached from 1 by following ``steps`` (the next position of each, from 1 on) while they lie inside.

    Jumps of twice the length are composed from those before, and what was reached is moved by them, so that a text of n
    positions takes log2(n) rounds over whole arrays and nothing is appended one by one.
    """
    n = F.size(steps)
    rounds = F.ceil(F.log2((n + 1).cast("double"))).cast("int")
    inside = lambda jumps, p: F.coalesce(F.get(jumps, p - 1), n + 1)  # noqa: E731  past the end all stays past the end
    state = F.struct(steps.alias("jumps"), F.array(F.lit(1)).alias("seen"))
    doubled = F.aggregate(
        F.sequence(F.lit(1), rounds), state,
        lambda a, _: F.struct(
            F.transform(a["jumps"], lambda p: inside(a["jumps"], p)).alias("jumps"),
            F.concat(a["seen"], F.transform(a["seen"], lambda p: inside(a["jumps"], p))).alias("seen"),
        ),
        lambda a: a["seen"],
    )
    return F.when(n > 0, F.filter(doubled, lambda p: p <= n)).otherwise(F.array().cast("array<int>"))


def greedy_cover(texts: DataFrame, key: str, text: str, dictionary: DataFrame, word: str, reading: str) -> DataFrame:
    """Longest dictionary word at each position from left to right; unmatched characters are skipped.

    Windows of one to four characters meet the dictionary in an equi-join; it is written once, so that its true size decides
    how. Texts are dealt by key to as many tasks as their characters need, and positions are grouped where they are, so the
    memory of a task does not grow with the number of texts. Which windows are used follows from the next position of each, by doubling jumps. Output: key, ``readings`` (joined by
    blanks) and ``syllables`` (``array<struct<pos, syllable>>``). Keys are unique.
    """
    dictionary = materialized(dictionary.select(word, reading))
    characters = texts.agg(F.sum(F.length(text))).first()[0] or 0
    dealt = texts.filter(F.length(text) > 0).select(key, text).repartition(characters // COVERED + 1, key)
    at = dealt.select(key, F.explode(F.sequence(F.lit(1), F.length(text))).alias("__pos"), F.col(text).alias("__t"))
    windows = at.select(
        key, "__pos",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.least(F.lit(K.DICTIONARY_MAX_CHARS), F.length("__t") - F.col("__pos") + 1)),
                lambda n: F.substring(F.col("__t"), F.col("__pos"), n),
            )
        ).alias(word),
    )
    # the first window of a position counts without a word too, so that every position has a row
    known = windows.join(dictionary, word, "left").filter(F.col(reading).isNotNull() | (F.length(word) == 1))
    longest = known.groupBy(key, "__pos").agg(
        F.max(F.struct(F.col(reading).isNotNull().alias("hit"), F.length(word).alias("len"), F.col(reading).alias("r"))).alias("__m")
    )
    per_text = longest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("__pos").alias("pos"), F.col("__m.len").alias("len"), F.col("__m.r").alias("r")))).alias("__at"))
    stepped = staged(per_text, __used=orbit(F.transform("__at", lambda h: h["pos"] + h["len"])))
    chosen = staged(stepped, __hits=F.filter(F.transform("__used", lambda p: F.get("__at", p - 1)), lambda h: h["r"].isNotNull()))
    syllables = F.flatten(
        F.transform(
            "__hits",
            lambda h: F.transform(
                F.slice(F.split(h["r"], " "), F.lit(1), h["len"]),
                lambda s, j: F.struct((h["pos"] - 1 + j).alias("pos"), s.alias("syllable")),
            ),
        )
    )
    out = chosen.select(key, F.array_join(F.transform("__hits", lambda h: h["r"]), " ").alias("readings"), syllables.alias("syllables"))
    return texts.select(key).join(out, key, "left").select(
        key, F.coalesce("readings", F.lit("")).alias("readings"),
        F.coalesce("syllables", F.array().cast("array<struct<pos:int,syllable:string>>")).alias("syllables"),
    )


def shared_opening(local: DataFrame, remote: DataFrame, key: str, remote_key: str, text: str, n: int = 10) -> DataFrame:
    """Local item -> remote item that shares the first ``n`` characters of some text; the highest key wins.

    Remote items are reduced to one per opening first, so a common opening costs one row.
    """
    opening = F.substring(text, 1, n)
    best = remote.groupBy(opening.alias("__o")).agg(F.max(remote_key).alias(remote_key))
    return (
        local.select(key, opening.alias("__o")).distinct().join(best, "__o").groupBy(key).agg(F.max(remote_key).alias(remote_key))
    )
