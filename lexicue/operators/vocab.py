"""Words: occurrences, numbering, first sentences, definition plans and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexicue import constants as K
from lexicue.functions import text as T
from lexicue.operators.scans import Look, scan
from lexicue.sources.dimensions import fixed


def occurrences(segments: DataFrame, keys: list[str], order: list[str], text: str, chunk: Column | None = None) -> DataFrame:
    """One row per kept token with its 0-based number along the transcript.

    Numbers are a running count over segments plus the position inside the segment, so tokens themselves
    are never sorted or windowed. The text is shuffled, its tokens are not: they are split off again behind the scan.
    """
    tokened = segments.withColumn("__n", F.size(T.tokens(F.col(text))).cast("bigint"))
    numbered = scan(tokened, keys, order, [Look("__before", F.col("__n"), "sum", inclusive=False)], chunk)
    return numbered.select(
        *segments.columns, F.posexplode(T.tokens(F.col(text))).alias("__pos", "word"), "__before"
    ).select(*segments.columns, "word", (F.col("__before") + F.col("__pos")).alias("word_index"))


def languages(spark) -> DataFrame:
    """Target languages: a fixed dimension of twelve rows."""
    return fixed(spark, ["code", "name"], K.TARGET_LANGUAGES)


def definition_plan(words: DataFrame, language: str) -> DataFrame:
    """Each word once per target language other than its own.

    The language list is a constant array exploded per row: no join at all.
    """
    codes = F.array(*[F.lit(c) for c, _ in K.TARGET_LANGUAGES])
    return words.withColumn(
        "target_language", F.explode(F.filter(codes, lambda c: c != F.col(language)))
    )


def reuse(words: DataFrame, definitions: DataFrame, keys: list[str], payload: list[str], order: list[str]) -> DataFrame:
    """First definition per word and target language from any video."""
    best = definitions.groupBy(*keys, "target_language").agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("__d")
    ).select(*keys, "target_language", *[F.col("__d")[c].alias(c) for c in payload])
    return words.join(best, keys)


def missing(words: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return words.join(known.select(*keys), keys, "left_anti")


def completeness(definitions: DataFrame, word: str, expected: int) -> DataFrame:
    per = definitions.select(word, "target_language").distinct().groupBy(word).agg(F.count("*").alias("languages"))
    return per.withColumn("share", F.col("languages") / expected)


def request_text(word: Column, sentence: Column, source: Column, target: Column) -> Column:
    """Text asking for one word's translation, with labels in the target language."""
    def pick(values: dict, key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)

    names = dict(K.TARGET_LANGUAGES)
    label = lambda i: F.coalesce(pick({k: v[i] for k, v in K.REQUEST_LABELS.items()}, target), F.lit(K.REQUEST_LABELS["en"][i]))
    reply = lambda i: F.coalesce(pick({k: v[i] for k, v in K.REPLY_LABELS.items()}, target), F.lit(K.REPLY_LABELS["en"][i]))
    name_of = lambda c: F.coalesce(pick(names, c), c)
    return F.concat(
        label(0), F.lit(" "), name_of(source), F.lit(" "), label(1), F.lit(' "'), word, F.lit('" '),
        label(2), F.lit(" "), name_of(target), F.lit(" "), label(3), F.lit(': "'), sentence, F.lit('"\n\n'),
        label(5), F.lit("\n"),
        reply(0), F.lit(": <"), name_of(target), F.lit(">\n"),
        reply(1), F.lit(": <"), name_of(target), F.lit(">\n"),
        reply(2), F.lit(": <noun/verb/adjective/etc.>\n\n"),
        label(4),
    )


def parse_reply(reply: Column, target: Column) -> list[Column]:
    """Translation, definition and part of speech out of labelled lines."""
    english = K.REPLY_LABELS["en"]

    def local(i: int) -> Column:
        pairs = F.create_map(*[F.lit(x) for k, v in K.REPLY_LABELS.items() for x in (k, v[i])])
        return F.coalesce(F.try_element_at(pairs, target), F.lit(english[i]))

    return [
        T.labelled_value(reply, local(i), english[i]).alias(n)
        for i, n in enumerate(("translation", "contextual_definition", "part_of_speech"))
    ]


