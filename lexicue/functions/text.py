"""Text expressions: scripts, widths, tokens, similarity, labelled replies, number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexicue import constants as K

CJK = f"[{K.CJK_RANGES}]"


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes only blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def chars(c: Column) -> Column:
    """Code points of a text; ``[]`` for the empty text."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def cjk_ratio(c: Column) -> Column:
    return cjk_count(c) / F.greatest(F.length(c), F.lit(1))


def cjk_dominant(c: Column) -> Column:
    return cjk_count(c) > F.length(c) * F.lit(0.3)


def matches_language(c: Column, language: Column) -> Column:
    """CJK languages keep texts with more than 30 % CJK, all others the rest; blanks never match."""
    ratio = cjk_ratio(c)
    return (strip(c) != "") & F.when(language.isin(K.CJK_LANGUAGES), ratio > 0.3).otherwise(
        ratio <= 0.3
    )


def long_enough(c: Column) -> Column:
    return F.length(c) >= F.when(has_cjk(c), 1).otherwise(2)


def visual_width(c: Column) -> Column:
    narrow = rf"(?U)[^\s{K.CJK_RANGES}]"
    return cjk_count(c) * 2 + F.regexp_count(c, F.lit(narrow))


def too_wide(c: Column) -> Column:
    return visual_width(c) > K.MAX_VISUAL_WIDTH


def split_after_punctuation(c: Column) -> Column:
    parts = F.split(c, rf"(?U)(?<=[{K.SPLIT_AFTER}])\s*")
    return F.filter(parts, lambda p: strip(p) != "")


def char_set(c: Column) -> Column:
    """Distinct characters: compute once per row, before any join, then compare sets."""
    return F.array_distinct(chars(strip(c)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two character sets; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def char_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(char_set(a), char_set(b))


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or 80 % of ``a``'s characters found in ``b``. Not symmetric."""
    found = F.size(F.filter(chars(a), lambda ch: F.contains(b, ch)))
    return (
        (a == b)
        | F.contains(b, a)
        | F.contains(a, b)
        | (found / F.greatest(F.length(a), F.length(b), F.lit(1)) >= K.FUZZY_RATIO)
    )


def normalize_for_match(c: Column) -> Column:
    return F.regexp_replace(c, f"[{K.MATCH_IGNORED}]", "")


def is_noise_token(c: Column) -> Column:
    """Only white space, punctuation and digits (Unicode classes: accented words are words)."""
    return c.rlike(r"(?U)^[\s\W\d]+$")


def tokens(c: Column) -> Column:
    """White-space tokens without blanks and noise; positions count kept tokens only."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: (t != "") & ~is_noise_token(t))


def script_units(c: Column, wide_run_stop: bool = True) -> Column:
    """``array<struct<unit, start>>``: one CJK character, or one run of other visible characters.

    ``wide_run_stop`` ends a run at every CJK range; otherwise only at unified ideographs, so a
    run swallows kana and hangul.
    """
    stop = K.CJK_RANGES if wide_run_stop else K.IDEOGRAPHS
    pieces = F.regexp_extract_all(
        c, F.lit(rf"(?U)([{K.CJK_RANGES}]|\s+|[^\s{K.CJK_RANGES}][^\s{stop}]*)"), 1
    )
    zero = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<unit:string,start:int>>").alias("out"),
    )
    folded = F.aggregate(
        pieces,
        zero,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(p.rlike(r"(?U)^\s"), acc["out"])
            .otherwise(F.array_append(acc["out"], F.struct(p.alias("unit"), acc["at"].alias("start"))))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return folded


def dominant_script_units(c: Column) -> Column:
    """Units of the overlay: every visible character when ideographs dominate, else blank-split."""
    ideographs = F.regexp_count(c, F.lit("[一-鿿㐀-䶿]"))
    per_char = F.filter(
        F.transform(chars(c), lambda ch, i: F.struct(ch.alias("unit"), i.alias("start"))),
        lambda u: strip(u["unit"]) != "",
    )
    spaced = F.transform(
        F.regexp_extract_all(c, F.lit(r"(?U)(\s+|\S+)"), 1), lambda p: p
    )
    zero = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<unit:string,start:int>>").alias("out"),
    )
    runs = F.aggregate(
        spaced,
        zero,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(strip(p) == "", acc["out"])
            .otherwise(F.array_append(acc["out"], F.struct(p.alias("unit"), acc["at"].alias("start"))))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(ideographs > F.length(c) * F.lit(0.3), per_char).otherwise(runs)


def first_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"https?://\S+", 0), F.lit(""))


def minutes_seconds(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def short_count(n: Column) -> Column:
    """0 for none, one decimal of ten-thousands with ``w``, else grouped digits.

    The decimal is that of the quotient as a double, exact ties upwards: 12500 gives 1.3w, 14500, whose quotient
    lies a trace below 1.45, gives 1.4w. Half-way counts are settled by whole-number comparison of the double.
    """
    tenths = F.floor(n / 1000).cast("bigint")
    bits = n / 10000 * F.lit(float(1 << 30))
    whole = F.floor(bits).cast("bigint")
    up = 20 * (bits - whole) >= ((2 * tenths + 1) * F.lit(1 << 30) - 20 * whole).cast("double")
    digits = tenths + F.when((n % 1000 > 500) | ((n % 1000 == 500) & up), 1).otherwise(0)
    return (
        F.when(n.isNull() | (n == 0), F.lit("0"))
        .when(n >= 10000, F.concat(F.floor(digits / 10).cast("string"), F.lit("."), (digits % 10).cast("string"), F.lit("w")))
        .otherwise(F.format_number(n, 0))
    )


def half_up(c: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(c + 0.5)


def content_language(detected: Column) -> Column:
    """Fold Chinese variants into one code and default when nothing was detected."""
    folded = F.when(detected.startswith("zh"), F.lit("zh")).otherwise(detected)
    return F.coalesce(folded, F.lit(K.DEFAULT_LANGUAGE))


def labelled_value(reply: Column, local_label: Column, english_label: str) -> Column:
    """Value of the last line that starts with the localized or English label, after its first colon."""
    lines = F.transform(F.split(reply, "\n"), strip)
    hits = F.filter(
        lines,
        lambda l: l.startswith(F.concat(local_label, F.lit(":"))) | l.startswith(f"{english_label}:"),
    )
    last = F.try_element_at(hits, F.lit(-1))
    return F.coalesce(strip(F.regexp_extract(last, "^[^:]*:(.*)$", 1)), F.lit(""))
