"""Label lookups on fixed maps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from lexicue import constants as K


def _lookup(values: dict, key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def state_label(state: Column) -> Column:
    return _lookup(K.STATE_LABELS, state.cast("int"), "")


def rating_label(rating: Column) -> Column:
    return _lookup(K.RATING_LABELS, rating.cast("int"), "")


def voice_locale(language: Column) -> Column:
    """Locale for reading aloud; unknown languages are passed through."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(K.VOICE_LOCALES.items())])
    return F.coalesce(F.try_element_at(pairs, language), language)
