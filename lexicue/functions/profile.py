"""Profile expressions: masking, defaults, learning languages, field changes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexicue import constants as K


def masked(value: Column, owner: Column, viewer: Column) -> Column:
    """Shown to its owner only."""
    return F.when(owner == viewer, F.coalesce(value, F.lit(""))).otherwise(F.lit(""))


def with_defaults(cols: dict[str, tuple[str, object]]) -> list[Column]:
    """``{out: (stored column, default)}`` as renamed, null-free columns."""
    return [F.coalesce(F.col(c), F.lit(d)).alias(out) for out, (c, d) in cols.items()]


#: Profile field -> (stored column, default).
PROFILE_DEFAULTS = {
    "followingCount": ("following_count", 0),
    "followersCount": ("follower_count", 0),
    "nativeLanguage": ("native_language", "en"),
    "targetLanguage": ("target_language", "en"),
    "streakDays": ("streak_days", 0),
    "longestStreak": ("longest_streak", 0),
    "totalWordsLearned": ("total_words_learned", 0),
    "totalVideosWatched": ("total_videos_watched", 0),
    "dailyGoalMinutes": ("daily_goal_minutes", 10),
    "maxReviewsPerDay": ("max_reviews_per_day", 20),
    "premium": ("premium", False),
}
#: Card fields with a zero default.
CARD_ZERO_DEFAULTS = [
    "stability", "difficulty", "elapsed_days", "scheduled_days", "reps", "lapses", "learning_steps",
]


def stored_field(field: Column) -> Column:
    """Stored column of a profile field; an unknown field is an error."""
    pairs = F.create_map(*[F.lit(x) for kv in K.PROFILE_FIELDS.items() for x in kv])
    return F.coalesce(
        F.try_element_at(pairs, field), F.raise_error(F.concat(F.lit("unknown profile field: "), field)).cast("string")
    )


def available_learning(learning: Column, native: Column) -> Column:
    return F.array_remove(learning, native)


def without_native(learning: Column, native: Column) -> Column:
    """Drop the native language unless nothing would remain."""
    rest = F.array_remove(learning, native)
    return F.when(F.size(rest) > 0, rest).otherwise(learning)


def toggle_learning(learning: Column, code: Column) -> Column:
    """Remove a chosen language (the last one stays) or append a new one."""
    return (
        F.when(~F.array_contains(learning, code), F.array_append(learning, code))
        .when(F.size(learning) <= 1, learning)
        .otherwise(F.array_remove(learning, code))
    )


def onboarding_complete(native: Column, learning: Column) -> Column:
    """Both set, and not just the English defaults."""
    only_default = (native == "en") & (F.size(learning) == 1) & (F.get(learning, F.lit(0)) == "en")
    return native.isNotNull() & learning.isNotNull() & (F.size(learning) > 0) & ~only_default


def main_target(learning: Column) -> Column:
    return F.get(learning, F.lit(0))
