"""Frame sequences to timed segments: exact and fuzzy collapse, flicker merge, near-duplicate removal.

Fuzzy rules compare with the first text of the open segment or with the last kept row. Similarity is not
transitive, so they need an ordered fold; long keys are folded in chunks. Runs of equal text, which always share one
decision, are merged before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexicue import constants as K
from lexicue.operators.folds import Fold, split_fold
from lexicue.operators.scans import Look, islands, scan


#: Runs of equal text in one chunk of the fuzzy fold.
RUNS = 50_000


def exact_collapse(
    frames: DataFrame,
    keys: list[str],
    at: str,
    text: str,
    interval: int,
    min_duration: int,
    tie: str | None = None,
    keep: list[str] | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Runs of frames with equal text; an empty frame ends a run. ``keep`` columns come from its first frame."""
    order = [at] + ([tie] if tie else [])
    runs = islands(
        frames.select(*keys, *order, text, *(keep or [])),
        keys,
        order,
        [text],
        lambda prev, cur: prev[text] != cur[text],
        chunk,
    ).filter(F.col(text) != "")
    first = F.struct(*[F.col(c) for c in order])
    return (
        runs.groupBy(*keys, "island")
        .agg(
            F.min(at).alias("start_ms"),
            (F.max(at) + interval).alias("end_ms"),
            F.first(text).alias(text),
            *[F.min_by(c, first).alias(c) for c in keep or []],
        )
        .filter(F.col("end_ms") - F.col("start_ms") >= min_duration)
        .drop("island")
    )


def carry_forward(
    frames: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunk: Column | None = None
) -> DataFrame:
    """Last value seen so far; rows before the first keep null."""
    return scan(frames, keys, order, [Look(out, value)], chunk)


def gap_groups(
    events: DataFrame, keys: list[str], at: str, max_gap: int, tie: str | None = None, chunk: Column | None = None,
    out: str = "island",
) -> DataFrame:
    """Number groups of events; a longer gap than ``max_gap`` starts a new one."""
    return islands(
        events, keys, [at] + ([tie] if tie else []), [at], lambda p, c: c[at] - p[at] > max_gap, chunk, out
    )


def keyframes(
    frames: DataFrame, keys: list[str], order: str, vectors: str, bands: int, threshold: float, every: int,
    chunk: Column | None = None,
) -> DataFrame:
    """Mark frames worth reading: the first, every n-th, and those where some band's mean change is large.

    ``vectors`` is an array of numbers cut into ``bands`` equal slices. Adds ``position`` (from 0) and
    ``is_key``.
    """
    looked = scan(
        frames,
        keys,
        [order],
        [
            Look("__prev", F.col(vectors), inclusive=False),
            Look("__n", F.lit(1).cast("bigint"), "sum"),
        ],
        chunk,
    )
    width = F.size(vectors) / bands
    diffs = F.zip_with(F.col("__prev"), F.col(vectors), lambda a, b: F.abs(a - b).cast("double"))

    def mean(band: int) -> Column:
        lo = F.floor(width * band).cast("int")
        hi = F.floor(width * (band + 1)).cast("int")
        part = F.slice(diffs, lo + 1, hi - lo)
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)

    changed = F.lit(False)
    for b in range(bands):
        changed = changed | (mean(b) > threshold)
    position = F.col("__n") - 1
    return looked.select(
        *frames.columns,
        position.alias("position"),
        (F.col("__prev").isNull() | (position % every == 0) | changed).alias("is_key"),
    )


# --- fuzzy collapse --------------------------------------------------------------------------
def similar(a: str, b: str) -> bool:
    """Row-level form of :func:`lexicue.functions.text.fuzzy_equal` for folds."""
    if a in b or b in a:
        return True
    letters = set(b)
    return sum(ch in letters for ch in a) / max(len(a), len(b)) >= K.FUZZY_RATIO


class FuzzyFold(Fold):
    """State: the open segment, or None, and the start of the empty stretch after it, or None."""

    def __init__(self, keys: list[str], interval: int, tolerance: int):
        self.keys, self.interval, self.tolerance = keys, interval, tolerance

    def step(self, state, row):
        seg, empty_since = state or (None, None)
        text, first, last = row["match_text"], row["first_ms"], row["last_ms"]
        if not text:
            if seg is None:
                return state, []
            since = first if empty_since is None else empty_since
            if last > since and last - since + self.interval > self.tolerance:
                return None, [seg]
            return (seg, since), []
        end = last + self.interval
        if seg is not None and similar(text, seg["match_text"]):
            return (seg | {"end_ms": end, "last_frame": row["last_frame"]}, None), []
        fresh = {k: row[k] for k in self.keys} | {
            "start_ms": first, "end_ms": end, "match_text": text, "last_frame": row["last_frame"],
        }
        return (fresh, None), [] if seg is None else [seg]

    def close(self, state):
        return [state[0]] if state and state[0] is not None else []


def fuzzy_collapse(
    frames: DataFrame,
    keys: list[str],
    at: str,
    text: str,
    frame_id: str,
    interval: int,
    tolerance: int,
    min_duration: int,
    chunk: Column | None = None,
) -> DataFrame:
    """Segments of similar text that bridge short empty stretches.

    Output: keys, ``start_ms``, ``end_ms``, ``match_text`` (first text) and ``last_frame`` (whose
    detections the segment shows).
    """
    runs = islands(
        frames.select(*keys, at, frame_id, text), keys, [at, frame_id], [text],
        lambda p, c: p[text] != c[text], chunk, "run",
    )
    stretch = runs.groupBy(*keys, "run").agg(
        F.min(at).alias("first_ms"),
        F.max(at).alias("last_ms"),
        F.max_by(frame_id, F.struct(at, frame_id)).alias("last_frame"),
        F.first(text).alias("match_text"),
    )
    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        f", start_ms bigint, end_ms bigint, match_text string, last_frame {types[frame_id]}"
    )
    run_chunk = F.floor(F.col("run") / RUNS) if chunk is not None else None
    folded = split_fold(stretch, keys, ["run"], FuzzyFold(keys, interval, tolerance), schema, run_chunk)
    return folded.filter(F.col("end_ms") - F.col("start_ms") >= min_duration)


class _FlickerFold(Fold):
    """State: the last captioned segment; plain segments pass through untouched."""

    def step(self, state, row):
        if not row["low_text"]:
            return state, [row]
        if state is not None and row["start_ms"] - state["end_ms"] <= K.FLICKER_MS and similar(row["low_text"], state["low_text"]):
            return state | {c: row[c] for c in ("end_ms", "last_frame", "low_text")}, []
        return row, [] if state is None else [state]

    def close(self, state):
        return [] if state is None else [state]


def flicker_merge(
    segments: DataFrame, keys: list[str], chunk: Column | None = None
) -> DataFrame:
    """Extend the last captioned segment when the same caption returns within 1.5 s.

    Needs ``start_ms``, ``end_ms``, ``low_text`` (empty when the segment shows no caption) and
    ``last_frame``; other columns stay with the segment that is kept.
    """
    # equal starts have one order
    return split_fold(segments, keys, ["start_ms", "end_ms", "last_frame"], _FlickerFold(), ddl(segments), chunk)


class _NearDuplicateFold(Fold):
    """State: the last kept row and its letters."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def step(self, state, row):
        letters = frozenset(row["text"].strip())
        if state is not None:
            kept, known = state[0], frozenset(state[1])
            if letters and known and len(letters & known) / len(letters | known) >= self.threshold:
                return state if row["end_ms"] <= kept["end_ms"] else (kept | {"end_ms": row["end_ms"]}, state[1]), []
        return (row, "".join(sorted(letters))), [] if state is None else [state[0]]

    def close(self, state):
        return [] if state is None else [state[0]]


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def drop_near_duplicates(
    rows: DataFrame, keys: list[str], order: list[str], threshold: float = K.NEAR_DUPLICATE, chunk: Column | None = None
) -> DataFrame:
    """Drop a row whose characters nearly equal those of the last kept row, extending that row's end.

    Needs ``text`` and ``end_ms``. ``chunk`` never falls along ``order``.
    """
    return split_fold(rows, keys, order, _NearDuplicateFold(threshold), ddl(rows), chunk)
