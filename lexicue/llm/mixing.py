"""Mixing sources to target weights by Pfair scheduling.

Block i of a source of weight w has the window [floor(i / w), ceil((i + 1) / w)) of the output's slots. In each
slot the released block of the earliest deadline goes first. As the weights sum to one, every block meets its
window, and no source is ever a whole block ahead of or behind its share.

Weights are taken as the exact rational numbers they are, brought to whole numbers in the same ratio. Their sum is a
period after which the schedule repeats: where it is small, one period is planned and all blocks find their slots by
division; else each slot of the phase is planned. When a source runs out, a new phase starts with the weights of the
others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from lexicue.llm.common import chunks_for, ranked, rows_of

#: Longest period that is repeated, or ten times the sources if that is more; phases of a longer one are planned whole.
PERIOD = 1000
#: Documents of a block.
BLOCK = 32
#: Without given weights a source of n documents gets the share of n to this power.
TEMPERATURE = 0.5


class Phase(NamedTuple):
    start: int
    period: int
    slots: int
    quota: dict
    first: dict
    used: dict
    offsets: dict
    releases: dict
    deadlines: dict


def quotas(weights: dict, period: int) -> dict:
    """Whole slots in the exact ratio of the weights; as many as make at most ``period``, if the ratio allows."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    times = max(1, period // (sum(whole.values()) // common))
    return {s: n // common * times for s, n in whole.items()}


def slots(quota: dict, period: int) -> Iterator[tuple]:
    """(source, release, deadline) of each slot without end: earliest deadline first among the released blocks, ties by name."""
    names = sorted(quota, key=repr)
    waiting = [(0, i, 0) for i in range(len(names))]
    ready: list = []
    heapq.heapify(waiting)
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // quota[names[i]]), i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        yield names[i], release, deadline
        heapq.heappush(waiting, ((j + 1) * period // quota[names[i]], i, j + 1))
        t += 1


def one_period(quota: dict, period: int) -> list:
    """The source of each slot of a period."""
    return [s for s, _, _ in islice(slots(quota, period), period)]


def plan(blocks: dict, weights: dict, period: int = PERIOD) -> list[Phase]:
    """Phases until every source has run out; at most as many as there are sources."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, slot, phases = dict.fromkeys(left, 0), 0, []
    longest = max(period, 10 * len(left))
    while left:
        quota = quotas({s: weights[s] for s in left}, period)
        period_slots = sum(quota.values())
        offsets, releases, deadlines = ({s: [] for s in left} for _ in range(3))
        whole = min(left[s] // quota[s] for s in left) if period_slots <= longest else 0
        used = {s: whole * quota[s] for s in left}
        # the last period ends where a source has no block for its slot
        tail, open_ = 0, True
        for t, (s, release, deadline) in enumerate(slots(quota, period_slots)):
            open_ = open_ and used[s] < left[s]
            if t == period_slots if period_slots <= longest else not open_:
                break
            offsets[s].append(t)
            releases[s].append(release)
            deadlines[s].append(deadline)
            if open_:
                used[s] += 1
                tail += 1
        phases.append(Phase(slot, period_slots, whole * period_slots + tail, quota, {s: done[s] for s in left}, used, offsets, releases, deadlines))
        slot += whole * period_slots + tail
        for s, n in used.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return phases


def schedule(
    docs: DataFrame, weights: dict | None = None, key: str = "doc_id", source: str = "source", block: int = BLOCK,
    period: int = PERIOD, temperature: float = TEMPERATURE, seed: int = 11,
) -> DataFrame:
    """All rows of ``docs``, as a struct ``doc`` of their columns, with ``block`` (within the source), ``slot``,
    ``release``, ``deadline`` and ``position`` (the order of the mix).

    A source's documents are dealt into blocks in the order of a hash of their ids; its last block may be smaller.
    No row is left out: when a source ends, the others share its part. Null is a source like others; sources
    without a given weight get the smallest given one. Rows repeated under one id are rows of their own.
    Weights must be positive. The driver gets one count per source, and plans three numbers per slot of a period, or
    per block where the weights have no short period.
    """
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.count("*").alias("n")).collect()}
    if weights is None:
        weights = {s: n**temperature for s, n in counts.items()}
    else:
        least = min(weights.values())
        weights = {s: weights.get(s, least) for s in counts}
    phases = plan({s: -(-n // block) for s, n in counts.items()}, weights, period)
    # a phase that is planned whole has one cycle, longer than any number of its blocks
    table = rows_of(docs.sparkSession, [
        {"_s": s, "_first": p.first[s], "_end": p.first[s] + p.used[s], "_start": p.start,
         "_period": p.period if len(p.offsets[s]) == p.quota[s] else 0, "_each": len(p.offsets[s]),
         "_offsets": p.offsets[s], "_releases": p.releases[s], "_deadlines": p.deadlines[s]}
        for p in phases for s in p.quota if p.used[s]
    ], "_s string, _first bigint, _end bigint, _start bigint, _period bigint, _each bigint, "
        "_offsets array<bigint>, _releases array<bigint>, _deadlines array<bigint>")
    rows = docs.select(F.struct("*").alias("doc"), F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"))
    keyed = ranked(rows, ["_source"], F.xxhash64(F.col("_key"), F.lit(seed)), "_rank", max(64, chunks_for(max(counts.values(), default=0))))
    b, i = F.floor(F.col("_rank") / block), F.col("block") - F.col("_first")
    own = F.col("_s").eqNullSafe(F.col("_source")) & (F.col("block") >= F.col("_first")) & (F.col("block") < F.col("_end"))
    begin = F.col("_start") + F.floor(i / F.col("_each")) * F.col("_period")
    at = lambda name: begin + F.get(name, (i % F.col("_each")).cast("int"))
    return keyed.withColumn("block", b).join(F.broadcast(table), own).select(
        "doc", "block", "_rank", at("_offsets").alias("slot"), at("_releases").alias("release"), at("_deadlines").alias("deadline"),
    ).select("doc", "block", "slot", "release", "deadline", (F.col("slot") * block + F.col("_rank") % block).alias("position"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` laid out in the order of the mix: files and rows within them follow it."""
    return schedule(docs, **options).repartitionByRange("position").sortWithinPartitions("position").select("doc.*")
