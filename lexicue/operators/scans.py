"""Ordered scans that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, so a key with a third of the
rows decides the run time. Here the order axis is cut into chunks (a day of time, a range of ids): each
(key, chunk) is scanned on its own, one summary row per chunk is scanned across chunks, and the
carried value is joined back. Rows are shuffled once. Results equal those of the plain window. Without ``chunk`` the plain
window is used, for keys known to be short.

Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

_CHUNK = "__chunk"


class Look(NamedTuple):
    """One scanned column.

    ``kind``: ``last`` non-null value, running ``sum``, ``max`` or ``min``. ``ahead`` scans from the end
    (``last`` is then the next non-null value). ``inclusive`` counts the current row.
    """

    out: str
    value: Column
    kind: str = "last"
    ahead: bool = False
    inclusive: bool = True


def chunk_of(col: Column, width: int | float) -> Column:
    return F.floor(col / F.lit(width))


def _shared(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows by (key, chunk) once for both branches of a scan.

    Both read the same shuffle: the generator above it uses every column, so neither branch prunes the
    shuffle into something different. Without this each scan would evaluate its input twice, and a chain
    of scans 2, 4, 8 times.
    """
    rest = [c for c in df.columns if c not in keys and c != _CHUNK]
    hashed = df.repartition(*keys, _CHUNK)
    return hashed.select(*keys, _CHUNK, F.inline(F.array(F.struct(*rest)))) if rest else hashed


def _sealed(df: DataFrame) -> DataFrame:
    """Keep the join's not-null filters above this point; pushed down, they would make its shuffle differ."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _over(look: Look, value: Column, spec) -> Column:
    if look.kind == "last":
        return F.last(value, ignorenulls=True).over(spec)
    return getattr(F, look.kind)(value).over(spec)


def _combine(look: Look, local: Column, carried: Column) -> Column:
    if look.kind == "last":
        return F.coalesce(local, carried)
    if look.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return (F.greatest if look.kind == "max" else F.least)(local, carried)


def _for_keys(keys: list[str], chunk: Column) -> Column:
    """The chunk of a row; a null key stops the job, as what is carried across chunks is joined by equal keys."""
    out = chunk
    for k in keys:
        out = F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null in key {k} of a chunked scan")).cast("bigint")).otherwise(out)
    return out


def scan(
    df: DataFrame, keys: list[str], order: list[str], looks: list[Look], chunk: Column | None = None
) -> DataFrame:
    """Add one column per look, scanned along ``order`` within ``keys``."""

    def frame(look: Look, spec):
        return spec.rowsBetween(Window.unboundedPreceding, 0 if look.inclusive else -1)

    def ordered(look: Look):
        return [F.col(c).desc() if look.ahead else F.col(c).asc() for c in order]

    if chunk is None:
        out = df
        for look in looks:
            spec = Window.partitionBy(*keys).orderBy(*ordered(look))
            got = _over(look, look.value, frame(look, spec))
            out = out.withColumn(look.out, F.coalesce(got, F.lit(0)) if look.kind == "sum" else got)
        return out

    base = _shared(df.withColumn(_CHUNK, _for_keys(keys, chunk)), keys)
    at = F.struct(*[F.col(c) for c in order])
    summaries, carried = [], []
    for i, look in enumerate(looks):
        name = f"__s{i}"
        if look.kind == "last":
            pick = F.min_by if look.ahead else F.max_by
            summaries.append(pick(look.value, F.when(look.value.isNotNull(), at)).alias(name))
        else:
            summaries.append(getattr(F, look.kind)(look.value).alias(name))
        step = F.col(_CHUNK).desc() if look.ahead else F.col(_CHUNK).asc()
        spec = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(_over(look, F.col(name), spec).alias(f"__c{i}"))
    across = _sealed(base.groupBy(*keys, _CHUNK).agg(*summaries).select(*keys, _CHUNK, *carried))

    local = base
    for i, look in enumerate(looks):
        spec = Window.partitionBy(*keys, _CHUNK).orderBy(*ordered(look))
        local = local.withColumn(f"__l{i}", _over(look, look.value, frame(look, spec)))
    joined = local.join(across, [*keys, _CHUNK], "left")
    new = {look.out for look in looks}
    return joined.select(
        *[F.col(c) for c in df.columns if c not in new],
        *[_combine(look, F.col(f"__l{i}"), F.col(f"__c{i}")).alias(look.out) for i, look in enumerate(looks)],
    )


def row_numbers(df, keys, order, out="row_number", chunk=None) -> DataFrame:
    """Number rows from 1 within ``keys``."""
    return scan(df, keys, order, [Look(out, F.lit(1).cast("bigint"), "sum")], chunk)


def islands(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    state: list[str],
    changed: Callable[[Column, Column], Column],
    chunk: Column | None = None,
    out: str = "island",
) -> DataFrame:
    """Number runs of rows; a run starts where ``changed(previous, current)`` holds.

    ``previous`` and ``current`` are structs of the ``state`` columns. One join back serves both the
    previous row and the running count.
    """
    cur = F.struct(*[F.col(c) for c in state])
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        prev = F.lag(cur).over(w)
        flagged = df.withColumn("__prev", prev).withColumn(
            "__flag", F.when(F.col("__prev").isNull() | ~changed(F.col("__prev"), cur), 0).otherwise(1)
        )
        total = F.sum("__flag").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return flagged.withColumn(out, total).drop("__prev", "__flag")

    base = _shared(df.withColumn(_CHUNK, _for_keys(keys, chunk)), keys)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    local = base.withColumn("__prev", F.lag(cur).over(w)).withColumn(
        "__flag", F.when(F.col("__prev").isNull() | ~changed(F.col("__prev"), cur), 0).otherwise(1)
    )
    at = F.struct(*[F.col(c) for c in order])
    ends = local.groupBy(*keys, _CHUNK).agg(
        F.min_by(cur, at).alias("__first"), F.max_by(cur, at).alias("__last"), F.sum("__flag").alias("__n")
    )
    wc = Window.partitionBy(*keys).orderBy(_CHUNK)
    ends = (
        ends.withColumn("__before", F.lag("__last").over(wc))
        .withColumn(
            "__edge",
            F.when(
                F.col("__before").isNull() | ~changed(F.col("__before"), F.col("__first")), 0
            ).otherwise(1),
        )
        .withColumn(
            "__base",
            F.coalesce(
                F.sum(F.col("__n") + F.col("__edge")).over(wc.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            )
            + F.col("__edge"),
        )
        .select(*keys, _CHUNK, "__base")
    )
    ends = _sealed(ends)
    counted = local.withColumn(
        "__run", F.sum("__flag").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return counted.join(ends, [*keys, _CHUNK], "left").select(
        *[F.col(c) for c in df.columns if c != out], (F.col("__run") + F.col("__base")).alias(out)
    )


def asof(
    points: DataFrame,
    targets: DataFrame,
    keys: list[str],
    point_at: str,
    target_at: str,
    payload: list[str],
    directions: dict[str, tuple[str, bool]],
    prefer: str | None = None,
    chunk_width: int | float | None = None,
    unique: bool = False,
) -> DataFrame:
    """Nearest target before or after each point, by one scan over the union of both sides.

    ``directions`` maps an output struct column to ``("backward" | "forward", strict)``. Of several
    targets at one time the lowest ``prefer`` wins; they are reduced before the scan unless times are known to be ``unique``.
    """
    value = F.struct(F.col(target_at).alias("at"), *[F.col(c) for c in payload])
    if unique:
        best = targets.select(*keys, F.col(target_at).alias("__at"), value.alias("__target"))
    else:
        best = targets.groupBy(*keys, F.col(target_at).alias("__at")).agg(
            F.min_by(value, F.col(prefer or target_at)).alias("__target")
        )
    rest = [c for c in points.columns if c not in keys]
    left = points.select(
        *keys, F.col(point_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*rest).alias("__point")
    )
    both = left.unionByName(best.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    # At equal times a look must meet the target first unless it is strict, so the two sides are ordered
    # one way (targets first) for backward and strict forward looks, the other way for the rest.
    looks = [(o, d == "forward", strict) for o, (d, strict) in directions.items()]
    chunk = chunk_of(F.col("__at"), chunk_width) if chunk_width else None
    out = both
    for rank in (0, 1):
        group = [
            Look(o, F.col("__target"), "last", ahead)
            for o, ahead, strict in looks
            if (rank == 0) == ((not ahead) != strict)
        ]
        if group:
            side = F.col("__side") if rank == 0 else 1 - F.col("__side")
            out = scan(
                out.withColumn("__rank", side), keys, ["__at", "__rank"], group, chunk
            ).drop("__rank")
    return out.filter(F.col("__side") == 1).select(
        *keys, *[F.col("__point")[c].alias(c) for c in rest], *directions
    )
