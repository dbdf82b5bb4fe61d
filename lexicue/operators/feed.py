"""Feeds, queues and searches: filters, keyset pages, unseen items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keyset_page(
    rows: DataFrame,
    order: list[str],
    limit: int,
    after: tuple | None = None,
    compound: bool = True,
) -> DataFrame:
    """Next ``limit`` rows, newest first, behind the cursor ``after`` (one value per order column).

    The compound cursor compares all columns; the simple one only the first, and so skips rows that tie
    with the cursor on it.
    """
    if after is not None:
        first = F.col(order[0]) < F.lit(after[0])
        if compound:
            same = F.lit(True)
            cond = F.lit(False)
            for col, value in zip(order, after):
                cond = cond | (same & (F.col(col) < F.lit(value)))
                same = same & (F.col(col) == F.lit(value))
            # the first column alone bounds the rows, which the scan can push down
            rows = rows.filter((F.col(order[0]) <= F.lit(after[0])) & cond)
        else:
            rows = rows.filter(first)
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def next_cursor(page: DataFrame, order: list[str], limit: int) -> DataFrame:
    """One row with the last row's order columns, or nulls when the page is not full."""
    last = F.min_by(F.struct(*order), F.struct(*order))
    full = F.count("*") == limit
    return page.agg(*[F.when(full, last[c]).alias(c) for c in order])


def unseen(rows: DataFrame, views: DataFrame, key: str) -> DataFrame:
    return rows.join(views.select(key), key, "left_anti")


def top_per_key(rows: DataFrame, key: list[str], order: list[Column], limit: Column | int, out: str = "rank") -> DataFrame:
    """First ``limit`` rows per key. Spark limits each group before the shuffle when the limit is a literal."""
    from pyspark.sql import Window

    ranked = rows.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col(out) <= limit)


def contains_text(cols: list[str], query: str) -> Column:
    """Case-insensitive containment in any column; queries under two characters match nothing."""
    if len(query) < 2:
        return F.lit(False)
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.col(c).ilike(f"%{query}%")
    return hit
