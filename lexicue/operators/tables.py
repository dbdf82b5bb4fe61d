"""Table changes as whole-table jobs: upsert, update, delete, cascade and the checks that DDL would make.

Plain files have no MERGE, so each returns the new table for the caller to write. Every change is one
equi-join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Row with the greatest ``order`` per key; partial aggregation keeps one row per key and task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return best.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def first_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return best.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def surrogate_id(*cols: str) -> Column:
    """Stable 128-bit id from a key, as hex: the same row gets the same id when a lost task is run again.

    Each part goes in with its length, a null as its own mark, so different keys never read alike.
    """
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.md5(F.concat(*[part(F.col(c).cast("string")) for c in cols]))


def upsert(
    base: DataFrame, changes: DataFrame, keys: list[str], defaults: dict[str, Column] | None = None
) -> DataFrame:
    """Insert or overwrite by key. Columns the changes lack keep the old value, or take the default.

    ``changes`` must hold one row per key (see :func:`latest`).
    """
    defaults = defaults or {}
    b = base.withColumn("__b", F.lit(True))
    c = changes.select(*keys, *[F.col(x).alias(f"__n_{x}") for x in changes.columns if x not in keys]).withColumn(
        "__c", F.lit(True)
    )
    both = b.join(c, keys, "full_outer")
    sent = set(changes.columns) - set(keys)
    out = []
    for col in base.columns:
        if col in keys:
            out.append(F.col(col))
        elif col in sent:
            out.append(F.when(F.col("__c"), F.col(f"__n_{col}")).otherwise(F.col(col)).alias(col))
        else:
            out.append(F.when(F.col("__b"), F.col(col)).otherwise(defaults.get(col, F.lit(None))).alias(col))
    return both.select(*out)


def update(
    base: DataFrame,
    changes: DataFrame,
    keys: list[str],
    touched: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Overwrite matching rows; keys without a match are ignored. ``touched`` is set where a value changed."""
    sent = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, *[F.col(x).alias(f"__n_{x}") for x in sent]).withColumn("__c", F.lit(True))
    both = base.join(c, keys, "left")
    differs = F.lit(False)
    for x in sent:
        differs = differs | ~F.col(x).eqNullSafe(F.col(f"__n_{x}"))
    changed = F.coalesce(F.col("__c"), F.lit(False)) & differs
    out = []
    for col in base.columns:
        if col == touched:
            out.append(F.when(changed, now).otherwise(F.col(col)).alias(col))
        elif col in sent:
            out.append(F.when(F.col("__c"), F.col(f"__n_{col}")).otherwise(F.col(col)).alias(col))
        else:
            out.append(F.col(col))
    return both.select(*out)


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def insert_missing(base: DataFrame, accounts: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Append a default row for every account the table does not hold yet."""
    fresh = accounts.select(key).distinct().join(base, key, "left_anti")
    return base.unionByName(fresh.select(key, *[defaults[c].alias(c) for c in base.columns if c != key]))


def set_null(child: DataFrame, gone: DataFrame, fk: str, key: str) -> DataFrame:
    """Null out references to deleted rows."""
    g = gone.select(F.col(key).alias(fk)).distinct().withColumn("__gone", F.lit(True))
    return child.join(g, fk, "left").select(
        *[F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == fk else F.col(c) for c in child.columns]
    )


def restricted(parents: DataFrame, children: DataFrame, key: str, fk: str) -> DataFrame:
    """Parents whose deletion must be refused because a child refers to them."""
    return parents.join(children.select(F.col(fk).alias(key)).distinct(), key, "left_semi")


# --- checks -----------------------------------------------------------------------------------
def rule_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, violations)`` for all rules in one pass; null passes a rule, as in a CHECK."""
    counts = rows.agg(*[F.count_if(~F.coalesce(r, F.lit(True))).alias(n) for n, r in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.inline(pairs))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, fk: str, key: str) -> DataFrame:
    return children.filter(F.col(fk).isNotNull()).join(
        parents.select(F.col(key).alias(fk)), fk, "left_anti"
    )
