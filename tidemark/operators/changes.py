"""Keyed snapshots kept up to date from changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.firsts import last_per_key


def upsert_latest(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str],
    deleted: Column | None = None,
) -> DataFrame:
    """``target`` after ``changes``: the newest change of a key replaces its row.

    ``deleted`` marks changes that remove the row.  ``target`` has the columns of
    ``changes`` that it needs; extra columns of ``changes`` are dropped.
    """
    keys = list(keys)
    flagged = changes.withColumn(
        "_deleted", F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    )
    newest = last_per_key(flagged, keys, list(order))
    kept = target.join(newest.select(*keys), keys, "left_anti").select(*target.columns)
    return kept.unionByName(newest.filter(~F.col("_deleted")).select(*target.columns))


def fold_cells(
    changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], deleted: Column, *more: Column,
) -> DataFrame:
    """What has to be remembered of each key's changes, and ``more`` aggregates: one row per key.

    ``_last_delete`` and ``_last_put`` are the newest order values of either kind,
    ``_new_<column>`` the newest value that is not null, with its order values.
    Of two changes with equal order values a put counts as later than a delete, and
    the larger value as later than the smaller, so the result never depends on how
    the changes were cut into batches.
    """
    at = F.struct(*order)
    gone = F.coalesce(deleted, F.lit(False))
    aggs = [
        F.max(F.when(gone, at)).alias("_last_delete"),
        F.max(F.when(~gone, at)).alias("_last_put"),
    ]
    for c in columns:
        filled = ~gone & F.col(c).isNotNull()
        aggs.append(
            F.max(F.when(filled, F.struct(at.alias("at"), F.col(c).alias("value")))).alias(f"_new_{c}")
        )
    return changes.groupBy(key).agg(*aggs, *more)


def merge_cells(folded: DataFrame, key: str) -> DataFrame:
    """Several folded rows of a key as one."""
    return folded.groupBy(key).agg(*[F.max(c).alias(c) for c in folded.columns if c != key])


def cells_now(folded: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The key, ``columns`` as they are now, ``_wiped`` (deleted at some point) and ``_present``."""
    def after_delete(when: Column) -> Column:
        return F.col("_last_delete").isNull() | (when >= F.col("_last_delete"))

    return folded.select(
        key,
        *[
            F.when(after_delete(F.col(f"_new_{c}.at")), F.col(f"_new_{c}.value")).alias(c)
            for c in columns
        ],
        F.col("_last_delete").isNotNull().alias("_wiped"),
        (F.col("_last_put").isNotNull() & after_delete(F.col("_last_put"))).alias("_present"),
    )


def scd1_changes(
    changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], deleted: Column,
) -> DataFrame:
    """Fold the changes of each key into one row.

    Per column the newest value that is not null counts, if it is not older than the
    key's newest delete.  Gives the key, ``columns``, ``_wiped`` (the key was
    deleted at some point) and ``_present`` (something was put after that).

    One aggregate does it all: a column's newest value is compared with the
    newest delete afterwards, so nothing has to be joined or sorted per key.
    """
    return cells_now(fold_cells(changes, key, columns, order, deleted), key, columns)


def scd1_merge(
    changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[str],
    deleted: Column, snapshot: DataFrame | None = None,
) -> DataFrame:
    """Dimension table after ``changes``: overwrite in place, null leaves the old value.

    A delete removes the row; what is put afterwards starts from an empty row.
    ``order`` has to be total within a key.
    """
    columns = list(columns)
    folded = scd1_changes(changes, key, columns, order, deleted)
    if snapshot is None:
        return folded.filter("_present").select(key, *columns)
    old = snapshot.select(
        F.col(key).alias("_old_key"), *[F.col(c).alias(f"_old_{c}") for c in columns]
    )
    both = old.join(folded, old["_old_key"] == folded[key], "full")
    keep_old = F.col("_old_key").isNotNull() & ~F.coalesce(F.col("_wiped"), F.lit(False))
    return both.filter(keep_old | F.coalesce(F.col("_present"), F.lit(False))).select(
        F.coalesce(F.col(key), F.col("_old_key")).alias(key),
        *[
            F.coalesce(F.col(c), F.when(keep_old, F.col(f"_old_{c}"))).alias(c)
            for c in columns
        ],
    )


def map_columns(data: DataFrame, columns: Sequence[str], source: str = "data") -> DataFrame:
    """Entries of an open map as columns, beside the other columns."""
    return data.select(
        *[c for c in data.columns if c != source],
        *[F.col(source)[c].alias(c) for c in columns],
    )
