"""First record per key, per key and day, and ever.

All of them fold rows per task before the shuffle, so a key that holds a large
share of the table reaches its reducer as one row per task.  Every "first" is
taken in an explicit order; give columns that make it total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.times import day_of
from tidemark.operators.traffic import spread_null_keys


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first whole row of every key."""
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    )
    return picked.select("_row.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last whole row of every key."""
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    )
    return picked.select("_row.*")


def dedup_within(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Drop repeated keys and keep the first record.

    On a stream the watermark set by ``with_event_time`` bounds how long a key
    is remembered.  On a stored table the first row in ``order``, which has to be
    given, is kept; the other columns follow it, so equal rows are the only ties.
    Made for keys that rarely repeat: one shuffle of the rows by key, one sort.
    For a key with very many rows use ``first_per_key``, which folds them first.
    """
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark(list(keys))
    if order is None:
        raise ValueError("a stored table needs an order")
    sortable = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    rest = [c for c in sortable if c not in (*keys, *order)]
    # A first row has none before it; asked for by its rank, Spark would sort all rows before the shuffle, too.
    before = F.lag(F.lit(True)).over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn("_before", before).filter("_before IS NULL").drop("_before")


def first_of_day(
    df: DataFrame, keys: Sequence[str], ts: str, day: str | None = None, tz: str | None = None,
) -> DataFrame:
    """One row per key and calendar day: ``keys``, ``cur_date`` and the first ``ts``.

    ``day`` names a date column to use instead of the day of ``ts``.  Keys,
    date and time are all the daily counters need, so nothing wider is shuffled.
    A row with a null key is nobody's and is left out.
    """
    cur = F.col(day) if day else day_of(ts, tz)
    return df.dropna(subset=list(keys)).groupBy(*keys, cur.alias("cur_date")).agg(F.min(ts).alias(ts))


def flag_first_of_day(
    df: DataFrame, key: str, ts: str, tie: Sequence[str], flag: str = "uv", tz: str | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Keep every row and add ``flag``: 1 on the first row of a key's day, else 0.

    ``tie`` are columns that tell rows at the same instant apart; rows that are equal in
    them as well are flagged alike.  The first rows are found by aggregation and joined
    back, instead of ranking each key's rows in one sorted group: AQE can split a join
    partition that one key overfills, but not a window partition.  Rows without a
    key get 0, and are spread so that they do not meet.  ``known`` are keys and days
    (``_key`` as text, ``_day``) that had their first row before.
    """
    day = day_of(ts, tz)
    firsts = df.filter(F.col(key).isNotNull()).groupBy(
        F.col(key).cast("string").alias("_key"), day.alias("_day")
    ).agg(F.min(F.struct(ts, *tie)).alias("_first"))
    if known is not None:
        firsts = firsts.join(known, ["_key", "_day"], "left_anti")
    rows = df.withColumn("_day_of_row", day).withColumn("_join", spread_null_keys(F.col(key), ts, *tie))
    joined = rows.join(
        firsts,
        (rows["_join"] == firsts["_key"]) & (rows["_day_of_row"] == firsts["_day"]),
        "left",
    )
    is_first = F.struct(ts, *tie) == F.col("_first")
    return joined.withColumn(
        flag, F.when(is_first, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    ).drop("_key", "_day", "_first", "_day_of_row", "_join")


def login_first_of_day(
    df: DataFrame, key: str, ts: str, back_days: int = 7, tz: str | None = None, history: DataFrame | None = None,
) -> DataFrame:
    """First login per user and day with ``uu`` and ``back``.

    ``back`` is 1 when the user's previous login day lies ``back_days`` or more
    days back.  The ordered step sees one row per user and day.  ``history`` has each
    user's last login day before these rows as ``cur_date``.
    """
    days = first_of_day(df, [key], ts, tz=tz)
    previous = F.lag("cur_date").over(Window.partitionBy(key).orderBy("cur_date"))
    days = days.withColumn("_previous", previous)
    if history is not None:
        before = history.select(F.col(key).alias("_user"), F.col("cur_date").alias("_last"))
        days = days.join(before, days[key] == before["_user"], "left").withColumn("_previous", F.coalesce("_previous", "_last"))
    back = F.when(F.datediff("cur_date", "_previous") >= back_days, F.lit(1)).otherwise(F.lit(0))
    return days.select(key, "cur_date", ts, F.lit(1).cast("bigint").alias("uu"), back.cast("bigint").alias("back"))


def order_first_flags(
    df: DataFrame, key: str, ts: str, day: str | None = None, history: DataFrame | None = None,
) -> DataFrame:
    """First order per user and day; ``is_new`` is 1 on the user's very first one.

    ``day`` names the calendar-date column when it does not come from ``ts``.
    ``history`` has the users who ordered before these rows.
    """
    days = first_of_day(df, [key], ts, day)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(ts, "cur_date"))
    new = rank == 1
    if history is not None:
        before = history.select(F.col(key).alias("_user")).distinct()
        days = days.join(before, days[key] == before["_user"], "left")
        new = new & F.col("_user").isNull()
    flagged = days.withColumn("is_new", F.when(new, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return flagged.select(key, "cur_date", ts, "is_new")
