"""Tumbling event-time windows, shared by stored tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.times import DATE, DATETIME


def tumble(
    df: DataFrame, ts: str, size: str, keys: Sequence[str | Column] = (),
    aggs: Sequence[Column] = (), offset: str | None = None,
) -> DataFrame:
    """Aggregate per tumbling window of ``size``, and per ``keys`` if any.

    Without keys the window itself is the group: every task folds its own rows
    first, so only one row per task and window is shuffled.  ``offset`` shifts
    the windows off the epoch, e.g. ``"16 hours"`` for days of a +8 zone.
    """
    span = F.window(ts, size, size, offset) if offset else F.window(ts, size)
    return df.groupBy(span.alias("window"), *keys).agg(*aggs)


def window_bounds(df: DataFrame, cur_date: bool = False) -> DataFrame:
    """Replace ``window`` by its bounds as text: ``stt``, ``edt`` (and ``cur_date``)."""
    df = df.withColumn("stt", F.date_format("window.start", DATETIME)).withColumn(
        "edt", F.date_format("window.end", DATETIME)
    )
    if cur_date:
        df = df.withColumn("cur_date", F.date_format("window.start", DATE))
    return df.drop("window")


def first_by(col: str, order: str | Sequence[str]) -> Column:
    """Aggregate: the value of ``col`` in the row that comes first in ``order``."""
    keys = [order] if isinstance(order, str) else list(order)
    return F.min_by(col, keys[0] if len(keys) == 1 else F.struct(*keys))
