"""Event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_event_time(df: DataFrame, time: Column | str, delay: str = "2 seconds", name: str = "rt") -> DataFrame:
    """Add the event time as column ``name``, with a watermark if ``df`` is a stream.

    ``delay`` is how far records may come out of order; later ones are dropped by
    the operators that keep state.  Zone-less times become instants.
    """
    column = F.col(time) if isinstance(time, str) else time
    timed = df.withColumn(name, column.cast("timestamp"))
    return timed.withWatermark(name, delay) if df.isStreaming else timed
