"""Spreading keys over partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def spread(df: DataFrame, keys: list[str], slices: int, order: list[str]) -> DataFrame:
    """Repartition for writing so that one hot key is written by ``slices`` tasks.

    The slice comes from a hash of ``order`` (columns that differ within a key),
    so a re-run task sends each row to the same place again.
    """
    piece = F.pmod(F.xxhash64(*order), F.lit(slices))
    return df.repartition(*[F.col(k) for k in keys], piece)
