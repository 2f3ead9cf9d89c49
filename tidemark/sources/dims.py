"""Dimension tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dim_table(df: DataFrame, key: str, attributes: dict[str, str | Column] | None = None) -> DataFrame:
    """A keyed snapshot as ``(rowkey, info)``: the key as text, the rest one record of texts.

    Lookups join on ``rowkey``; a key that is not there gives no row instead of
    an empty record.
    """
    attributes = attributes or {c: c for c in df.columns if c != key}
    info = F.struct(*[
        (F.col(c) if isinstance(c, str) else c).cast("string").alias(name)
        for name, c in attributes.items()
    ])
    return df.select(F.col(key).cast("string").alias("rowkey"), info.alias("info"))


def dictionary(df: DataFrame, code: str, name: str) -> DataFrame:
    """A code table as ``(rowkey, info.dic_name)``."""
    return dim_table(df, code, {"dic_name": name})
