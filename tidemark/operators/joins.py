"""Joins: lookup, enrichment, interval join.

Which side is broadcast is left to Spark: its byte threshold and, at run time, AQE
decide from real sizes.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def lookup_join(
    df: DataFrame, dim: DataFrame, key: str, values: Mapping[str, Column | str],
    dim_key: str = "rowkey",
) -> DataFrame:
    """Inner lookup: add ``values`` from the dimension row under ``key``.

    Rows without a match vanish.  ``values`` maps output name to a dimension
    column or expression, e.g. ``{"appraise_name": "info.dic_name"}``.
    """
    return _attach(df, dim, key, values, dim_key, "inner")


def enrich(
    df: DataFrame, dim: DataFrame, key: str, values: Mapping[str, Column | str],
    dim_key: str = "rowkey",
) -> DataFrame:
    """Left lookup: rows without a match keep null in the added columns."""
    return _attach(df, dim, key, values, dim_key, "left")


def _attach(
    df: DataFrame, dim: DataFrame, key: str, values: Mapping[str, Column | str],
    dim_key: str, how: str,
) -> DataFrame:
    picked = dim.select(
        F.col(dim_key).alias("_dim_key"),
        *[(F.col(v) if isinstance(v, str) else v).alias(name) for name, v in values.items()],
    )
    kept = df.drop(*values)
    return kept.join(picked, kept[key] == picked["_dim_key"], how).drop("_dim_key")


def flatten_sku(
    sku: DataFrame, spu: DataFrame, trademark: DataFrame,
    category3: DataFrame, category2: DataFrame, category1: DataFrame,
) -> DataFrame:
    """One row per sku with the names of every level above it.

    The five upper hops are joined once, sku by sku, so a fact needs a single
    join instead of six.
    """
    flat = sku.select(
        F.col("id").alias("sku_id"), "spu_id", F.col("tm_id").alias("trademark_id"),
        "category3_id",
    )
    flat = enrich(flat, spu, "spu_id", {"spu_name": "spu_name"}, "id")
    flat = enrich(flat, trademark, "trademark_id", {"trademark_name": "tm_name"}, "id")
    flat = enrich(
        flat, category3, "category3_id",
        {"category3_name": "name", "category2_id": "category2_id"}, "id",
    )
    flat = enrich(
        flat, category2, "category2_id",
        {"category2_name": "name", "category1_id": "category1_id"}, "id",
    )
    return enrich(flat, category1, "category1_id", {"category1_name": "name"}, "id")


SKU_ATTRIBUTES = [
    "spu_id", "spu_name", "trademark_id", "trademark_name", "category3_id", "category3_name",
    "category2_id", "category2_name", "category1_id", "category1_name",
]


# Column of the flat table that a row of a level is found by.
SKU_LEVELS = {
    "sku": "sku_id", "spu": "spu_id", "trademark": "trademark_id", "category3": "category3_id",
    "category2": "category2_id", "category1": "category1_id",
}


def skus_under(flat_sku: DataFrame, changed: dict[str, DataFrame]) -> DataFrame:
    """(sku_id) of the skus that a change can touch: ``changed`` gives the ``id`` of changed rows by level."""
    found = []
    for level, rows in changed.items():
        ids = rows.select(F.col("id").alias("_id")).distinct()
        if level == "sku":  # also those that are not there yet
            found.append(ids.select(F.col("_id").alias("sku_id")))
        else:
            found.append(flat_sku.join(ids, flat_sku[SKU_LEVELS[level]] == ids["_id"], "left_semi").select("sku_id"))
    return functools.reduce(DataFrame.union, found).distinct()


def enrich_sku(df: DataFrame, flat_sku: DataFrame, key: str = "sku_id") -> DataFrame:
    """Add the whole sku hierarchy from a ``flatten_sku`` table."""
    return enrich(df, flat_sku, key, {c: c for c in SKU_ATTRIBUTES}, "sku_id")


def seconds(span: str) -> int:
    """``"15 minutes"`` as 900; a leading minus is kept."""
    amount, unit = span.split()
    per = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(amount) * per


def interval_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] | str,
    left_time: str, right_time: str, lower: str, upper: str,
) -> DataFrame:
    """Inner join of rows with equal keys whose times lie close together.

    A pair is kept when ``left_time + lower <= right_time <= left_time + upper``.
    ``right`` keeps its own columns except the key columns.

    Stored tables are cut into time slices as long as the interval: a left row
    goes to the one or two slices its interval touches, a right row to its own,
    and the join is on key and slice.  So a key with very many rows is spread
    over its slices, and only neighbours in time are ever compared.  Streams
    join on key and time range, which is what lets Spark drop old state.
    """
    on = [on] if isinstance(on, str) else list(on)
    lo, hi = seconds(lower), seconds(upper)
    if hi < lo:
        raise ValueError("upper bound lies before lower bound")
    theirs = [f"_right_{k}" for k in on]
    right = right.withColumnsRenamed(dict(zip(on, theirs)))
    if not left.isStreaming and not right.isStreaming:
        left = left.withColumn(left_time, F.col(left_time).cast("timestamp"))
        right = right.withColumn(right_time, F.col(right_time).cast("timestamp"))
        width = max(hi - lo, 1)
        left = left.withColumn(
            "_slice",
            F.explode(F.sequence(_slice(left_time, lo, width), _slice(left_time, hi, width))),
        )
        right = right.withColumn("_right_slice", _slice(right_time, 0, width))
        on, theirs = [*on, "_slice"], [*theirs, "_right_slice"]
    near = right[right_time].between(
        left[left_time] + F.expr(f"interval '{lo}' second"),
        left[left_time] + F.expr(f"interval '{hi}' second"),
    )
    equal = [left[k] == right[t] for k, t in zip(on, theirs)]
    return left.join(right, [*equal, near], "inner").drop("_slice", *theirs)


def _slice(time: str, shift: int, width: int) -> Column:
    """Number of the ``width``-second slice that ``time`` plus ``shift`` falls into."""
    micros = F.unix_micros(time) + shift * 1_000_000
    span = F.lit(width * 1_000_000)
    return F.call_function("div", micros - F.pmod(micros, span), span)
