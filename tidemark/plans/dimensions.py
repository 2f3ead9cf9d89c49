"""Dimension upkeep driven by the routing table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.changes import map_columns, scd1_merge
from tidemark.operators.routing import dim_route


def routed_changes(log: DataFrame, config: DataFrame, database: str | None = None) -> DataFrame:
    """Dimension changes: target table, key, pruned data, and whether it is a delete."""
    rows = dim_route(log, config, database)
    return rows.select(
        "sink_table", "family", "sink_extend",
        F.col("data")[F.col("row_key_column")].alias("rowkey"),
        "data", (F.col("type") == "delete").alias("deleted"), "ts", "xid", "xoffset",
    ).filter(F.col("rowkey").isNotNull())


ORDER = ("ts", "xid", "xoffset")


def dimension_after(
    changes: DataFrame, table: str, columns: Sequence[str],
    snapshot: DataFrame | None = None, order: Sequence[str] = ORDER,
) -> DataFrame:
    """One dimension table after its routed changes."""
    mine = map_columns(changes.filter(F.col("sink_table") == table), columns)
    return scd1_merge(mine, "rowkey", columns, order, F.col("deleted"), snapshot)
