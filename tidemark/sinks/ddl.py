"""Dimension tables created and dropped as the routing table says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table_columns(sink_columns: str, row_key: str) -> list[str]:
    """The key first, then the other configured columns."""
    listed = [c.strip() for c in sink_columns.split(",") if c.strip()]
    return [row_key] + [c for c in listed if c != row_key]


def apply_table_ddl(
    spark: SparkSession, changes: DataFrame, order: str = "ts_ms", database: str = "default",
) -> list[tuple[str, str]]:
    """Carry routing changes over to the catalog; returns what was done.

    ``d`` drops the dimension table, ``u`` drops and creates it anew, anything
    else creates it if it is not there.  The changes are a handful of rows of a
    configuration table; they are applied one after the other, in order.
    """
    done = []
    rows = changes.filter(F.col("sink_type") == "dim").orderBy(order)
    for row in rows.toLocalIterator():
        name = f"`{database}`.`{row['sink_table']}`"
        columns = ", ".join(
            f"`{c}` STRING" for c in table_columns(row["sink_columns"], row["sink_row_key"])
        )
        if row["op"] in ("d", "u"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            done.append(("drop", row["sink_table"]))
        if row["op"] != "d":
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
            done.append(("create", row["sink_table"]))
    return done
