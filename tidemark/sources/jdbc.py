"""Database snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.naming import camel_case


def read_jdbc_snapshot(
    spark: SparkSession, url: str, sql: str, camel: bool = False, **options: str,
) -> DataFrame:
    """The result of ``sql`` as typed rows, with camelCase names if asked for.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    to read a large table with several tasks.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({sql}) snapshot")
    for name, value in options.items():
        reader = reader.option(name, value)
    rows = reader.load()
    return camel_case(rows) if camel else rows
