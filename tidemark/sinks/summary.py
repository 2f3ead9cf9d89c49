"""Summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_summary(
    path: str, url: str | None = None, table: str | None = None, batch_column: str | None = None, **options: str,
):
    """``foreachBatch`` writer for window summaries.

    With ``url`` and ``table`` rows are appended over JDBC.  A batch that comes again is
    appended again there: give a ``batch_column``, which gets the batch id, and a unique key
    with it, or let readers take one batch of each window.  Otherwise rows are
    written as JSON lines under ``path``, by ``cur_date``; the batch id is part of
    the path, so a repeated batch replaces its own files.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if url:
            rows = batch.withColumn(batch_column, F.lit(batch_id)) if batch_column else batch
            writer = rows.write.format("jdbc").option("url", url).option("dbtable", table)
            for name, value in options.items():
                writer = writer.option(name, value)
            writer.mode("append").save()
            return
        target = f"{path}/batch_id={batch_id}"
        batch.withColumn("date", F.col("cur_date")).write.mode("overwrite").partitionBy(
            "date"
        ).json(target)

    return write
