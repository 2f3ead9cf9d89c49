"""Writing to topics and to their file twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.jsons import to_json_rows


def topic_rows(df: DataFrame, topic: Column, value: Column) -> DataFrame:
    """``(topic, value)`` rows with the caller's own topic choice and encoding."""
    return df.select(topic.alias("topic"), value.alias("value"))


def write_topic(df: DataFrame, servers: str, topic: str | None = None) -> DataStreamWriter:
    """Stream ``value`` texts to one topic, or each to the one in its ``topic`` column.

    Delivery is at least once, as everywhere with this connector.
    """
    writer = df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return writer.option("topic", topic) if topic else writer


def write_json_topic(df: DataFrame, servers: str, topic: str) -> DataStreamWriter:
    """Stream whole rows to a topic as JSON."""
    return write_topic(to_json_rows(df), servers, topic)


def write_topic_files(df: DataFrame, path: str) -> DataStreamWriter:
    """File twin of ``write_topic``: line files, one folder per ``topic`` if there is one."""
    writer = df.writeStream.format("text").option("path", path)
    return writer.partitionBy("topic") if "topic" in df.columns else writer


def append_batch(path: str, partition_by: tuple[str, ...] = ()):
    """``foreachBatch`` writer that puts each micro-batch into its own ``batch_id`` folder.

    A batch that is run again after a failure overwrites its folder, so nothing
    is written twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{path}/batch_id={batch_id}")

    return write


def debug_stream(df: DataFrame) -> DataStreamWriter:
    """Print a stream while developing."""
    return df.writeStream.format("console").option("truncate", "false")
