"""Topics as streams of texts.

``read_topic`` needs the Kafka connector package on the class path;
``read_topic_files`` reads the same records from a folder of line files, as a
stream or as a stored table.  The readers on top take either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark import schemas as S
from tidemark.functions.jsons import parse_json
from tidemark.functions.times import from_epoch
from tidemark.operators.cdc import cdc_log


def read_topic(
    spark: SparkSession, topic: str, servers: str, starting: str = "latest", **options: str,
) -> DataFrame:
    """A topic as a stream of ``value`` texts; deletion markers stay as null."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def read_topic_files(
    spark: SparkSession, path: str, stream: bool = True, files_per_trigger: int | None = None,
) -> DataFrame:
    """A folder of line files as ``value`` texts."""
    if not stream:
        return spark.read.text(path)
    reader = spark.readStream.format("text").schema("value STRING")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_json_topic(raw: DataFrame, schema: str | StructType) -> DataFrame:
    """Topic records as columns; records that do not parse are left out.

    Use ``parse_json`` instead where the bad records are wanted.
    """
    return parse_json(raw, schema)[0]


def _watermark(df: DataFrame, col: str, delay: str) -> DataFrame:
    return df.withWatermark(col, delay) if df.isStreaming else df


def read_cdc_log(raw: DataFrame, delay: str = "2 seconds", count_as: str | None = None) -> DataFrame:
    """The business database's change log with event time ``rt`` and its watermark; bad records are counted under ``count_as``."""
    return _watermark(cdc_log(raw, count_as)[0], "rt", delay)


def read_page_log(raw: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """Page records with an open ``page`` map, event time ``rt`` and its watermark."""
    rows = read_json_topic(raw, S.PAGE_LOG).withColumn("rt", from_epoch("ts"))
    return _watermark(rows, "rt", delay)


def read_order_detail(raw: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The wide order-detail fact, read back from its topic."""
    return _watermark(read_json_topic(raw, S.order_detail_schema()), "rt", delay)
