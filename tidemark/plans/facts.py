"""Detail-layer jobs: facts out of the application log and the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas as S
from tidemark.operators import cdc, facts, traffic
from tidemark.operators.routing import dwd_route, route_by_topic
from tidemark.session import shuffles_dropped, written
from tidemark.streaming.joins import order_parts

LINES_A_BUCKET = 150_000


def visitor_log(raw: DataFrame, tz: str | None = None) -> DataFrame:
    """Stored application log as texts beside their visitor, time and repaired flag."""
    return traffic.repair_log(traffic.log_heads(raw), tz)


def log_topics(raw: DataFrame, tz: str | None = None, ordered: bool = False) -> DataFrame:
    """Stored application log as ``(topic, value)`` rows of the log topics, bad records included; ``ordered``: keys in order."""
    return traffic.split_log_records(visitor_log(raw, tz), ordered=ordered)


def comment_facts(log: DataFrame, dictionary: DataFrame, database: str | None = None) -> DataFrame:
    return facts.comment_fact(cdc.comment_info(log, database), dictionary)


def cart_facts(log: DataFrame, database: str | None = None) -> DataFrame:
    return cdc.cart_add(log, database)


def order_facts(log: DataFrame, database: str | None = None) -> DataFrame:
    """Wide order details from a change log.

    The log is read four times, each time narrowed to one table; keep it
    partitioned by ``table`` so that each reads its own part.  Lines with their reductions are
    written before they meet their orders, so the disk never holds both shuffles of the lines.
    """
    lines = facts.reduced_lines(
        cdc.order_detail(log, database), cdc.order_detail_activity(log, database), cdc.order_detail_coupon(log, database))
    with shuffles_dropped(log.sparkSession):
        lines = written(lines, "reduced-lines", compression="zstd")
    return facts.with_orders(lines, cdc.order_info(log, database))


def buckets_for(lines: int, least: int = 8) -> int:
    """Buckets of ``store_order_parts`` for so many order lines: some 100 MB of parts each, whatever their number."""
    return max(least, -(-lines // LINES_A_BUCKET))


def store_order_parts(log: DataFrame, name: str, path: str, buckets: int = 200, database: str | None = None) -> DataFrame:
    """The parts of orders as catalog table ``name``, bucketed by order: a join of parts by their order moves nothing.

    Takes what the change log inserts; parts without an order's id are left to ``order_facts``.  Written once for
    all jobs on top; take as many buckets as an order join of all data would have partitions (``buckets_for``).
    Each bucket is written by one task, so there are as many files of a kind as buckets.
    """
    parts = order_parts(log, database).filter("order_id IS NOT NULL")
    (parts.repartition(buckets, "order_id").write.option("path", path).partitionBy("kind").bucketBy(buckets, "order_id").sortBy("order_id")
     .mode("overwrite").saveAsTable(name))
    return log.sparkSession.table(name)


def order_facts_in_place(parts: DataFrame) -> DataFrame:
    """``order_facts`` from ``store_order_parts``: three joins, bucket by bucket, without an exchange."""
    def of(kind: str, columns: list[str], *more: str) -> DataFrame:
        # Only what is asked for is taken out of the stored record.
        data = F.from_json("row", ", ".join(f"`{c}` STRING" for c in columns))
        return parts.filter(F.col("kind") == kind).select(F.col("order_id").alias("_order"), *more, data.alias("_r")).select(
            "_order", *more, *[F.col(f"_r.`{c}`").alias(c) for c in columns])

    orders = of("order_info", S.ORDER_INFO, "rt").drop("id").withColumnRenamed("_order", "order_id")
    lines = of("order_detail", ["id", *S.DETAIL_OF_LINE]).withColumnRenamed("id", "order_detail_id")
    detail = orders.join(lines, orders["order_id"] == lines["_order"]).drop("_order")
    for name, columns in (("activity", S.DETAIL_OF_ACTIVITY), ("coupon", S.DETAIL_OF_COUPON)):
        extra = of(f"order_detail_{name}", ["id", "order_detail_id", *columns]).withColumnsRenamed(
            {"id": f"order_detail_{name}_id", "order_detail_id": "_line"})
        # Equality of lines as a range: as a second join key it would ask for a partitioning by both.
        same_line = detail["order_detail_id"].between(extra["_line"], extra["_line"])
        detail = detail.join(extra, (detail["order_id"] == extra["_order"]) & same_line, "left").drop("_order", "_line")
    return detail.select(*S.order_detail_columns("rt"))


def cancel_facts(log: DataFrame, database: str | None = None) -> DataFrame:
    """Wide details of cancelled orders from a change log; their lines are written before they meet activity and coupon, as above."""
    lines = facts.cancelled_lines(cdc.order_cancel(log, database), cdc.order_detail(log, database))
    with shuffles_dropped(log.sparkSession):
        lines = written(lines, "cancelled-lines", compression="zstd")
    return facts.with_reductions(lines, cdc.order_detail_activity(log, database), cdc.order_detail_coupon(log, database))


def pay_facts(
    log: DataFrame, order_detail: DataFrame, dictionary: DataFrame,
    database: str | None = None, status: str | None = None,
) -> DataFrame:
    return facts.pay_detail(cdc.payment_info(log, database, status), order_detail, dictionary)


def routed_facts(log: DataFrame, config: DataFrame, database: str | None = None) -> DataFrame:
    """Facts served by configuration alone, as ``(topic, value)`` rows."""
    return route_by_topic(dwd_route(log, config, database))
