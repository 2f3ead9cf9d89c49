"""Reading business tables out of a database change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas as S
from tidemark.functions.jsons import parse_json, parsed
from tidemark.functions.numbers import cast_delta
from tidemark.functions.times import from_epoch


def drop_tombstones(df: DataFrame, value: str = "value") -> DataFrame:
    """Drop deletion markers: records whose value is null."""
    return df.filter(F.col(value).isNotNull())


def cdc_rows(raw: DataFrame) -> DataFrame:
    """``cdc_log`` in one table: parsed columns, and in ``_corrupt_record`` the text of a record that is none."""
    return parsed(raw, S.CDC).withColumn("rt", from_epoch("ts", "s")).withColumn("pt", F.current_timestamp())


def cdc_log(raw: DataFrame, count_as: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse change-log texts; adds event time ``rt`` and processing time ``pt``.

    Returns the parsed log and the texts that could not be parsed.
    """
    good, bad = parse_json(raw, S.CDC, count_as=count_as)
    good = good.withColumn("rt", from_epoch("ts", "s")).withColumn("pt", F.current_timestamp())
    return good, bad


def cdc_table(
    log: DataFrame, table: str, types: Sequence[str], columns: Sequence[str],
    database: str | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Changes of one table as typed columns (all text), plus the log columns in ``keep``."""
    wanted = (F.col("table") == table) & F.col("type").isin(*types)
    if database is not None:
        wanted = wanted & (F.col("database") == database)
    return log.filter(wanted).select(*[F.col("data")[c].alias(c) for c in columns], *keep)


def comment_info(log: DataFrame, database: str | None = None) -> DataFrame:
    """Comments written or changed."""
    return cdc_table(log, "comment_info", ["insert", "update"], S.COMMENT_INFO, database, ["pt"])


def cart_add(log: DataFrame, database: str | None = None) -> DataFrame:
    """Additions to the cart.

    A new cart line counts with its quantity; a changed one only when the
    quantity went up, and then with the increase.
    """
    new, old = F.col("data")["sku_num"], F.col("old")["sku_num"]
    raised = (
        (F.col("type") == "update")
        & old.isNotNull()
        & (new.try_cast("int") > old.try_cast("int"))
    )
    rows = log.filter(F.col("table") == "cart_info").filter((F.col("type") == "insert") | raised)
    if database is not None:
        rows = rows.filter(F.col("database") == database)
    quantity = F.when(F.col("type") == "insert", new).otherwise(cast_delta(new, old))
    return rows.select(
        *[
            (quantity if c == "sku_num" else F.col("data")[c]).alias(c)
            for c in S.CART_INFO
        ]
    )


def order_cancel(
    log: DataFrame, database: str | None = None, status: str = S.ORDER_CANCELLED,
) -> DataFrame:
    """Orders whose status was changed to cancelled."""
    changed = log.filter(
        F.col("old")["order_status"].isNotNull() & (F.col("data")["order_status"] == status)
    )
    return cdc_table(changed, "order_info", ["update"], S.ORDER_INFO, database, ["rt", "pt"])


def payment_info(
    log: DataFrame, database: str | None = None, status: str | None = None,
) -> DataFrame:
    """Payments entered; ``status`` narrows them to one payment status."""
    rows = cdc_table(log, "payment_info", ["insert"], S.PAYMENT_INFO, database, ["rt", "pt"])
    return rows if status is None else rows.filter(F.col("payment_status") == status)


def order_info(log: DataFrame, database: str | None = None) -> DataFrame:
    return cdc_table(log, "order_info", ["insert"], S.ORDER_INFO, database, ["rt"])


def order_detail(
    log: DataFrame, database: str | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    return cdc_table(log, "order_detail", ["insert"], S.ORDER_DETAIL, database, keep)


def order_detail_activity(
    log: DataFrame, database: str | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    return cdc_table(
        log, "order_detail_activity", ["insert"], S.ORDER_DETAIL_ACTIVITY, database, keep
    )


def order_detail_coupon(
    log: DataFrame, database: str | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    return cdc_table(
        log, "order_detail_coupon", ["insert"], S.ORDER_DETAIL_COUPON, database, keep
    )
