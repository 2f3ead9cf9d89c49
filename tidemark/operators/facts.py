"""Wide order facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas as S
from tidemark.operators.joins import interval_join, lookup_join


def _lines(od: DataFrame) -> DataFrame:
    return od.select(
        F.col("id").alias("order_detail_id"), F.col("order_id").alias("_order_id"),
        *S.DETAIL_OF_LINE,
    )


def _reductions(lines: DataFrame, oa: DataFrame, oc: DataFrame) -> DataFrame:
    """Order lines with the activity and the coupon used on them, if any.

    Both joins are on the line key, so the lines are shuffled once for the two.
    """
    activity = oa.select(
        F.col("order_detail_id").alias("_oa_line"),
        F.col("id").alias("order_detail_activity_id"), *S.DETAIL_OF_ACTIVITY,
    )
    coupon = oc.select(
        F.col("order_detail_id").alias("_oc_line"),
        F.col("id").alias("order_detail_coupon_id"), *S.DETAIL_OF_COUPON,
    )
    return (
        lines.join(activity, lines["order_detail_id"] == activity["_oa_line"], "left")
        .join(coupon, lines["order_detail_id"] == coupon["_oc_line"], "left")
        .drop("_oa_line", "_oc_line")
    )


def order_detail_wide(
    oi: DataFrame, od: DataFrame, oa: DataFrame, oc: DataFrame, time: str = "rt",
) -> DataFrame:
    """Order ⋈ line ⟕ activity ⟕ coupon, 41 columns, one row per order line and match.

    Nearly every line has its order, so the narrow lines meet activity and coupon
    first and the 24 order columns are moved only once, by the order key.
    """
    return with_orders(reduced_lines(od, oa, oc), oi, time)


def reduced_lines(od: DataFrame, oa: DataFrame, oc: DataFrame) -> DataFrame:
    """Line ⟕ activity ⟕ coupon, the first half of ``order_detail_wide``."""
    return _reductions(_lines(od), oa, oc)


def with_orders(lines: DataFrame, oi: DataFrame, time: str = "rt") -> DataFrame:
    """The second half: ``reduced_lines`` with their orders."""
    orders = oi.withColumnRenamed("id", "order_id")
    return orders.join(lines, orders["order_id"] == lines["_order_id"], "inner").select(
        *S.order_detail_columns(time)
    )


def cancel_detail_wide(
    cancelled: DataFrame, od: DataFrame, oa: DataFrame, oc: DataFrame, time: str = "pt",
) -> DataFrame:
    """The same shape for cancelled orders.

    Few orders are cancelled, so their lines are cut out first and only those
    meet activity and coupon.
    """
    return with_reductions(cancelled_lines(cancelled, od), oa, oc, time)


def cancelled_lines(cancelled: DataFrame, od: DataFrame) -> DataFrame:
    """Cancelled order ⋈ line, the first half of ``cancel_detail_wide``."""
    orders = cancelled.withColumnRenamed("id", "order_id")
    lines = _lines(od)
    return orders.join(lines, orders["order_id"] == lines["_order_id"], "inner")


def with_reductions(lines: DataFrame, oa: DataFrame, oc: DataFrame, time: str = "pt") -> DataFrame:
    """The second half: ``cancelled_lines`` ⟕ activity ⟕ coupon."""
    return _reductions(lines, oa, oc).select(*S.order_detail_columns(time))


def pay_detail(
    payments: DataFrame, order_detail: DataFrame, dictionary: DataFrame,
    lower: str = "-15 minutes", upper: str = "60 seconds",
) -> DataFrame:
    """Paid order lines: payment ⋈ order line near in time ⋈ payment type name."""
    pays = payments.select(
        "order_id", F.col("rt").alias("_pay_rt"),
        *[c for c in S.DETAIL_OF_PAYMENT if c != "payment_type_name"],
    )
    joined = interval_join(pays, order_detail, "order_id", "_pay_rt", "rt", lower, upper)
    named = lookup_join(
        joined, dictionary, "payment_type", {"payment_type_name": "info.dic_name"}
    )
    return named.select(*S.order_detail_columns("rt"), *S.DETAIL_OF_PAYMENT)


def comment_fact(comments: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Comments with the name of their rating; unknown ratings vanish."""
    return lookup_join(
        comments, dictionary, "appraise", {"appraise_name": "info.dic_name"}
    ).select(*S.COMMENT_FACT)
