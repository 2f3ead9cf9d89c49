"""Windowed summaries, one row per window and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas as S
from tidemark.functions.numbers import coalesce0, money
from tidemark.functions.times import DATE, day_of
from tidemark.operators.firsts import first_of_day, login_first_of_day, order_first_flags
from tidemark.operators.traffic import traffic_measures
from tidemark.operators.windows import first_by, tumble, window_bounds

TRAFFIC_KEYS = ["is_new", "ar", "ch", "vc"]


def _dated(df: DataFrame) -> DataFrame:
    """The date column as text; it stays a date while aggregating."""
    return df.withColumn("cur_date", F.date_format("cur_date", DATE))


def keyword_window(words: DataFrame, ts: str = "rt", size: str = "10 minutes") -> DataFrame:
    """How often each word was searched per window."""
    counted = tumble(words, ts, size, ["word"], [F.count("*").alias("keyword_count")])
    return (
        window_bounds(counted, cur_date=True).withColumnRenamed("word", "keyword")
        .select(*S.KEYWORD_SUMMARY)
    )


def traffic_parts(views: DataFrame, firsts: DataFrame, ts: str = "rt") -> DataFrame:
    """Rows to be summed for the traffic summary: all views, plus one row per daily first.

    The visitor count is carried by rows of its own, so the views need not be
    matched with the firsts one by one.
    """
    rows = traffic_measures(views).select(
        ts, *TRAFFIC_KEYS, F.lit(0).cast("bigint").alias("uv"), "sv", "pv",
        F.col("during_time").alias("dur"),
    )
    zero = F.lit(0).cast("bigint")
    extra = firsts.select(
        ts, *TRAFFIC_KEYS, F.lit(1).cast("bigint").alias("uv"), zero.alias("sv"),
        zero.alias("pv"), F.lit(None).cast("bigint").alias("dur"),
    )
    return rows.unionByName(extra)


def traffic_totals(parts: DataFrame, ts: str = "rt", size: str = "10 seconds") -> DataFrame:
    """Sum the traffic parts per window, channel, area, version and visitor kind."""
    summed = tumble(parts, ts, size, TRAFFIC_KEYS, [
        F.sum("uv").alias("uv_ct"), F.sum("sv").alias("sv_ct"),
        F.sum("pv").alias("pv_ct"), F.sum("dur").alias("dur_sum"),
    ])
    return window_bounds(summed, cur_date=True).select(*S.TRAFFIC_SUMMARY)


def traffic_firsts(
    views: DataFrame, key: str = "mid", ts: str = "rt", tz: str | None = None,
) -> DataFrame:
    """Time and attributes of every visitor's first view of a day.

    A visitor's attributes hardly change, so grouping by them first leaves a few
    rows per visitor and day with nothing but a timestamp to keep; the first of
    those is picked afterwards.  Equal times are decided by the attributes.
    """
    known = views.filter(F.col(key).isNotNull())
    few = known.groupBy(key, day_of(ts, tz).alias("_day"), *TRAFFIC_KEYS).agg(F.min(ts).alias(ts))
    row = F.struct(ts, *TRAFFIC_KEYS)
    return few.groupBy(key, "_day").agg(F.min(row).alias("_first")).select("_first.*")


def traffic_window(
    views: DataFrame, key: str = "mid", ts: str = "rt", size: str = "10 seconds",
    tz: str | None = None,
) -> DataFrame:
    """Visitors, sessions, views and stay per window and view attributes."""
    return traffic_totals(traffic_parts(views, traffic_firsts(views, key, ts, tz), ts), ts, size)


def home_detail_totals(firsts: DataFrame, ts: str = "rt", size: str = "10 seconds") -> DataFrame:
    def of(page: str):
        return F.sum(F.when(F.col("page_id") == page, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

    summed = tumble(firsts, ts, size, [], [
        of("home").alias("home_uv_ct"), of("good_detail").alias("good_detail_uv_ct"),
    ])
    return window_bounds(summed, cur_date=True).select(*S.HOME_DETAIL_SUMMARY)


def home_detail_window(
    views: DataFrame, key: str = "mid", ts: str = "rt", size: str = "10 seconds",
    tz: str | None = None,
) -> DataFrame:
    """Visitors of the home page and of product pages per window."""
    return home_detail_totals(first_of_day(views, [key, "page_id"], ts, tz=tz), ts, size)


def login_totals(firsts: DataFrame, ts: str = "rt", size: str = "10 seconds") -> DataFrame:
    summed = tumble(firsts, ts, size, [], [
        F.sum("back").alias("back_ct"), F.sum("uu").alias("uu_ct"),
    ])
    return window_bounds(summed, cur_date=True).select(*S.LOGIN_SUMMARY)


def login_window(
    logins: DataFrame, key: str = "uid", ts: str = "rt", back_days: int = 7,
    size: str = "10 seconds", tz: str | None = None,
) -> DataFrame:
    """Users logging in per window, and those among them who had been away."""
    return login_totals(login_first_of_day(logins, key, ts, back_days, tz), ts, size)


def cart_uu_totals(firsts: DataFrame, ts: str = "rt", size: str = "10 seconds") -> DataFrame:
    summed = tumble(firsts, ts, size, [], [F.count("*").alias("cart_add_uu_ct")])
    return window_bounds(summed, cur_date=True).select(*S.CART_SUMMARY)


def cart_uu_window(
    carts: DataFrame, key: str = "user_id", ts: str = "rt", size: str = "10 seconds",
    tz: str | None = None,
) -> DataFrame:
    """Users who put something in the cart per window, each counted once a day."""
    return cart_uu_totals(first_of_day(carts, [key], ts, tz=tz), ts, size)


def order_user_totals(firsts: DataFrame, ts: str = "rt", size: str = "2 seconds") -> DataFrame:
    summed = tumble(firsts, ts, size, [], [
        first_by("cur_date", [ts, "cur_date"]).alias("cur_date"),
        F.count("*").alias("order_unique_user_count"),
        F.sum("is_new").alias("order_new_user_count"),
    ])
    return _dated(window_bounds(summed)).select(*S.ORDER_SUMMARY)


def order_user_window(
    orders: DataFrame, key: str = "user_id", ts: str = "rt", day: str | None = None,
    size: str = "2 seconds",
) -> DataFrame:
    """Ordering users per window, each counted once a day, and first-time buyers.

    ``day`` names the date column that decides the day when it is not the day of
    the event time (the order's creation against its last change).
    """
    return order_user_totals(order_first_flags(orders, key, ts, day), ts, size)


def sku_amounts(lines: DataFrame, ts: str = "rt") -> DataFrame:
    """Order lines reduced to what the sku summary adds up."""
    return lines.select(
        "sku_id", "sku_name", ts,
        money("original_total_amount").alias("original"),
        coalesce0("split_activity_amount").alias("activity"),
        coalesce0("split_coupon_amount").alias("coupon"),
        money("split_total_amount").alias("amount"),
    )


def sku_order_window(lines: DataFrame, ts: str = "rt", size: str = "10 seconds") -> DataFrame:
    """Original, activity, coupon and final amount per window and sku.

    The name is that of the window's first line.  One aggregate by window and sku
    gives name and sums: lines are folded per task and shuffled once.
    """
    sums = {
        "original_amount": "original", "activity_amount": "activity",
        "coupon_amount": "coupon", "order_amount": "amount",
    }
    rows = sku_amounts(lines, ts)
    totals = [F.sum(c).alias(name) for name, c in sums.items()]
    name = first_by("sku_name", [ts, "sku_name"]).alias("sku_name")
    summed = tumble(rows, ts, size, ["sku_id"], [name, *totals])
    return window_bounds(summed, cur_date=True)


def province_order_window(
    lines: DataFrame, ts: str = "rt", size: str = "3 hours", day: str | None = None,
    tz: str | None = None,
) -> DataFrame:
    """Distinct orders and amount per window and province.

    Windows start at multiples of their size since the epoch, so in some zones
    one covers two dates; it gets the date of its first line.  On streams use
    ``province_parts``, which needs no set of order ids.
    """
    rows = province_amounts(lines, ts, day, tz)
    summed = tumble(rows, ts, size, ["province_id"], [
        first_by("_day", [ts, "_day"]).alias("cur_date"),
        F.count_distinct("order_id").alias("order_count"),
        F.sum("amount").alias("order_amount"),
    ])
    return _dated(window_bounds(summed))


def province_amounts(
    lines: DataFrame, ts: str = "rt", day: str | None = None, tz: str | None = None,
) -> DataFrame:
    """Order lines reduced to what the province summary needs."""
    return lines.select(
        "province_id", "order_id", ts, (F.col(day) if day else day_of(ts, tz)).alias("_day"),
        money("split_total_amount").alias("amount"),
    )


def province_parts(rows: DataFrame, firsts: DataFrame, ts: str = "rt") -> DataFrame:
    """Rows to be summed: all amounts, plus one row per first line of an order in a window.

    The order count is carried by rows of its own, so no window keeps its order ids.
    """
    zero = F.lit(0).cast("bigint")
    counted = firsts.select(
        "province_id", ts, "_day", F.lit(None).cast(rows.schema["amount"].dataType).alias("amount"),
        F.lit(1).cast("bigint").alias("orders"))
    return rows.select("province_id", ts, "_day", "amount", zero.alias("orders")).unionByName(counted)


def province_totals(parts: DataFrame, ts: str = "rt", size: str = "3 hours") -> DataFrame:
    summed = tumble(parts, ts, size, ["province_id"], [
        first_by("_day", [ts, "_day"]).alias("cur_date"),
        F.sum("orders").alias("order_count"),
        F.sum("amount").alias("order_amount"),
    ])
    return _dated(window_bounds(summed))
