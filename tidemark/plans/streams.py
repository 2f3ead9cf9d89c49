"""The jobs on streams.

Each takes what a topic delivers and returns the stream to be written; start it
with ``run_stream``.  Sessions need the RocksDB state store where state is kept
per visitor or user.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas as S
from tidemark.functions.jsons import count_records
from tidemark.functions.times import date_part, event_time
from tidemark.operators import cdc, facts, keywords, summaries, traffic
from tidemark.operators.firsts import dedup_within
from tidemark.plans.summaries import search_texts
from tidemark.streaming.events import with_event_time
from tidemark.streaming.joins import order_parts, released_orders
from tidemark.streaming.state import (
    day_firsts_stream, login_firsts_stream, order_firsts_stream, repair_log_stream,
)

DELAY = "2 seconds"


def log_topics(raw: DataFrame, tz: str | None = None, count_as: str | None = None) -> DataFrame:
    """Application log to ``(topic, value)`` rows of the log topics, bad records included, and counted under ``count_as``."""
    rows = traffic.split_log_records(repair_log_stream(traffic.log_heads(raw), tz))
    return count_records(rows, count_as, bad=F.col("topic") == S.LOG_TOPICS["bad"]) if count_as else rows


def page_views(raw: DataFrame, delay: str = DELAY) -> DataFrame:
    """Page topic to flat page views with event time.

    Records that are none are ``traffic.page_log(raw)[1]``: a stream of its own.
    """
    return with_event_time(traffic.page_log(raw)[0], "rt", delay)


def order_facts(log: DataFrame, database: str | None = None, bound: str = "24 hours") -> DataFrame:
    """Wide order details, and parts that found no partner within ``bound``; written by ``jobs.OrderFacts``.

    The change log, with a watermark on ``rt``, is read once.
    """
    return released_orders(order_parts(log, database), bound)


def cancelled_orders(log: DataFrame, database: str | None = None) -> DataFrame:
    """Cancelled orders; ``jobs.cancel_fact_writer`` looks up their lines."""
    return cdc.order_cancel(log, database)


def pay_facts(
    log: DataFrame, order_detail: DataFrame, dictionary: DataFrame, database: str | None = None,
) -> DataFrame:
    return facts.pay_detail(cdc.payment_info(log, database), order_detail, dictionary)


def keyword_summary(
    page_log: DataFrame, tokenizer: Callable[[str], Iterable[str]] | None = None,
) -> DataFrame:
    words = keywords.explode_words(search_texts(page_log), "item", "word", tokenizer)
    return summaries.keyword_window(words)


def traffic_summary(views: DataFrame, tz: str | None = None) -> DataFrame:
    firsts = day_firsts_stream(views.select("mid", "rt", *summaries.TRAFFIC_KEYS), ["mid"], tz=tz)
    return summaries.traffic_totals(summaries.traffic_parts(views, firsts))


def home_detail_summary(views: DataFrame, tz: str | None = None) -> DataFrame:
    seen = traffic.pages_of(views, ["home", "good_detail"]).select("mid", "page_id", "rt")
    return summaries.home_detail_totals(day_firsts_stream(seen, ["mid", "page_id"], tz=tz))


def login_summary(views: DataFrame, back_days: int = 7, tz: str | None = None) -> DataFrame:
    logins = traffic.login_pages(views)
    return summaries.login_totals(login_firsts_stream(logins, back_days=back_days, tz=tz))


def _changed(df: DataFrame, delay: str) -> DataFrame:
    last = F.coalesce(event_time("operate_time"), event_time("create_time"))
    return with_event_time(df, last, delay)


def cart_summary(carts: DataFrame, delay: str = DELAY, tz: str | None = None) -> DataFrame:
    timed = _changed(carts, delay).select("user_id", "rt")
    return summaries.cart_uu_totals(day_firsts_stream(timed, ["user_id"], tz=tz))


def order_user_summary(lines: DataFrame, delay: str = DELAY) -> DataFrame:
    timed = _changed(lines, delay).withColumn("_date", date_part("create_time").try_cast("date"))
    return summaries.order_user_totals(order_firsts_stream(timed, day="_date"))


def unique_lines(lines: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Order lines without the repeats that left joins upstream produce."""
    return dedup_within(with_event_time(lines, event_time("create_time"), delay), ["order_detail_id"])


def sku_summary(lines: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Sums by sku; ``jobs.sku_summary_writer`` adds the names of the moment."""
    return summaries.sku_order_window(unique_lines(lines, delay))


def province_summary(lines: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Sums by province; ``jobs.province_summary_writer`` adds the names of the moment."""
    rows = summaries.province_amounts(unique_lines(lines, delay))
    # The first line of an order in a window of its province; remembered until the day is over.
    marks = rows.select(
        F.coalesce("province_id", F.lit("")).alias("_province"), "province_id", "order_id", F.col("_day").alias("_date"), "rt",
        F.unix_timestamp(F.window("rt", "3 hours").start).alias("_start"))
    firsts = day_firsts_stream(marks, ["_province", "order_id", "_start"]).withColumnRenamed("_date", "_day")
    return summaries.province_totals(summaries.province_parts(rows, firsts))
