"""Summary-layer jobs on stored facts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas as S
from tidemark.functions.times import date_part, event_time
from tidemark.operators import keywords, summaries, traffic
from tidemark.operators.firsts import dedup_within
from tidemark.operators.joins import enrich, enrich_sku


def search_texts(page_log: DataFrame) -> DataFrame:
    """Search texts out of page records with an open ``page`` map."""
    page = F.col("page")
    flat = page_log.select(
        page["item"].alias("item"), page["item_type"].alias("item_type"),
        page["last_page_id"].alias("last_page_id"), "rt",
    )
    return traffic.search_pages(flat).select("item", "rt")


def keyword_summary(
    page_log: DataFrame, tokenizer: Callable[[str], Iterable[str]] | None = None,
) -> DataFrame:
    return summaries.keyword_window(
        keywords.explode_words(search_texts(page_log), "item", "word", tokenizer)
    )


def traffic_summary(views: DataFrame, tz: str | None = None) -> DataFrame:
    return summaries.traffic_window(views, tz=tz)


def home_detail_summary(views: DataFrame, tz: str | None = None) -> DataFrame:
    return summaries.home_detail_window(traffic.pages_of(views, ["home", "good_detail"]), tz=tz)


def login_summary(views: DataFrame, back_days: int = 7, tz: str | None = None) -> DataFrame:
    return summaries.login_window(traffic.login_pages(views), back_days=back_days, tz=tz)


def changed_time(df: DataFrame, name: str = "rt") -> DataFrame:
    """Event time of a record that may have been changed: last change, else creation."""
    return df.withColumn(name, F.coalesce(event_time("operate_time"), event_time("create_time")))


def cart_summary(carts: DataFrame, tz: str | None = None) -> DataFrame:
    return summaries.cart_uu_window(changed_time(carts), tz=tz)


def order_user_summary(lines: DataFrame) -> DataFrame:
    """Event time is the last change, the calendar day that of creation."""
    dated = changed_time(lines).withColumn("_day", date_part("create_time").try_cast("date"))
    return summaries.order_user_window(dated, day="_day")


def sku_summary(
    lines: DataFrame, flat_sku: DataFrame, order: list[str] = ("rt",),
) -> DataFrame:
    """Only the summed rows are enriched, not every order line."""
    timed = lines.withColumn("rt", event_time("create_time"))
    unique = dedup_within(timed, ["order_detail_id"], list(order))
    return enrich_sku(summaries.sku_order_window(unique), flat_sku).select(*S.SKU_SUMMARY)


def province_summary(
    lines: DataFrame, provinces: DataFrame, order: list[str] = ("rt",),
) -> DataFrame:
    """``provinces`` has ``id`` and ``name``."""
    timed = lines.withColumn("rt", event_time("create_time"))
    unique = dedup_within(timed, ["order_detail_id"], list(order))
    summed = summaries.province_order_window(unique)
    return enrich(
        summed, provinces, "province_id", {"province_name": "name"}, "id"
    ).select(*S.PROVINCE_SUMMARY)
