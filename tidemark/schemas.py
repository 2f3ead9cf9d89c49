"""Record shapes: topics, envelopes, wide facts and summary outputs."""

from __future__ import annotations

# --- fixed values: topic names other jobs subscribe to -----------------------
TOPIC_LOG = "topic_log"
TOPIC_DB = "topic_db"
LOG_TOPICS = {
    "page": "dwd_traffic_page",
    "error": "dwd_traffic_err",
    "display": "dwd_traffic_display",
    "start": "dwd_traffic_start",
    "action": "dwd_traffic_action",
    "bad": "dwd_traffic_bad",
}
FACT_TOPICS = {
    "comment": "dwd_interaction_comment_info",
    "cart_add": "dwd_trade_cart_add",
    "order_detail": "dwd_trade_order_detail",
    "cancel_detail": "dwd_trade_cancel_detail",
    "pay_detail": "dwd_trade_pay_detail_suc",
    "order_refund": "dwd_trade_order_refund",
    "refund_pay": "dwd_trade_refund_pay_suc",
    "user_register": "dwd_user_register",
}
# --- fixed values: codes carried in the data ---------------------------------
ORDER_CANCELLED = "1003"
NOT_ROUTED_TYPES = ("bootstrap-start", "bootstrap-complete")

# --- application log ---------------------------------------------------------
LOG = """
    common STRUCT<ar STRING, ba STRING, ch STRING, is_new STRING, md STRING,
                  mid STRING, os STRING, sid STRING, uid STRING, vc STRING>,
    page STRUCT<page_id STRING, last_page_id STRING, item STRING,
                item_type STRING, during_time BIGINT>,
    displays ARRAY<STRUCT<item STRING, item_type STRING, pos_id INT, pos_seq INT>>,
    actions ARRAY<MAP<STRING, VARIANT>>,
    start VARIANT,
    err VARIANT,
    ts BIGINT
"""
PAGE_LOG = "page MAP<STRING, STRING>, ts BIGINT"

# --- change log of the business database -------------------------------------
CDC = """
    database STRING, `table` STRING, type STRING, ts BIGINT,
    xid BIGINT, xoffset BIGINT,
    data MAP<STRING, STRING>, old MAP<STRING, STRING>
"""

# --- routing table and its change feed ---------------------------------------
TABLE_PROCESS_COLUMNS = [
    "source_table", "source_type", "sink_table", "sink_type",
    "sink_family", "sink_columns", "sink_row_key", "sink_extend",
]
TABLE_PROCESS = ", ".join(f"{c} STRING" for c in TABLE_PROCESS_COLUMNS)
CONFIG_CHANGE = (
    "op STRING, ts_ms BIGINT, "
    f"before STRUCT<{TABLE_PROCESS.replace(' STRING', ': STRING')}>, "
    f"after STRUCT<{TABLE_PROCESS.replace(' STRING', ': STRING')}>"
)

# --- columns read from the change log, per business table --------------------
ORDER_INFO = [
    "id", "consignee", "consignee_tel", "total_amount", "order_status", "user_id",
    "payment_way", "delivery_address", "order_comment", "out_trade_no", "trade_body",
    "create_time", "operate_time", "expire_time", "process_status", "tracking_no",
    "parent_order_id", "province_id", "activity_reduce_amount", "coupon_reduce_amount",
    "original_total_amount", "feight_fee", "feight_fee_reduce", "refundable_time",
]
ORDER_DETAIL = [
    "id", "order_id", "sku_id", "sku_name", "order_price", "sku_num", "create_time",
    "source_type", "source_id", "split_total_amount", "split_activity_amount",
    "split_coupon_amount", "operate_time",
]
ORDER_DETAIL_ACTIVITY = [
    "id", "order_id", "order_detail_id", "activity_id", "activity_rule_id", "sku_id",
    "create_time", "operate_time",
]
ORDER_DETAIL_COUPON = [
    "id", "order_id", "order_detail_id", "coupon_id", "coupon_use_id", "sku_id",
    "create_time", "operate_time",
]
CART_INFO = [
    "id", "user_id", "sku_id", "cart_price", "sku_num", "sku_name", "is_checked",
    "create_time", "operate_time", "is_ordered", "order_time", "source_type", "source_id",
]
COMMENT_INFO = [
    "id", "user_id", "nick_name", "sku_id", "spu_id", "order_id", "appraise",
    "comment_txt", "create_time", "operate_time",
]
PAYMENT_INFO = [
    "id", "out_trade_no", "order_id", "user_id", "payment_type", "trade_no",
    "total_amount", "subject", "payment_status", "create_time", "callback_time",
    "callback_content", "operate_time",
]

# --- wide facts: which column of which input carries which name --------------
DETAIL_OF_LINE = [
    "sku_id", "sku_name", "order_price", "sku_num", "source_type", "source_id",
    "split_total_amount", "split_activity_amount", "split_coupon_amount",
]
DETAIL_OF_ACTIVITY = ["activity_id", "activity_rule_id"]
DETAIL_OF_COUPON = ["coupon_id", "coupon_use_id"]
DETAIL_OF_PAYMENT = [
    "id", "payment_type", "payment_type_name", "trade_no", "subject",
    "payment_status", "callback_time", "callback_content",
]


def order_detail_columns(time: str = "rt") -> list[str]:
    """The 41 columns of the wide order-detail fact, in output order."""
    return (
        ["order_id"] + ORDER_INFO[1:] + [time, "order_detail_id"] + DETAIL_OF_LINE
        + ["order_detail_activity_id"] + DETAIL_OF_ACTIVITY
        + ["order_detail_coupon_id"] + DETAIL_OF_COUPON
    )


def order_detail_schema(time: str = "rt") -> str:
    """DDL of the wide order-detail fact: all text but for the event time."""
    return ", ".join(
        f"{c} {'TIMESTAMP' if c == time else 'STRING'}" for c in order_detail_columns(time)
    )


COMMENT_FACT = [
    "id", "user_id", "nick_name", "sku_id", "spu_id", "order_id", "appraise",
    "appraise_name", "comment_txt", "create_time",
]

# --- summary outputs ---------------------------------------------------------
KEYWORD_SUMMARY = ["stt", "edt", "keyword", "cur_date", "keyword_count"]
TRAFFIC_SUMMARY = [
    "stt", "edt", "vc", "ch", "ar", "is_new", "cur_date",
    "uv_ct", "sv_ct", "pv_ct", "dur_sum",
]
HOME_DETAIL_SUMMARY = ["stt", "edt", "cur_date", "home_uv_ct", "good_detail_uv_ct"]
LOGIN_SUMMARY = ["stt", "edt", "cur_date", "back_ct", "uu_ct"]
CART_SUMMARY = ["stt", "edt", "cur_date", "cart_add_uu_ct"]
ORDER_SUMMARY = ["stt", "edt", "cur_date", "order_unique_user_count", "order_new_user_count"]
SKU_SUMMARY = [
    "stt", "edt", "trademark_id", "trademark_name", "category1_id", "category1_name",
    "category2_id", "category2_name", "category3_id", "category3_name",
    "sku_id", "sku_name", "spu_id", "spu_name", "cur_date",
    "original_amount", "activity_amount", "coupon_amount", "order_amount",
]
PROVINCE_SUMMARY = [
    "stt", "edt", "province_id", "province_name", "cur_date", "order_count", "order_amount",
]
