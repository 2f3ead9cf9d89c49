"""Queries: sources, parsing, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as fn, schemas as S
from tidemark.operators import cdc, joins, traffic
from tidemark.sources import read_cdc_log, read_json_topic, read_page_log
from workload.inputs import (
    BROKEN, CDC_SQL, CONFIG_SQL, EMPTY, NOBODY, SOUND, VIEW_SQL, cdc_texts, config, log_texts, table, views,
)
from workload.registry import query

TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _text_time(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


@query("json_topic_scan", "select event_id, user_id, event_type, value from events")
def json_topic_scan(spark, sf):
    raw = fn.to_json_rows(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"))
    return read_json_topic(raw, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE")


@query("cdc_changelog_scan", f"""
    select database, "table", type, ts, {TIME.format("make_timestamp(ts * 1000000)")} as rt,
           cast(o_orderkey as varchar) as id, order_status, old_status
    from ({CDC_SQL})""")
def cdc_changelog_scan(spark, sf):
    return read_cdc_log(cdc_texts(spark, sf)).select(
        "database", "table", "type", "ts", _text_time("rt").alias("rt"),
        F.col("data")["id"].alias("id"), F.col("data")["order_status"].alias("order_status"),
        F.col("old")["order_status"].alias("old_status"),
    )


@query("page_log_scan", f"""
    select epoch_us(rt) // 1000 as ts, page_id, last_page_id, cast(during_time as varchar) as during_time,
           {TIME.format('rt')} as rt
    from (select * from ({VIEW_SQL}) where {SOUND} and event_type <> 'signup')""")
def page_log_scan(spark, sf):
    pages = read_page_log(log_texts(spark, sf)).filter(F.col("page").isNotNull())
    page = F.col("page")
    return pages.select(
        "ts", page["page_id"].alias("page_id"), page["last_page_id"].alias("last_page_id"),
        page["during_time"].alias("during_time"), _text_time("rt").alias("rt"),
    )


@query("config_snapshot", f"select * from ({CONFIG_SQL}) where sink_type = 'dim'")
def config_snapshot(spark, sf):
    return config(spark, sf).filter(F.col("sink_type") == "dim")


@query("to_json_rows", """
    select concat('{"event_id":', event_id, ',"user_id":', user_id, ',"event_type":"', event_type, '"}') as value
    from events""")
def to_json_rows(spark, sf):
    return fn.to_json_rows(table(spark, sf, "events").select("event_id", "user_id", "event_type"))


@query("parse_drop_dirty", f"""
    select mid, uid, is_new, page_id, during_time, epoch_us(rt) // 1000 as ts from (
        select case when not ({NOBODY}) then mid end as mid, uid, is_new, rt,
               case when event_type <> 'signup' then page_id end as page_id,
               case when event_type <> 'signup' then during_time end as during_time
        from ({VIEW_SQL}) where {SOUND})""")
def parse_drop_dirty(spark, sf):
    good, _ = fn.parse_json(log_texts(spark, sf), S.LOG)
    return good.select(
        "common.mid", "common.uid", "common.is_new", "page.page_id", "page.during_time", "ts"
    )


@query("parse_bad_records", f"""
    select substr(concat('{{"common":{{"ar":"', ar, '","ch":"'), 1, 20) as value
    from ({VIEW_SQL}) where {BROKEN}""")
def parse_bad_records(spark, sf):
    return fn.parse_json(log_texts(spark, sf), S.LOG)[1]


@query("drop_tombstones", f"""
    select case when {BROKEN} then substr(concat('{{"common":{{"ar":"', ar, '","ch":"'), 1, 20) else cast(event_id as varchar) end as record
    from ({VIEW_SQL}) where not ({EMPTY})""")
def drop_tombstones(spark, sf):
    """Row by row: the id in a record, or the text that is none."""
    rows = cdc.drop_tombstones(log_texts(spark, sf))
    return rows.select(F.coalesce(F.get_json_object("value", "$.common.sid"), "value").alias("record"))


ORDER_COLUMNS = ["id", "user_id", "total_amount", "order_status", "create_time"]
ORDER_SQL = f"""
    cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as user_id,
    cast(cast(o_totalprice as decimal(18,2)) as varchar) as total_amount, order_status,
    {TIME.format('o_orderdate')} as create_time"""


@query("cdc_table_insert", f"select {ORDER_SQL} from ({CDC_SQL}) where type = 'insert'")
def cdc_table_insert(spark, sf):
    log = read_cdc_log(cdc_texts(spark, sf))
    return cdc.cdc_table(log, "order_info", ["insert"], ORDER_COLUMNS, "shop")


@query("cdc_table_insert_update", f"select {ORDER_SQL} from ({CDC_SQL}) where type in ('insert', 'update')")
def cdc_table_insert_update(spark, sf):
    log = read_cdc_log(cdc_texts(spark, sf))
    return cdc.cdc_table(log, "order_info", ["insert", "update"], ORDER_COLUMNS, "shop")


@query("cancel_filter", f"""
    select {ORDER_SQL} from ({CDC_SQL})
    where type = 'update' and old_status is not null and order_status = '1003'""")
def cancel_filter(spark, sf):
    return cdc.order_cancel(read_cdc_log(cdc_texts(spark, sf)), "shop").select(*ORDER_COLUMNS)


CART_TYPE = "case when l_linestatus = 'O' then 'insert' else 'update' end"
CART_OLD = "case when l_returnflag <> 'R' then cast(l_linenumber * 5 as {}) end"


@query("cart_add_delta", f"""
    select id, sku_id, cast(case when type = 'insert' then n else n - cast(o as int) end as varchar) as sku_num
    from (select concat(l_orderkey, '-', l_linenumber) as id, cast(l_partkey as varchar) as sku_id,
                 {CART_TYPE} as type, cast(l_quantity as int) as n, {CART_OLD.format('varchar')} as o
          from lineitem)
    where type = 'insert' or (o is not null and n > cast(o as int))""")
def cart_add_delta(spark, sf):
    log = table(spark, sf, "lineitem").select(
        F.lit("shop").alias("database"), F.lit("cart_info").alias("table"),
        F.expr(CART_TYPE).alias("type"),
        F.create_map(
            F.lit("id"), F.expr("concat(l_orderkey, '-', l_linenumber)"),
            F.lit("sku_id"), F.col("l_partkey").cast("string"),
            F.lit("sku_num"), F.col("l_quantity").cast("int").cast("string"),
        ).alias("data"),
        F.create_map(F.lit("sku_num"), F.expr(CART_OLD.format("string"))).alias("old"),
    )
    return cdc.cart_add(log, "shop").select("id", "sku_id", "sku_num")


PAY_TYPE = "case when event_type = 'purchase' then 'insert' else 'update' end"


@query("payment_filter", f"""
    select cast(event_id as varchar) as id, cast(user_id as varchar) as order_id,
           cast(k as varchar) as payment_type, {TIME.format('rt')} as rt
    from ({VIEW_SQL}) where event_type = 'purchase'""")
def payment_filter(spark, sf):
    log = views(spark, sf).select(
        F.lit("shop").alias("database"), F.lit("payment_info").alias("table"),
        F.expr(PAY_TYPE).alias("type"), "rt", F.current_timestamp().alias("pt"),
        F.create_map(
            F.lit("id"), F.col("event_id").cast("string"),
            F.lit("order_id"), F.col("user_id").cast("string"),
            F.lit("payment_type"), F.col("k").cast("string"),
        ).alias("data"),
    )
    return cdc.payment_info(log, "shop").select("id", "order_id", "payment_type", _text_time("rt").alias("rt"))


@query("search_filter", f"""
    select event_id, item from ({VIEW_SQL})
    where last_page_id = 'search' and item is not null and item_type = 'keyword'""")
def search_filter(spark, sf):
    return traffic.search_pages(views(spark, sf)).select("event_id", "item")


@query("page_membership", f"select event_id, page_id from ({VIEW_SQL}) where page_id in ('home', 'good_detail')")
def page_membership(spark, sf):
    return traffic.pages_of(views(spark, sf), ["home", "good_detail"]).select("event_id", "page_id")


@query("login_filter", f"""
    select event_id, uid from ({VIEW_SQL})
    where uid is not null and (last_page_id is null or last_page_id = 'login')""")
def login_filter(spark, sf):
    return traffic.login_pages(views(spark, sf)).select("event_id", "uid")


@query("traffic_measures", f"""
    select event_id, cast(case when last_page_id is null then 1 else 0 end as bigint) as sv,
           cast(1 as bigint) as pv
    from ({VIEW_SQL})""")
def traffic_measures(spark, sf):
    return traffic.traffic_measures(views(spark, sf)).select("event_id", "sv", "pv")


@query("map_prune_columns", """
    select o_orderkey, cast(o_orderkey as varchar) as id,
           case when o_orderstatus <> 'P' then cast(o_custkey as varchar) end as user_id,
           case when o_orderstatus = 'O' then o_orderpriority end as priority,
           cast(case o_orderstatus when 'O' then 3 when 'F' then 2 else 1 end as int) as kept
    from orders""")
def map_prune_columns(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.create_map(
            F.lit("id"), F.col("o_orderkey").cast("string"),
            F.lit("user_id"), F.col("o_custkey").cast("string"),
            F.lit("priority"), F.col("o_orderpriority"),
        ).alias("data"),
        F.expr("case o_orderstatus when 'O' then 'id, user_id,priority' when 'F' then 'id,user_id' else 'id' end").alias("cols"),
    )
    pruned = rows.withColumn("data", fn.prune_columns("data", "cols"))
    data = F.col("data")
    return pruned.select(
        "o_orderkey", data["id"].alias("id"), data["user_id"].alias("user_id"),
        data["priority"].alias("priority"), F.size("data").alias("kept"),
    )


@query("snake_case_output", "select c_custkey as cust_key, c_name as cust_name, c_nationkey as nation_key from customer")
def snake_case_output(spark, sf):
    bean = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custKey"), F.col("c_name").alias("custName"),
        F.col("c_nationkey").alias("nationKey"), F.col("c_acctbal").alias("ts"),
    )
    return fn.snake_case(bean, drop=["ts"])


@query("camel_case_output", """
    select n_nationkey as "nNationkey", n_name as "nName", n_regionkey as "nRegionkey" from nation""")
def camel_case_output(spark, sf):
    return fn.camel_case(table(spark, sf, "nation"))


@query("event_time_coalesce", f"""
    select o_orderkey, {TIME.format("case when o_orderstatus = 'F' then o_orderdate + interval 1 day else o_orderdate end")} as rt
    from orders""")
def event_time_coalesce(spark, sf):
    from tidemark.plans.summaries import changed_time

    rows = table(spark, sf, "orders").select(
        "o_orderkey", _text_time("o_orderdate").alias("create_time"),
        F.when(F.col("o_orderstatus") == "F", _text_time(F.col("o_orderdate") + F.expr("interval 1 day"))).alias("operate_time"),
    )
    return changed_time(rows).select("o_orderkey", _text_time("rt").alias("rt"))


# --- scalar functions ---------------------------------------------------------

@query("fn_map_access", f"""
    select cast(o_orderkey as varchar) as id, order_status, old_status
    from ({CDC_SQL})""")
def fn_map_access(spark, sf):
    log = read_cdc_log(cdc_texts(spark, sf))
    return log.select(
        F.col("data")["id"].alias("id"), F.col("data")["order_status"].alias("order_status"),
        F.col("old")["order_status"].alias("old_status"),
    )


@query("fn_if", """
    select o_orderkey, cast(case when o_orderstatus = 'O' then 1 else 0 end as bigint) as sv, cast(1 as bigint) as pv from orders""")
def fn_if(spark, sf):
    """A view without a page before it starts a session."""
    views_ = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("case when o_orderstatus <> 'O' then o_orderpriority end").alias("last_page_id"))
    return traffic.traffic_measures(views_).select("o_orderkey", "sv", "pv")


@query("fn_cast_delta", """
    select l_orderkey, l_linenumber, l_partkey,
           case when l_returnflag <> 'N' then cast(cast(l_quantity as int) - l_linenumber as varchar) end as delta
    from lineitem""")
def fn_cast_delta(spark, sf):
    text = F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("int").cast("string")).otherwise("none")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        fn.cast_delta(text, F.col("l_linenumber").cast("string")).alias("delta"),
    )


@query("fn_date_format", "select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events")
def fn_date_format(spark, sf):
    ms = table(spark, sf, "events").select("event_id", fn.epoch_ms("ts").alias("ms"))
    return ms.select("event_id", fn.to_date_text("ms").alias("day"), fn.to_datetime_text("ms").alias("at"))


@query("fn_epoch_to_ts", """
    select event_id, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d %H:%M:%S.%g') as from_ms,
           strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%d %H:%M:%S') as from_s
    from events""")
def fn_epoch_to_ts(spark, sf):
    ms = table(spark, sf, "events").select("event_id", fn.epoch_ms("ts").alias("ms"))
    return ms.select(
        "event_id", F.date_format(fn.from_epoch("ms"), "yyyy-MM-dd HH:mm:ss.SSS").alias("from_ms"),
        _text_time(fn.from_epoch(F.call_function("div", F.col("ms"), F.lit(1000)), "s")).alias("from_s"),
    )


@query("fn_interval", """
    select event_id, strftime(ts - interval 15 minute, '%Y-%m-%d %H:%M:%S') as lower_at,
           strftime(ts + interval 60 second, '%Y-%m-%d %H:%M:%S') as upper_at
    from events""")
def fn_interval(spark, sf):
    """The bounds of the interval join, as it reads them."""
    def moved(span):
        return _text_time(F.col("ts") + F.make_dt_interval(secs=F.lit(joins.seconds(span))))

    return table(spark, sf, "events").select(
        "event_id", moved("-15 minutes").alias("lower_at"), moved("60 seconds").alias("upper_at"))


@query("fn_to_date", """
    select event_id, strftime(ts, '%Y-%m-%d') as utc, strftime(ts + interval 8 hour, '%Y-%m-%d') as east
    from events""")
def fn_to_date(spark, sf):
    ms = table(spark, sf, "events").select("event_id", fn.epoch_ms("ts").alias("ms"))
    return ms.select("event_id", fn.to_date_text("ms").alias("utc"), fn.to_date_text("ms", "+08:00").alias("east"))


@query("fn_to_ymdhms", """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as utc,
           strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M:%S') as east
    from events""")
def fn_to_ymdhms(spark, sf):
    ms = table(spark, sf, "events").select("event_id", fn.epoch_ms("ts").alias("ms"))
    return ms.select(
        "event_id", fn.to_datetime_text("ms").alias("utc"), fn.to_datetime_text("ms", "+08:00").alias("east")
    )


@query("fn_to_ts", """
    select event_id, epoch_ms(date_trunc('second', ts)) as utc,
           epoch_ms(date_trunc('second', ts)) - 28800000 as east,
           epoch_ms(date_trunc('day', ts)) as day
    from events""")
def fn_to_ts(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id", _text_time("ts").alias("t"), F.date_format("ts", "yyyy-MM-dd").alias("d")
    )
    return text.select(
        "event_id", fn.to_ts("t").alias("utc"), fn.to_ts("t", tz="+08:00").alias("east"),
        fn.to_ts("d", full=False).alias("day"),
    )


@query("fn_date_part", "select event_id, strftime(ts, '%Y-%m-%d') as day from events")
def fn_date_part(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.date_part(_text_time("ts")).alias("day"))


@query("fn_datediff", "select o_orderkey, cast(date_diff('day', o_orderdate, date '2001-09-01') as int) as days from orders")
def fn_datediff(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", fn.days_between(F.lit("2001-09-01").cast("date"), "o_orderdate").alias("days")
    )


@query("fn_json_extract", f"""
    select event_id, k, cast(value as decimal(18,2))::double as amount, event_type
    from (select event_id, {'cast(regexp_extract(props, $$[0-9]+$$, 0) as int)'} as k, value, event_type from events)""")
def fn_json_extract(spark, sf):
    raw = fn.to_json_rows(table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("value").cast("string").alias("amount"), "event_type",
    ))
    rows = read_json_topic(raw, "event_id BIGINT, k INT, amount STRING, event_type STRING")
    return rows.select("event_id", "k", fn.money("amount").cast("double").alias("amount"), "event_type")


@query("fn_json_array", f"""
    select event_id, cast(2 as int) as n, cast(k as varchar) as first_item, cast(11 as int) as last_pos
    from ({VIEW_SQL}) where event_type in ('view', 'click') and k >= 10""")
def fn_json_array(spark, sf):
    log = fn.parse_json(log_texts(spark, sf), S.LOG)[0].filter(F.col("displays").isNotNull())
    return log.select(
        F.col("common.sid").cast("bigint").alias("event_id"), F.size("displays").alias("n"),
        F.col("displays")[0]["item"].alias("first_item"),
        F.element_at("displays", -1)["pos_id"].alias("last_pos"),
    )


@query("fn_json_with_field", f"""
    select event_id, '0' as is_new, case when not ({NOBODY}) then mid end as mid, cast(null as varchar) as uid from ({VIEW_SQL}) where {SOUND}""")
def fn_json_with_field(spark, sf):
    log = fn.parse_json(log_texts(spark, sf), S.LOG)[0]
    changed = log.withColumn("common", fn.set_field("common", "is_new", F.lit("0")))
    changed = changed.withColumn("common", F.col("common").dropFields("uid"))
    again = read_json_topic(
        fn.to_json_rows(changed.select("common")),
        "common STRUCT<is_new: STRING, mid: STRING, uid: STRING, sid: STRING>",
    )
    return again.select(
        F.col("common.sid").cast("bigint").alias("event_id"), "common.is_new", "common.mid", "common.uid"
    )


@query("fn_struct_field", "select cast(r_regionkey as varchar) as rowkey, r_name as dic_name from region")
def fn_struct_field(spark, sf):
    from tidemark.sources import dictionary

    return dictionary(table(spark, sf, "region"), "r_regionkey", "r_name").select(
        "rowkey", F.col("info.dic_name").alias("dic_name")
    )


@query("spread_rows", "select l_returnflag, l_orderkey, l_linenumber, l_extendedprice from lineitem")
def spread_rows(spark, sf):
    """A flag holds a third of all lines; each is written by several tasks."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return fn.spread(lines, ["l_returnflag"], 16, ["l_orderkey", "l_linenumber"])
