"""Queries: log splitting, wide facts, lookups, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import coalesce0, parse_json, put_keys, to_json_rows as json_rows
from tidemark.operators import facts, joins, keywords, summaries, traffic
from tidemark.plans import facts as jobs, summaries as summary_jobs
from tidemark.plans.jobs import change_log_writer, stored_change_log
from tidemark.session import shared_dir
from tidemark.sources import dictionary, read_cdc_log, read_json_topic, read_page_log
from workload.inputs import (
    ACTIONS, BROKEN, DISPLAYS, ERR, EXTRA, LINE_ID, LINE_ORDER, NOBODY, ORDER_STATUS, QUOTED, SOUND, START, VIEW_SQL,
    log_texts, null_text, order_tables, table, views,
)
from workload.registry import query
from workload.windows import BUCKET, STT, SKU_DIM_SQL, flat_sku

# Log records that parse, with repaired visitor flags, from the events table.
REPAIRED_SQL = f"""
    with v as (select * replace (case when not ({NOBODY}) then mid end as mid), epoch_us(rt) // 1000 as ms
               from ({VIEW_SQL}) where {SOUND}),
    f as (select *, first_value(is_new) over w as ff, first_value(cast(rt as date)) over w as fd
          from v window w as (partition by mid order by ms, is_new desc))
    select * replace (case when mid is not null and is_new = '1' and not (ff = '1' and cast(rt as date) = fd)
                      then '0' else is_new end as is_new)
    from f"""


def split(spark, sf, kind, **paths):
    """One output of the split log, read back from its JSON: ``name="$.path:type"``."""
    rows = traffic.split_log(jobs.visitor_log(log_texts(spark, sf)))[kind]
    body = rows.select(F.explode(F.array(F.parse_json("value"))).alias("b"))
    return body.select(*[F.variant_get("b", *p.split(":")).alias(n) for n, p in paths.items()])


HEAD = {"mid": "$.common.mid:string", "is_new": "$.common.is_new:string", "ts": "$.ts:bigint", "x": "$.common.x:string"}
OPEN_SQL = "mid, is_new, ms as ts, concat('x', k) as x"


@query("split_error", f"""
    select {OPEN_SQL}, cast(k as int) as error_code, {EXTRA} as extra from ({REPAIRED_SQL}) where {ERR}""")
def split_error(spark, sf):
    return split(spark, sf, "error", **HEAD, error_code="$.err.error_code:int", extra="$.extra.n:int")


@query("split_start", f"""
    select {OPEN_SQL}, 'icon' as entry, cast(k as int) as loading_time, {EXTRA} as extra
    from ({REPAIRED_SQL}) where {START}""")
def split_start(spark, sf):
    return split(
        spark, sf, "start", **HEAD, entry="$.start.entry:string", loading_time="$.start.loading_time:int", extra="$.extra.n:int",
    )


@query("split_page", f"""
    select {OPEN_SQL}, page_id, last_page_id, item, during_time, concat('r', k) as refer, {EXTRA} as extra,
           cast(null as varchar) as displays, cast(null as varchar) as actions
    from ({REPAIRED_SQL}) where not ({START})""")
def split_page(spark, sf):
    return split(
        spark, sf, "page", **HEAD, page_id="$.page.page_id:string", last_page_id="$.page.last_page_id:string",
        item="$.page.item:string", during_time="$.page.during_time:bigint", refer="$.page.refer:string",
        extra="$.extra.n:int", displays="$.displays:string", actions="$.actions:string",
    )


@query("split_display", f"""
    select {OPEN_SQL}, page_id, cast(k as varchar) as item, cast(n + 10 as int) as pos_id,
           cast(n as int) as pos_seq, 'query' as display_type
    from ({REPAIRED_SQL}), (values (0), (1)) d(n) where {DISPLAYS}""")
def split_display(spark, sf):
    return split(
        spark, sf, "display", **HEAD, page_id="$.page_id:string", item="$.item:string", pos_id="$.pos_id:int",
        pos_seq="$.pos_seq:int", display_type="$.display_type:string",
    )


@query("split_action", f"""
    select {OPEN_SQL}, page_id, 'cart_add' as action_id, cast(k as varchar) as item
    from ({REPAIRED_SQL}) where {ACTIONS}""")
def split_action(spark, sf):
    return split(
        spark, sf, "action", **HEAD, page_id="$.page_id:string", action_id="$.action_id:string", item="$.item:string",
    )


# Whole payloads, keys in order, as both sides write them.
_COMMON = """'{{"ar":"' || ar || '","ch":"' || ch || '","is_new":"' || is_new || '",' || coalesce('"mid":"' || mid || '",', '')
    || '"sid":"' || event_id || '",' || coalesce('"uid":"' || uid || '",', '') || '"vc":"' || vc || '","x":"x' || k || '"}}'"""
_PAGE = """'{{"during_time":' || {quoted} || ',' || coalesce('"item":"' || item || '",', '') || '"item_type":"' || item_type || '",'
    || coalesce('"last_page_id":"' || last_page_id || '",', '') || '"page_id":"' || page_id || '","refer":"r' || k || '"}}'"""


# An error page still holds its arrays.
_SHOWN = """'{"display_type":"query","item":"' || k || '","item_type":"sku_id","pos_id":1%d,"pos_seq":%d}'"""
_ERROR_PAGE = f"""'{{' || case when {ACTIONS} then '"actions":[{{"action_id":"cart_add","item":"' || k || '","ts":0}}],' else '' end
    || '"common":' || common || case when {DISPLAYS} then ',"displays":[' || {_SHOWN % (0, 0)} || ',' || {_SHOWN % (1, 1)} || ']' else '' end
    || ',' || err || '"page":' || page || ',"ts":' || ms || '}}'"""


@query("split_topics", f"""
    with r as (select *, {_COMMON.format()} as common, {_PAGE.format(quoted=f"case when {QUOTED} then '" + '"' + "' || during_time || '" + '"' + "' else cast(during_time as varchar) end")} as page,
                      case when {ERR} then '"err":{{"error_code":' || k || '}},' else '' end
                      || case when {EXTRA} is not null then '"extra":{{"n":' || k || '}},' else '' end as err
               from ({REPAIRED_SQL})),
    p as (select *, {_ERROR_PAGE} as whole,
                 '{{"common":' || common || ',' || err || '"page":' || page || ',"ts":' || ms || '}}' as body,
                 '{{"common":' || common || ',' || err || '"start":{{"entry":"icon","loading_time":' || k || '}},"ts":' || ms || '}}' as begun,
                 '"display_type":"query","item":"' || k || '","item_type":"sku_id","page_id":"' || page_id || '","pos_id":' as shown
          from r)
    select 'dwd_traffic_err' as topic, case when {START} then begun else whole end as value from p where {ERR}
    union all select 'dwd_traffic_start', begun from p where {START}
    union all select 'dwd_traffic_page', body from p where not ({START})
    union all select 'dwd_traffic_display', '{{"common":' || common || ',' || shown || (n + 10) || ',"pos_seq":' || n || ',"ts":' || ms || '}}'
              from p, (values (0), (1)) d(n) where {DISPLAYS}
    union all select 'dwd_traffic_action', '{{"action_id":"cart_add","common":' || common || ',"item":"' || k || '","page_id":"' || page_id
              || '","ts":' || ms || '}}' from p where {ACTIONS}
    union all select 'dwd_traffic_bad', substr(concat('{{"common":{{"ar":"', ar, '","ch":"'), 1, 20) from ({VIEW_SQL}) where {BROKEN}""")
def split_topics(spark, sf):
    """All outputs in one pass, whole payloads with their keys in order."""
    return jobs.log_topics(log_texts(spark, sf), ordered=True)


@query("explode_with_context", """
    select conv_id, role, turn as ts, item, cast(pos as int) as pos_seq
    from (select conv_id, role, turn, unnest(string_split(text, ' ')) as item,
                 generate_subscripts(string_split(text, ' '), 1) - 1 as pos from conversations)""")
def explode_with_context(spark, sf):
    log = table(spark, sf, "conversations").select(
        F.struct("conv_id", "role").alias("common"), F.struct(F.col("role").alias("page_id")).alias("page"),
        F.col("turn").alias("ts"),
        F.transform(F.split("text", " ", -1), lambda w, i: F.struct(w.alias("item"), i.alias("pos_seq"))).alias("displays"),
    )
    return traffic.explode_events(log, "displays").select(
        "common.conv_id", "common.role", "ts", "item", "pos_seq"
    )


@query("fn_map_put", """
    select o_orderkey, cast(o_custkey as varchar) as user_id, 'x' as priority, cast(2 as int) as n from orders""")
def fn_map_put(spark, sf):
    data = F.create_map(
        F.lit("user_id"), F.col("o_custkey").cast("string"), F.lit("priority"), F.col("o_orderpriority")
    )
    rows = table(spark, sf, "orders").select("o_orderkey", put_keys(data, priority=F.lit("x")).alias("data"))
    return rows.select(
        "o_orderkey", F.col("data")["user_id"].alias("user_id"), F.col("data")["priority"].alias("priority"),
        F.size("data").alias("n"),
    )


# --- wide facts ---------------------------------------------------------------

ONCE = f"qualify row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(LINE_ORDER)}) = 1"
OD_SQL = f"""
    select {LINE_ID} as order_detail_id, cast(l_orderkey as varchar) as order_id,
           cast(l_partkey as varchar) as sku_id, concat('sku ', l_partkey) as sku_name,
           cast(cast(l_extendedprice as decimal(18,2)) as varchar) as order_price,
           cast(cast(l_quantity as int) as varchar) as sku_num, l_returnflag as source_type,
           cast(l_suppkey as varchar) as source_id,
           cast(cast(l_extendedprice as decimal(18,2)) as varchar) as split_total_amount,
           case when l_returnflag = 'R' then cast(cast(l_tax * 100 as decimal(18,2)) as varchar) end as split_coupon_amount
    from lineitem"""
OA_SQL = f"""
    select concat('r', {LINE_ID}) as order_detail_activity_id, {LINE_ID} as line, cast(l_suppkey as varchar) as activity_id,
           l_linestatus as activity_rule_id
    from lineitem where l_discount > 0.05 {ONCE}"""
OC_SQL = f"""
    select concat('r', {LINE_ID}) as order_detail_coupon_id, {LINE_ID} as line, cast(l_suppkey as varchar) as coupon_id,
           l_linestatus as coupon_use_id
    from lineitem where l_returnflag = 'R' {ONCE}"""
OI_SQL = f"""
    select cast(o_orderkey as varchar) as order_id,
           cast(cast(o_totalprice as decimal(18,2)) as varchar) as total_amount,
           {ORDER_STATUS} as order_status, cast(o_custkey as varchar) as user_id,
           o_orderpriority as order_comment, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as create_time,
           cast(cast(o_totalprice as decimal(18,2)) as varchar) as original_total_amount,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as rt
    from orders"""
FILLED = [
    "order_id", "total_amount", "order_status", "user_id", "order_comment", "create_time",
    "original_total_amount", "rt", "order_detail_id", "sku_id", "sku_name", "order_price", "sku_num",
    "source_type", "source_id", "split_total_amount", "split_coupon_amount",
    "order_detail_activity_id", "activity_id", "activity_rule_id",
    "order_detail_coupon_id", "coupon_id", "coupon_use_id",
]


def _wide_sql(where="", time="rt"):
    columns = []
    for c in S.order_detail_columns(time):
        columns.append(c if c in FILLED else "rt as pt" if c == "pt" else f"cast(null as varchar) as {c}")
    return f"""
        select {', '.join(columns)}
        from ({OI_SQL}) oi join ({OD_SQL}) od using (order_id)
        left join ({OA_SQL}) oa on oa.line = order_detail_id
        left join ({OC_SQL}) oc on oc.line = order_detail_id {where}"""


def _time_text(df, time="rt"):
    return df.withColumn(time, F.date_format(time, "yyyy-MM-dd HH:mm:ss"))


@query("order_detail_wide", _wide_sql())
def order_detail_wide(spark, sf):
    return _time_text(facts.order_detail_wide(**order_tables(spark, sf)))


@query("cancel_detail_wide", _wide_sql("where order_status = '1003'", "pt"))
def cancel_detail_wide(spark, sf):
    tables = order_tables(spark, sf)
    cancelled = tables.pop("oi").filter(F.col("order_status") == S.ORDER_CANCELLED).withColumnRenamed("rt", "pt")
    return _time_text(facts.cancel_detail_wide(cancelled, **tables), "pt")


def change_texts(spark, sf, cancelled=False):
    """The order tables as change-log texts."""
    tables = order_tables(spark, sf)
    names = {"oi": "order_info", "od": "order_detail", "oa": "order_detail_activity", "oc": "order_detail_coupon"}
    texts = None
    for short, name in names.items():
        df = tables[short]
        columns = [c for c in df.columns if c not in ("rt", "pt")]
        at = F.unix_timestamp("rt") if "rt" in df.columns else F.lit(0).cast("bigint")
        kind, old = F.lit("insert"), F.lit(None).cast("struct<order_status:string>")
        if cancelled and short == "oi":
            kind = F.when(F.col("order_status") == S.ORDER_CANCELLED, F.lit("update")).otherwise(kind)
            old = F.when(F.col("order_status") == S.ORDER_CANCELLED, F.struct(F.lit("1001").alias("order_status")))
        rows = df.select(F.to_json(F.struct(
            F.lit("shop").alias("database"), F.lit(name).alias("table"), kind.alias("type"), at.alias("ts"),
            F.struct(*columns).alias("data"), old.alias("old"))).alias("value"))
        texts = rows if texts is None else texts.union(rows)
    return texts


def stored_log(spark, sf, cancelled=False):
    """The change log, parsed and stored once, read back by table."""
    path = shared_dir(spark, "change-log")
    change_log_writer(path)(change_texts(spark, sf, cancelled), 0)
    return stored_change_log(spark, path)


@query("order_facts_from_log", f"select * exclude (rt) from ({_wide_sql()})")
def order_facts_from_log(spark, sf):
    return jobs.order_facts(stored_log(spark, sf), "shop").drop("rt")


@query("order_facts_in_place", f"select * exclude (rt) from ({_wide_sql()})")
def order_facts_in_place(spark, sf):
    """Parts bucketed by order once, then joined where they lie."""
    path = shared_dir(spark, "order-parts")
    buckets = jobs.buckets_for(table(spark, sf, "lineitem").count())
    parts = jobs.store_order_parts(read_cdc_log(change_texts(spark, sf)), path.rsplit("/", 1)[1].replace("-", "_"), path, buckets, "shop")
    return jobs.order_facts_in_place(parts).drop("rt")


@query("cancel_facts_from_log", f"""select * exclude (pt) from ({_wide_sql("where order_status = '1003'", "pt")})""")
def cancel_facts_from_log(spark, sf):
    return jobs.cancel_facts(stored_log(spark, sf, cancelled=True), "shop").drop("rt", "pt")


@query("order_detail_inner", f"""
    select order_id, order_detail_id, sku_id, split_total_amount, order_status
    from ({OI_SQL}) join ({OD_SQL}) using (order_id)""")
def order_detail_inner(spark, sf):
    t = order_tables(spark, sf)
    return facts.order_detail_wide(t["oi"], t["od"], t["oa"], t["oc"]).select(
        "order_id", "order_detail_id", "sku_id", "split_total_amount", "order_status"
    )


@query("order_detail_left_activity", f"""
    select order_detail_id, sku_id, split_total_amount, order_detail_activity_id, activity_id, activity_rule_id
    from ({OI_SQL}) join ({OD_SQL}) using (order_id) left join ({OA_SQL}) on line = order_detail_id""")
def order_detail_left_activity(spark, sf):
    t = order_tables(spark, sf)
    return facts.order_detail_wide(t["oi"], t["od"], t["oa"], t["oc"]).select(
        "order_detail_id", "sku_id", "split_total_amount", "order_detail_activity_id", "activity_id",
        "activity_rule_id",
    )


@query("order_detail_left_coupon", f"""
    select order_detail_id, sku_id, split_total_amount, order_detail_coupon_id, coupon_id, coupon_use_id
    from ({OI_SQL}) join ({OD_SQL}) using (order_id) left join ({OC_SQL}) on line = order_detail_id""")
def order_detail_left_coupon(spark, sf):
    t = order_tables(spark, sf)
    return facts.order_detail_wide(t["oi"], t["od"], t["oa"], t["oc"]).select(
        "order_detail_id", "sku_id", "split_total_amount", "order_detail_coupon_id", "coupon_id", "coupon_use_id"
    )


PAY_SQL = f"""
    select event_id as pay_event, user_id, rt, cast(k // 18 as varchar) as payment_type
    from ({VIEW_SQL}) where event_type = 'purchase'"""


def payments(spark, sf):
    """Purchases; a sixth of them carries a payment type the dictionary does not know."""
    rows = views(spark, sf).filter("event_type = 'purchase'")
    given = {
        "id": F.col("event_id").cast("string"), "order_id": F.col("user_id").cast("string"),
        "payment_type": F.expr("cast(k div 18 as string)"), "trade_no": F.col("item"),
    }
    return rows.select(
        *[given[c].alias(c) if c in given else null_text(c) for c in S.PAYMENT_INFO], "rt"
    )


def clicked_lines(spark, sf):
    """Clicks as order lines: the user stands for the order."""
    rows = views(spark, sf).filter("event_type = 'click'")
    given = {
        "order_id": F.col("user_id").cast("string"), "order_detail_id": F.col("event_id").cast("string"),
        "sku_id": F.col("k").cast("string"), "rt": F.col("rt"),
    }
    return rows.select(
        *[given[c].alias(c) if c in given else null_text(c) for c in S.order_detail_columns("rt")]
    )


@query("pay_interval_join", f"""
    select cast(p.user_id as varchar) as order_id, cast(c.event_id as varchar) as order_detail_id,
           cast(c.k as varchar) as sku_id, strftime(c.rt, '%Y-%m-%d %H:%M:%S') as rt,
           cast(p.pay_event as varchar) as id, p.payment_type, r_name as payment_type_name
    from ({PAY_SQL}) p join (select * from ({VIEW_SQL}) where event_type = 'click') c
      on c.user_id = p.user_id and c.rt between p.rt - interval 15 minute and p.rt + interval 60 second
    join region on cast(r_regionkey as varchar) = p.payment_type""")
def pay_interval_join(spark, sf):
    types = dictionary(table(spark, sf, "region"), "r_regionkey", "r_name")
    return _time_text(facts.pay_detail(payments(spark, sf), clicked_lines(spark, sf), types)).select(
        "order_id", "order_detail_id", "sku_id", "rt", "id", "payment_type", "payment_type_name"
    )


@query("day_interval_join", f"""
    select p.pay_event as pay_id, c.event_id as click_id
    from ({PAY_SQL}) p join (select * from ({VIEW_SQL}) where event_type = 'click') c
      on c.user_id = p.user_id and c.rt between p.rt - interval 1 day and p.rt + interval 6 hour""")
def day_interval_join(spark, sf):
    rows = views(spark, sf)
    pays = rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pay_id"), F.col("rt").alias("pay_rt"))
    clicks = rows.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "rt")
    return joins.interval_join(pays, clicks, "user_id", "pay_rt", "rt", "-1 day", "6 hours").select("pay_id", "click_id")


# --- lookups ------------------------------------------------------------------

@query("lookup_join_dictionary", """
    select cast(c_custkey as varchar) as id, c_name as nick_name,
           case when c_acctbal < 0 then 'x' else cast(c_nationkey as varchar) end as appraise, n_name as appraise_name
    from customer join nation on cast(n_nationkey as varchar) =
         case when c_acctbal < 0 then 'x' else cast(c_nationkey as varchar) end""")
def lookup_join_dictionary(spark, sf):
    given = {
        "id": F.col("c_custkey").cast("string"), "nick_name": F.col("c_name"),
        "appraise": F.when(F.col("c_acctbal") < 0, F.lit("x")).otherwise(F.col("c_nationkey").cast("string")),
    }
    comments = table(spark, sf, "customer").select(
        *[given[c].alias(c) if c in given else null_text(c) for c in S.COMMENT_INFO]
    )
    names = dictionary(table(spark, sf, "nation"), "n_nationkey", "n_name")
    return facts.comment_fact(comments, names).select("id", "nick_name", "appraise", "appraise_name")


@query("lookup_join_payment", f"""
    select pay_event, payment_type, r_name as payment_type_name
    from ({PAY_SQL}) join region on cast(r_regionkey as varchar) = payment_type""")
def lookup_join_payment(spark, sf):
    types = dictionary(table(spark, sf, "region"), "r_regionkey", "r_name")
    return joins.lookup_join(
        payments(spark, sf), types, "payment_type", {"payment_type_name": "info.dic_name"}
    ).select(F.col("id").cast("bigint").alias("pay_event"), "payment_type", "payment_type_name")


@query("dim_lookup_single", """
    select o_orderkey, c_name as user_name, c_mktsegment as segment
    from orders left join customer on c_custkey = o_custkey and c_acctbal >= 0""")
def dim_lookup_single(spark, sf):
    from tidemark.sources import dim_table

    people = dim_table(table(spark, sf, "customer").filter("c_acctbal >= 0"), "c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("user_id"))
    return joins.enrich(
        orders, people, "user_id", {"user_name": "info.c_name", "segment": "info.c_mktsegment"}
    ).select("o_orderkey", "user_name", "segment")


@query("snowflake_enrich", f"""
    select l.sku_id, l.n, d.* exclude (sku_id)
    from (select cast(l_partkey as varchar) as sku_id, count(*) as n from lineitem group by l_partkey) l
    left join ({SKU_DIM_SQL}) d on d.sku_id = l.sku_id""")
def snowflake_enrich(spark, sf):
    per_sku = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("sku_id")).agg(F.count("*").alias("n"))
    return joins.enrich_sku(per_sku, flat_sku(spark, sf))


@query("province_enrich", """
    select c_custkey, n_name as province_name from customer left join nation on n_nationkey = c_nationkey and n_regionkey <> 2""")
def province_enrich(spark, sf):
    nation = table(spark, sf, "nation").filter("n_regionkey <> 2")
    return joins.enrich(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey",
        {"province_name": "n_name"}, "n_nationkey",
    ).select("c_custkey", "province_name")


@query("null_default", f"""
    select order_detail_id, cast(coalesce(cast(split_coupon_amount as decimal(18,2)), 0) as double) as coupon_amount,
           sku_id, split_total_amount
    from ({OD_SQL})""")
def null_default(spark, sf):
    return order_tables(spark, sf)["od"].select(
        F.col("id").alias("order_detail_id"), coalesce0("split_coupon_amount").cast("double").alias("coupon_amount"),
        "sku_id", "split_total_amount",
    )


# --- keywords -----------------------------------------------------------------

WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


@query("keyword_lateral", f"""
    select lang, word, count(*) as n from (select lang, unnest({WORDS.format('text')}) as word from documents)
    group by lang, word""")
def keyword_lateral(spark, sf):
    return keywords.explode_words(table(spark, sf, "documents").select("lang", "text"), "text").groupBy(
        "lang", "word"
    ).agg(F.count("*").alias("n"))


@query("keyword_count_window", f"""
    select {STT.format("'10 minutes'")}, word as keyword, strftime(w, '%Y-%m-%d') as cur_date, count(*) as keyword_count
    from (select {BUCKET.format("'10 minutes'", 'make_timestamp(1704067200000000 + doc_id * 60000000)')} as w,
                 unnest({WORDS.format('text')}) as word from documents)
    group by w, word""")
def keyword_count_window(spark, sf):
    searched = table(spark, sf, "documents").select(
        "text", F.timestamp_seconds(F.col("doc_id") * 60 + 1704067200).alias("rt")
    )
    return summaries.keyword_window(keywords.explode_words(searched, "text"))


@query("search_keyword_summary", f"""
    select {STT.format("'10 minutes'")}, word as keyword, strftime(w, '%Y-%m-%d') as cur_date, count(*) as keyword_count
    from (select {BUCKET.format("'10 minutes'", 'rt')} as w, unnest({WORDS.format('item')}) as word
          from ({VIEW_SQL}) where {SOUND} and event_type <> 'signup' and last_page_id = 'search'
               and item is not null and item_type = 'keyword')
    group by w, word""")
def search_keyword_summary(spark, sf):
    """From raw page records to the keyword summary."""
    return summary_jobs.keyword_summary(read_page_log(log_texts(spark, sf)))


DICT_SQL = f"""
    select distinct word from (
        select unnest({WORDS.format('p_name')}) as word from part
        union all select unnest({WORDS.format('text')}) from benchmark)"""


@query("dictionary_segment", f"""
    with runs as (select lang, run, count(*) as c from (select lang, unnest({WORDS.format('text')}) as run from documents) group by lang, run),
    words as ({DICT_SQL}),
    one as (select distinct run from runs),
    cuts as (select run, substr(run, s, n) as word
             from one, (select distinct length(word) as n from words) l, lateral (select unnest(generate_series(1, length(run) - n + 1)) as s) g),
    hits as (select run, word, count(*) as h from cuts join words using (word) group by run, word
             union all select run, run, 1 from one where run not in (select word from words))
    select lang, word, cast(sum(c * h) as bigint) as n from runs join hits using (run) group by lang, word""")
def dictionary_segment(spark, sf):
    known = keywords.explode_words(table(spark, sf, "part").select("p_name"), "p_name").unionByName(
        keywords.explode_words(table(spark, sf, "benchmark").select("text"), "text")
    )
    return keywords.segment(table(spark, sf, "documents").select("lang", "text"), "text", known)
