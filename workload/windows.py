"""Queries: first-of-key operators, tumbling windows, summaries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas as S
from tidemark.functions import money
from tidemark.operators import firsts, joins, summaries, traffic
from tidemark.operators.windows import first_by, tumble, window_bounds
from tidemark.plans import firsts as plans_firsts, summaries as jobs
from tidemark.session import shared_dir, written
from workload.inputs import LINE_ID, LINE_ORDER, NOBODY, VIEW_SQL, order_tables, table, views
from workload.registry import SQL, query

STT = "strftime(w, '%Y-%m-%d %H:%M:%S') as stt, strftime(w + interval {0}, '%Y-%m-%d %H:%M:%S') as edt"
BUCKET = "time_bucket(interval {0}, {1})"


def _amounts(df, *columns):
    """Money as double for the comparison; it was summed as decimal."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- bare windows -------------------------------------------------------------

def _tumble(name, size):
    @query(name, f"""
        select {STT.format(size)}, event_type, count(*) as n,
               cast(sum(cast(value as decimal(18,2))) as double) as total
        from (select {BUCKET.format(size, 'ts')} as w, event_type, value from events)
        group by w, event_type""")
    def run(spark, sf):
        summed = tumble(table(spark, sf, "events"), "ts", size.replace("'", ""), ["event_type"], [
            F.count("*").alias("n"), F.sum(money("value")).alias("total"),
        ])
        return _amounts(window_bounds(summed), "total")


_tumble("tumble_10s", "'10 seconds'")
_tumble("tumble_10m", "'10 minutes'")
_tumble("tumble_3h", "'3 hours'")


@query("tumble_2s", f"""
    select {STT.format("'2 seconds'")}, count(*) as n
    from (select {BUCKET.format("'2 seconds'", 'ts')} as w from events) group by w""")
def tumble_2s(spark, sf):
    return window_bounds(tumble(table(spark, sf, "events"), "ts", "2 seconds", [], [F.count("*").alias("n")]))


@query("first_attribute_by", """
    select l_partkey, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) as first_supplier
    from lineitem group by l_partkey""")
def first_attribute_by(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        first_by("l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]).alias("first_supplier")
    )


# --- first-of-key operators ---------------------------------------------------

@query("repair_is_new", f"""
    with v as ({VIEW_SQL}),
    f as (select *, first_value(is_new) over w as ff, first_value(cast(rt as date)) over w as fd
          from v window w as (partition by mid order by rt, is_new desc))
    select event_id, case when is_new = '1' and not (ff = '1' and cast(rt as date) = fd)
                          then '0' else is_new end as is_new
    from f""")
def repair_is_new(spark, sf):
    return traffic.repair_is_new(views(spark, sf), "mid", "rt", "is_new").select("event_id", "is_new")


@query("daily_first_flag", f"""
    select event_id, cast(case when not ({NOBODY}) and row_number() over (partition by mid, {NOBODY}, cast(rt as date)
           order by date_trunc('hour', rt), event_id) = 1 then 1 else 0 end as bigint) as uv
    from ({VIEW_SQL})""")
def daily_first_flag(spark, sf):
    """Times cut to the hour, so that many are equal."""
    rows = some_nobody(views(spark, sf)).withColumn("rt", F.date_trunc("hour", "rt"))
    return firsts.flag_first_of_day(rows, "mid", "rt", ["event_id"]).select("event_id", "uv")


def some_nobody(df):
    """Views of which some have no visitor; they count for nobody."""
    return df.withColumn("mid", F.expr(f"case when not ({NOBODY}) then mid end"))


@query("daily_first_by_page", f"""
    select mid, page_id, strftime(cast(rt as date), '%Y-%m-%d') as cur_date, min(epoch_us(rt)) as first_us
    from ({VIEW_SQL}) where page_id in ('home', 'good_detail') and not ({NOBODY}) group by mid, page_id, cast(rt as date)""")
def daily_first_by_page(spark, sf):
    days = firsts.first_of_day(
        traffic.pages_of(some_nobody(views(spark, sf)), ["home", "good_detail"]), ["mid", "page_id"], "rt"
    )
    return days.select(
        "mid", "page_id", F.date_format("cur_date", "yyyy-MM-dd").alias("cur_date"),
        F.unix_micros("rt").alias("first_us"),
    )


LOGIN_DAYS = f"""
    select uid, cast(rt as date) as d, min(rt) as rt from ({VIEW_SQL})
    where uid is not null and (last_page_id is null or last_page_id = 'login')
    group by uid, cast(rt as date)"""
LOGIN_FLAGS = f"""
    select uid, d, rt, cast(1 as bigint) as uu,
           cast(case when date_diff('day', lag(d) over (partition by uid order by d), d) >= 7
                then 1 else 0 end as bigint) as back
    from ({LOGIN_DAYS})"""


@query("login_back_users", f"""
    select uid, strftime(d, '%Y-%m-%d') as cur_date, epoch_us(rt) as first_us, uu, back from ({LOGIN_FLAGS})""")
def login_back_users(spark, sf):
    days = firsts.login_first_of_day(traffic.login_pages(views(spark, sf)), "uid", "rt")
    return days.select(
        "uid", F.date_format("cur_date", "yyyy-MM-dd").alias("cur_date"),
        F.unix_micros("rt").alias("first_us"), "uu", "back",
    )


def run_by(firsts_kept, rows, part):
    """The runs over the parts of ``rows`` in order, each with no more of the parts before it than the kept table."""
    parts = sorted(r[0] for r in rows.select(part.alias("p")).distinct().collect())  # weeks, or years
    done = [written(firsts_kept.run(rows.filter(part == p), k), "run") for k, p in enumerate(parts)]
    return functools.reduce(DataFrame.union, done)


@query("login_back_users_by_week", SQL["login_back_users"])
def login_back_users_by_week(spark, sf):
    """As in one run over everything."""
    logins = traffic.login_pages(views(spark, sf))
    kept = plans_firsts.LoginDays(spark, shared_dir(spark, "logins"))
    days = run_by(kept, logins, F.date_trunc("week", "rt"))
    return days.select(
        "uid", F.date_format("cur_date", "yyyy-MM-dd").alias("cur_date"),
        F.unix_micros("rt").alias("first_us"), "uu", "back",
    )


CARTS_SQL = f"""
    select case when not ({NOBODY}) then concat('u', user_id) end as user_id,
           date_trunc('second', rt) as create_time,
           case when k < 50 then date_trunc('second', rt + interval 30 second) end as operate_time
    from ({VIEW_SQL}) where event_type = 'click'"""


def carts(spark, sf):
    rows = views(spark, sf).filter("event_type = 'click'")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        F.expr(f"case when not ({NOBODY}) then concat('u', user_id) end").alias("user_id"),
        text("rt").alias("create_time"),
        F.when(F.col("k") < 50, text(F.col("rt") + F.expr("interval 30 seconds"))).alias("operate_time"),
    )


CART_FIRSTS = f"""
    select user_id, cast(rt as date) as d, min(rt) as rt
    from (select user_id, coalesce(operate_time, create_time) as rt from ({CARTS_SQL}))
    where user_id is not null group by user_id, cast(rt as date)"""


@query("cart_first_of_day", f"""
    select user_id, strftime(d, '%Y-%m-%d') as cur_date, strftime(rt, '%Y-%m-%d %H:%M:%S') as rt
    from ({CART_FIRSTS})""")
def cart_first_of_day(spark, sf):
    days = firsts.first_of_day(jobs.changed_time(carts(spark, sf)), ["user_id"], "rt")
    return days.select(
        "user_id", F.date_format("cur_date", "yyyy-MM-dd").alias("cur_date"),
        F.date_format("rt", "yyyy-MM-dd HH:mm:ss").alias("rt"),
    )


@query("order_first_flags", """
    select o_custkey, strftime(d, '%Y-%m-%d') as cur_date,
           cast(case when row_number() over (partition by o_custkey order by d) = 1 then 1 else 0 end as bigint) as is_new
    from (select distinct o_custkey, cast(o_orderdate as date) as d from orders)""")
def order_first_flags(spark, sf):
    days = firsts.order_first_flags(table(spark, sf, "orders"), "o_custkey", "o_orderdate")
    return days.select("o_custkey", F.date_format("cur_date", "yyyy-MM-dd").alias("cur_date"), "is_new")


@query("order_first_flags_by_year", SQL["order_first_flags"])
def order_first_flags_by_year(spark, sf):
    """As in one run over everything."""
    kept = plans_firsts.OrderUsers(spark, shared_dir(spark, "orders"), "o_custkey", "o_orderdate")
    days = run_by(kept, table(spark, sf, "orders"), F.year("o_orderdate"))
    return days.select("o_custkey", F.date_format("cur_date", "yyyy-MM-dd").alias("cur_date"), "is_new")


DEDUP_SQL = f"""
    select * from lineitem
    qualify row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(LINE_ORDER)}) = 1"""


@query("dedup_order_detail", f"""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag
    from ({DEDUP_SQL})""")
def dedup_order_detail(spark, sf):
    return firsts.dedup_within(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"
    )


# --- summaries ----------------------------------------------------------------

@query("traffic_vc_ch_ar_isnew_window", f"""
    with v as ({VIEW_SQL}),
    u as (select *, {BUCKET.format("'10 seconds'", 'rt')} as w,
                 row_number() over (partition by mid, cast(rt as date) order by rt, is_new, ar, ch, vc) as rn
          from v)
    select {STT.format("'10 seconds'")}, vc, ch, ar, is_new, strftime(w, '%Y-%m-%d') as cur_date,
           cast(sum(case when rn = 1 then 1 else 0 end) as bigint) as uv_ct,
           cast(sum(case when last_page_id is null then 1 else 0 end) as bigint) as sv_ct,
           count(*) as pv_ct, cast(sum(during_time) as bigint) as dur_sum
    from u group by w, vc, ch, ar, is_new""")
def traffic_window(spark, sf):
    return jobs.traffic_summary(views(spark, sf))


@query("home_detail_uv_window", f"""
    select {STT.format("'10 seconds'")}, strftime(w, '%Y-%m-%d') as cur_date,
           cast(sum(case when page_id = 'home' then 1 else 0 end) as bigint) as home_uv_ct,
           cast(sum(case when page_id = 'good_detail' then 1 else 0 end) as bigint) as good_detail_uv_ct
    from (select page_id, {BUCKET.format("'10 seconds'", 'min(rt)')} as w from ({VIEW_SQL})
          where page_id in ('home', 'good_detail') and not ({NOBODY}) group by mid, page_id, cast(rt as date))
    group by w""")
def home_detail_window(spark, sf):
    return jobs.home_detail_summary(some_nobody(views(spark, sf)))


@query("user_login_window", f"""
    select {STT.format("'10 seconds'")}, strftime(w, '%Y-%m-%d') as cur_date,
           cast(sum(back) as bigint) as back_ct, cast(sum(uu) as bigint) as uu_ct
    from (select {BUCKET.format("'10 seconds'", 'rt')} as w, back, uu from ({LOGIN_FLAGS}))
    group by w""")
def user_login_window(spark, sf):
    return jobs.login_summary(views(spark, sf))


@query("cart_add_uu_window", f"""
    select {STT.format("'10 seconds'")}, strftime(w, '%Y-%m-%d') as cur_date, count(*) as cart_add_uu_ct
    from (select {BUCKET.format("'10 seconds'", 'rt')} as w from ({CART_FIRSTS})) group by w""")
def cart_uu_window(spark, sf):
    return jobs.cart_summary(carts(spark, sf))


@query("trade_order_window", f"""
    with o as (select o_custkey, cast(o_orderdate as date) as d,
                      min(case when o_orderstatus = 'F' then o_orderdate + interval 36 hour else o_orderdate end) as rt
               from orders group by o_custkey, cast(o_orderdate as date)),
    f as (select *, {BUCKET.format("'2 seconds'", 'rt')} as w,
                 case when row_number() over (partition by o_custkey order by rt, d) = 1 then 1 else 0 end as is_new
          from o)
    select {STT.format("'2 seconds'")}, strftime(min(d), '%Y-%m-%d') as cur_date,
           count(*) as order_unique_user_count, cast(sum(is_new) as bigint) as order_new_user_count
    from (select w, is_new, d, rt from f) group by w""")
def trade_order_window(spark, sf):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    lines = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), text("o_orderdate").alias("create_time"),
        F.when(F.col("o_orderstatus") == "F", text(F.col("o_orderdate") + F.expr("interval 36 hours"))).alias("operate_time"),
    )
    nobody = lines.withColumn("user_id", F.lit(None).cast("bigint"))  # lines of no user count for nobody
    return jobs.order_user_summary(lines.unionByName(nobody))


SKU_DIM_SQL = """
    select cast(p_partkey as varchar) as sku_id, p_type as spu_id, s.spu_name,
           p_brand as trademark_id, t.tm_name as trademark_name,
           cast(p_size as varchar) as category3_id, n_name as category3_name,
           cast(n_regionkey as varchar) as category2_id, r_name as category2_name,
           case when r_name is not null then substr(r_name, 1, 2) end as category1_id, c1.name as category1_name
    from part
    left join (select distinct p_type as id, lower(p_type) as spu_name from part) s on s.id = p_type
    left join (select distinct p_brand as id, upper(p_brand) as tm_name from part where p_brand <> 'Brand#7') t on t.id = p_brand
    left join nation on n_nationkey = p_size
    left join region on r_regionkey = n_regionkey
    left join (select distinct substr(r_name, 1, 2) as id, lower(substr(r_name, 1, 2)) as name
               from region where r_name <> 'ASIA') c1 on c1.id = substr(r_name, 1, 2)"""


def flat_sku(spark, sf):
    part, nation, region = (table(spark, sf, t) for t in ("part", "nation", "region"))
    short = F.substring("r_name", 1, 2)
    return joins.flatten_sku(
        part.select(
            F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("spu_id"),
            F.col("p_brand").alias("tm_id"), F.col("p_size").cast("string").alias("category3_id"),
        ),
        part.select(F.col("p_type").alias("id"), F.lower("p_type").alias("spu_name")).distinct(),
        part.filter("p_brand <> 'Brand#7'").select(
            F.col("p_brand").alias("id"), F.upper("p_brand").alias("tm_name")
        ).distinct(),
        nation.select(
            F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
            F.col("n_regionkey").cast("string").alias("category2_id"),
        ),
        region.select(
            F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"),
            short.alias("category1_id"),
        ),
        region.filter("r_name <> 'ASIA'").select(short.alias("id"), F.lower(short).alias("name")).distinct(),
    )


def order_lines(spark, sf):
    """Order lines as the wide fact gives them, with province and order total."""
    tables = order_tables(spark, sf)
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("_cust"), F.col("c_nationkey").cast("string").alias("_nation")
    )
    orders = tables["oi"].select(F.col("id").alias("_order"), "user_id", "original_total_amount")
    owned = orders.join(customer, orders["user_id"] == customer["_cust"])
    lines = tables["od"].withColumnRenamed("id", "order_detail_id")
    return lines.join(owned, lines["order_id"] == owned["_order"]).select(
        "order_detail_id", "order_id", "sku_id", "sku_name", "create_time", "original_total_amount",
        "split_total_amount", "split_activity_amount", "split_coupon_amount", "source_id",
        F.col("_nation").alias("province_id"),
    )


# The first of the lines with one id: by time, then by the columns at hand.
ROW_ORDER = ["create_time", "sku_id", "split_total_amount", "source_id", "split_coupon_amount"]
LINES_SQL = f"""
    select * from (
        select {LINE_ID} as order_detail_id, cast(l_orderkey as varchar) as order_id,
               cast(l_partkey as varchar) as sku_id, l_shipdate as rt,
               cast(l_suppkey as varchar) as source_id,
               cast(o_totalprice as decimal(18,2)) as original,
               cast(l_extendedprice as decimal(18,2)) as amount,
               case when l_returnflag = 'R' then cast(l_tax * 100 as decimal(18,2)) end as coupon,
               cast(c_nationkey as varchar) as province_id
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)
    qualify row_number() over (partition by order_detail_id
        order by rt, sku_id, cast(amount as varchar), source_id, cast(coupon as varchar) nulls first) = 1"""


@query("sku_order_window", f"""
    with s as (
        select {BUCKET.format("'10 seconds'", 'rt')} as w, sku_id,
               cast(sum(original) as double) as original_amount, cast(0 as double) as activity_amount,
               cast(sum(coalesce(coupon, 0)) as double) as coupon_amount,
               cast(sum(amount) as double) as order_amount
        from ({LINES_SQL}) group by w, sku_id)
    select {STT.format("'10 seconds'")}, d.*, concat('sku ', sku_id) as sku_name,
           strftime(w, '%Y-%m-%d') as cur_date, original_amount, activity_amount, coupon_amount, order_amount
    from s join ({SKU_DIM_SQL}) d using (sku_id)""")
def sku_order_window(spark, sf):
    result = jobs.sku_summary(order_lines(spark, sf), flat_sku(spark, sf), ROW_ORDER)
    return _amounts(result, "original_amount", "activity_amount", "coupon_amount", "order_amount")


@query("province_order_window", f"""
    with s as (
        select {BUCKET.format("'3 hours'", 'rt')} as w, province_id,
               strftime(cast(min(rt) as date), '%Y-%m-%d') as cur_date,
               count(distinct order_id) as order_count, cast(sum(amount) as double) as order_amount
        from ({LINES_SQL}) group by w, province_id)
    select {STT.format("'3 hours'")}, province_id, n_name as province_name, cur_date, order_count, order_amount
    from s left join nation on cast(n_nationkey as varchar) = province_id""")
def province_order_window(spark, sf):
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")
    )
    return _amounts(jobs.province_summary(order_lines(spark, sf), nation, ROW_ORDER), "order_amount")
