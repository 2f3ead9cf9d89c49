"""Library inputs derived from the test tables.

The test tables are no shop, so events stand for page views, orders and line
items for the order tables, nations for the routing table, and so on.  The
derivations are SQL texts that both engines understand; ``sql`` queries build
their side from the same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"

# Page views out of events.
VIEW = {
    "event_id": "event_id",
    "mid": "concat('mid_', user_id)",
    "uid": "case when event_type <> 'error' then concat('u', user_id) end",
    "is_new": f"case when {K} < 50 then '1' else '0' end",
    "ch": f"case when {K} < 33 then 'web' when {K} < 66 then 'app' else 'mini' end",
    "ar": "substr(concat('ar', user_id), 1, 3)",
    "vc": "case when value < 10 then 'v1' else 'v2' end",
    "page_id": "case event_type when 'view' then 'home' when 'click' then 'good_detail' "
               "when 'purchase' then 'trade' when 'error' then 'good_list' else 'mine' end",
    "last_page_id": f"case when {K} < 25 then null when {K} < 50 then 'search' "
                    f"when {K} < 75 then 'login' else 'home' end",
    "item": f"case when {K} < 60 then concat('Red-widget ', event_type) end",
    "item_type": f"case when {K} < 45 then 'keyword' else 'sku_id' end",
    "during_time": "cast(round(value * 100) as bigint)",
    "event_type": "event_type",
    "k": K,
    "user_id": "user_id",
}
VIEW_SQL = "select ts as rt, " + ", ".join(f"{e} as {n}" for n, e in VIEW.items()) + " from events"

# Which log records are broken, empty, errors, starts; which carry arrays.
BROKEN = "event_type = 'error' and k >= 50"
EMPTY = "event_type = 'purchase' and k < 5"
ERR = "event_type = 'error' or (event_type in ('signup', 'click') and k >= 90)"
START = "event_type = 'signup'"
DISPLAYS = "event_type in ('view', 'click') and k >= 10"
ACTIONS = "event_type = 'click'"
# Log records without a visitor, with a quoted number, with a field nobody asked for.
NOBODY = "k = 7"
QUOTED = "k % 2 = 0"
EXTRA = "case when k % 3 = 0 then cast(k as int) end"
SOUND = f"not ({BROKEN}) and not ({EMPTY})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; zone-less times become instants, which event time needs."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for field in df.schema:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def as_source(df: DataFrame) -> DataFrame:
    """The same rows as if a source had delivered them.

    Keeps the optimizer from copying the (long) deriving expressions into every
    filter and column above.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def views(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("ts").alias("rt"), *[F.expr(e).alias(n) for n, e in VIEW.items()]
    )


def log_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Raw application log: JSON records, some cut off, some empty, in as many partitions as there are cores, like a topic."""
    start, err = F.expr(START), F.expr(ERR)
    display = [
        F.struct(
            F.col("k").cast("string").alias("item"), F.lit("sku_id").alias("item_type"),
            F.lit(n + 10).alias("pos_id"), F.lit(n).alias("pos_seq"), F.lit("query").alias("display_type"),
        )
        for n in (0, 1)
    ]
    record = F.struct(
        F.struct(
            "ar", "ch", "is_new", F.expr(f"case when not ({NOBODY}) then mid end").alias("mid"),
            F.col("event_id").cast("string").alias("sid"), "uid", "vc", F.concat(F.lit("x"), "k").alias("x"),
        ).alias("common"),
        F.when(~start, F.struct(
            "page_id", "last_page_id", "item", "item_type",
            F.when(F.expr(QUOTED), F.col("during_time").cast("string").cast("variant"))
            .otherwise(F.col("during_time").cast("variant")).alias("during_time"),
            F.concat(F.lit("r"), "k").alias("refer"),
        )).alias("page"),
        F.when(F.expr(DISPLAYS), F.array(*display)).alias("displays"),
        F.when(F.expr(ACTIONS), F.array(F.struct(
            F.lit("cart_add").alias("action_id"), F.col("k").cast("string").alias("item"),
            F.lit(0).alias("ts"),
        ))).alias("actions"),
        F.when(start, F.struct(F.lit("icon").alias("entry"), F.col("k").alias("loading_time"))).alias("start"),
        F.when(err, F.struct(F.col("k").alias("error_code"))).alias("err"),
        F.when(F.expr(f"{EXTRA} is not null"), F.struct(F.col("k").alias("n"))).alias("extra"),
        F.unix_millis("rt").alias("ts"),
    )
    events = views(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    rows = as_source(as_source(events).select(
        F.to_json(record).alias("text"), F.expr(BROKEN).alias("broken"), F.expr(EMPTY).alias("empty"),
    ))
    return as_source(rows.select(
        F.when(F.col("broken"), F.left("text", F.lit(20))).when(~F.col("empty"), F.col("text")).alias("value")
    ))


# Order changes: one insert per order, one update per order that left status O.
ORDER_STATUS = "case o_orderstatus when 'F' then '1003' when 'P' then '1002' else '1001' end"
MONEY_TEXT = "cast(cast({} as decimal(18,2)) as {})"


def _data(**entries):
    parts = [x for n, e in entries.items() for x in (F.lit(n), e.cast("string"))]
    return F.create_map(*parts)


def _envelope(table_name, kind, ts, data, old=None):
    return F.to_json(F.struct(
        F.lit("shop").alias("database"), table_name.alias("table"), kind.alias("type"),
        ts.alias("ts"), data.alias("data"),
        *([old.alias("old")] if old is not None else []),
    ))


def cdc_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Raw change log of the orders table."""
    orders = table(spark, sf, "orders")
    at = F.unix_seconds("o_orderdate")
    when = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")

    def data(status):
        return _data(
            id=F.col("o_orderkey"), user_id=F.col("o_custkey"), order_status=status,
            total_amount=F.col("o_totalprice").cast("decimal(18,2)"), create_time=when,
        )

    inserts = orders.select(
        _envelope(F.lit("order_info"), F.lit("insert"), at, data(F.lit("1001"))).alias("value")
    )
    old = F.when(
        F.col("o_orderpriority") == "5-LOW", F.create_map(F.lit("tracking_no"), F.lit("x"))
    ).otherwise(F.create_map(F.lit("order_status"), F.lit("1001")))
    updates = orders.filter(F.col("o_orderstatus") != "O").select(
        _envelope(F.lit("order_info"), F.lit("update"), at + 60, data(F.expr(ORDER_STATUS)), old).alias("value")
    )
    return as_source(inserts.unionByName(updates))


# The same change log for DuckDB, as columns.
CDC_SQL = f"""
    select 'shop' as database, 'order_info' as "table", 'insert' as type,
           cast(epoch(o_orderdate) as bigint) as ts, o_orderkey, o_custkey,
           '1001' as order_status, o_totalprice, o_orderdate, null as old_status,
           o_orderpriority
    from orders
    union all
    select 'shop', 'order_info', 'update', cast(epoch(o_orderdate) as bigint) + 60, o_orderkey,
           o_custkey, {ORDER_STATUS}, o_totalprice, o_orderdate,
           case when o_orderpriority <> '5-LOW' then '1001' end, o_orderpriority
    from orders where o_orderstatus <> 'O'
"""

LINE_ID = "concat(l_orderkey, '-', l_linenumber)"
# Total order of line items that share a line id (whole rows are distinct).
LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus",
]


def null_text(name: str):
    return F.lit(None).cast("string").alias(name)


def order_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Typed order tables as the change log would give them."""
    from tidemark import schemas as S
    from tidemark.operators.firsts import dedup_within

    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    filled = {
        "id": F.col("o_orderkey").cast("string"),
        "total_amount": F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        "order_status": F.expr(ORDER_STATUS),
        "user_id": F.col("o_custkey").cast("string"),
        "create_time": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        "order_comment": F.col("o_orderpriority"),
        "original_total_amount": F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
    }

    def pick(df, columns, values, *keep):
        return df.select(
            *[values[c].alias(c) if c in values else null_text(c) for c in columns], *keep
        )

    line = {
        "id": F.expr(LINE_ID),
        "order_id": F.col("l_orderkey").cast("string"),
        "sku_id": F.col("l_partkey").cast("string"),
        "sku_name": F.concat(F.lit("sku "), F.col("l_partkey").cast("string")),
        "order_price": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        "sku_num": F.col("l_quantity").cast("int").cast("string"),
        "create_time": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"),
        "source_type": F.col("l_returnflag"),
        "source_id": F.col("l_suppkey").cast("string"),
        "split_total_amount": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        "split_coupon_amount": F.when(
            F.col("l_returnflag") == "R", (F.col("l_tax") * 100).cast("decimal(18,2)").cast("string")
        ),
    }

    def reduction(condition, columns, **more):
        # By the line's id as text, which the wide fact joins by: its rows lie and are sorted as the join asks.
        once = dedup_within(lines.filter(condition).withColumn("_line", F.expr(LINE_ID)), ["_line"], LINE_ORDER)
        values = {
            "id": F.concat(F.lit("r"), F.col("_line")), "order_detail_id": F.col("_line"),
            "order_id": line["order_id"], "sku_id": line["sku_id"], **more,
        }
        return pick(once, columns, values)

    return {
        "oi": pick(orders, S.ORDER_INFO, filled, F.col("o_orderdate").alias("rt")),
        "od": pick(lines, S.ORDER_DETAIL, line),
        "oa": reduction(
            "l_discount > 0.05", S.ORDER_DETAIL_ACTIVITY,
            activity_id=F.col("l_suppkey").cast("string"), activity_rule_id=F.col("l_linestatus"),
        ),
        "oc": reduction(
            "l_returnflag = 'R'", S.ORDER_DETAIL_COUPON,
            coupon_id=F.col("l_suppkey").cast("string"), coupon_use_id=F.col("l_linestatus"),
        ),
    }


# Routing table out of nations.
CONFIG = {
    "source_table": "lower(n_name)",
    "source_type": "case when n_regionkey < 2 then 'ALL' when n_regionkey < 4 then 'insert' else 'update' end",
    "sink_table": "concat(case when n_regionkey < 2 then 'dim_' else 'dwd_' end, lower(n_name))",
    "sink_type": "case when n_regionkey < 2 then 'dim' else 'dwd' end",
    "sink_family": "'info'",
    "sink_columns": "case when n_regionkey in (0, 2) then 'id,total_amount' else 'id, user_id' end",
    "sink_row_key": "'id'",
    "sink_extend": "case when n_regionkey = 1 then '00|,01|,02|' end",
}
CONFIG_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in CONFIG.items()) + " from nation"

# Change-log records to be routed: an order under its customer's nation.
ROUTED_TYPE = "case o_orderstatus when 'O' then 'insert' when 'F' then 'update' else 'bootstrap-start' end"
ROUTED_SQL = f"""
    select concat('nation_', c_nationkey) as "table", {ROUTED_TYPE} as type, o_orderkey,
           o_custkey, cast(cast(o_totalprice as decimal(18,2)) as varchar) as total_amount
    from orders join customer on o_custkey = c_custkey
"""


def config(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(*[F.expr(e).alias(n) for n, e in CONFIG.items()])


def routed_log(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("shop").alias("database"),
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("table"),
        F.expr(ROUTED_TYPE).alias("type"),
        _data(
            id=F.col("o_orderkey"), user_id=F.col("o_custkey"),
            total_amount=F.col("o_totalprice").cast("decimal(18,2)"),
        ).alias("data"),
    )
