"""Queries: routing by configuration, snapshots kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.maps import put_keys
from tidemark.operators import changes, routing
from tidemark.plans import dimensions, facts as jobs
from workload.inputs import CONFIG_SQL, ROUTED_SQL, config, routed_log, table
from workload.registry import query

# Changes to the routing table, one per supplier.
CHANGE = {
    "op": "case when s_acctbal < 1000 then 'd' when s_acctbal < 6000 then 'u' else 'c' end",
    "ts_ms": "s_suppkey",
    "source_table": "concat('nation_', s_nationkey)",
    "old_table": "concat('nation_', case when s_acctbal between 1000 and 3000 then abs(s_nationkey - 1) else s_nationkey end)",
    "sink_columns": "concat('id,c', s_suppkey)",
    "sink_type": "case when s_acctbal > 9000 then 'dim' else 'dwd' end",
}
CHANGE_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in CHANGE.items()) + " from supplier"


def config_changes(spark, sf):
    rows = table(spark, sf, "supplier").select(*[F.expr(e).alias(n) for n, e in CHANGE.items()])

    def image(source):
        return F.struct(
            F.col(source).alias("source_table"), F.lit("insert").alias("source_type"),
            F.concat(F.lit("dwd_"), F.col(source)).alias("sink_table"), "sink_type",
            "sink_columns", F.lit("id").alias("sink_row_key"),
        )

    raw = rows.select(F.to_json(F.struct(
        "op", "ts_ms",
        F.when(F.col("op") != "c", image("old_table")).alias("before"),
        F.when(F.col("op") != "d", image("source_table")).alias("after"),
    )).alias("value"))
    return routing.read_config_changes(raw)[0]


@query("config_change_apply", f"""
    with c as ({CHANGE_SQL}),
    e as (select case when op = 'd' then old_table else source_table end as source_table, 'insert' as source_type,
                 op, ts_ms, sink_columns, sink_type from c where sink_type = 'dwd'
          union all
          select old_table, 'insert', 'd', ts_ms, null, sink_type from c
          where sink_type = 'dwd' and op = 'u' and old_table <> source_table),
    n as (select * from e qualify row_number() over (partition by source_table, source_type
              order by ts_ms desc, case when sink_columns is null then 0 else 1 end desc) = 1)
    select source_table, source_type, sink_table, sink_columns from ({CONFIG_SQL}) s
    where sink_type = 'dwd' and not exists (select 1 from n where n.source_table = s.source_table and n.source_type = s.source_type)
    union all
    select source_table, source_type, concat('dwd_', source_table), sink_columns from n where op <> 'd'""")
def config_change_apply(spark, sf):
    return routing.apply_config(config(spark, sf), config_changes(spark, sf), "dwd").select(
        "source_table", "source_type", "sink_table", "sink_columns"
    )


@query("config_dim_filter", f"""
    select l."table", l.type, c.sink_table, c.sink_extend, c.sink_row_key as row_key_column, c.sink_family as family,
           cast(o_orderkey as varchar) as id,
           case when c.sink_columns like '%user_id%' then cast(o_custkey as varchar) end as user_id,
           case when c.sink_columns like '%total_amount%' then total_amount end as total_amount
    from ({ROUTED_SQL}) l join ({CONFIG_SQL}) c on c.source_table = l."table"
    where c.sink_type = 'dim' and l.type not in ('bootstrap-start', 'bootstrap-complete')""")
def config_dim_filter(spark, sf):
    routed = routing.dim_route(routed_log(spark, sf), config(spark, sf), "shop")
    data = F.col("data")
    return routed.select(
        "table", "type", "sink_table", "sink_extend", "row_key_column", "family",
        data["id"].alias("id"), data["user_id"].alias("user_id"), data["total_amount"].alias("total_amount"),
    )


FACT_SQL = f"""
    select l."table", l.type, c.sink_table as sink_topic, cast(o_orderkey as varchar) as id,
           case when c.sink_columns like '%user_id%' then cast(o_custkey as varchar) end as user_id,
           case when c.sink_columns like '%total_amount%' then total_amount end as total_amount
    from ({ROUTED_SQL}) l join ({CONFIG_SQL}) c on c.source_table = l."table" and c.source_type = l.type
    where c.sink_type = 'dwd'"""


@query("config_fact_filter", FACT_SQL)
def config_fact_filter(spark, sf):
    data = F.col("data")
    return routing.dwd_route(routed_log(spark, sf), config(spark, sf), "shop").select(
        "table", "type", "sink_topic",
        data["id"].alias("id"), data["user_id"].alias("user_id"), data["total_amount"].alias("total_amount"),
    )


@query("config_route", f"""
    select sink_topic as topic, '{{"id":"' || id || '"' || coalesce(',"user_id":"' || user_id || '"', '')
           || coalesce(',"total_amount":"' || total_amount || '"', '') || '}}' as value
    from ({FACT_SQL})""")
def config_route(spark, sf):
    return jobs.routed_facts(routed_log(spark, sf), config(spark, sf))


# --- snapshots ----------------------------------------------------------------

@query("upsert_latest", """
    with n as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
    select c_custkey as user_id, cast(-1 as bigint) as order_id, c_mktsegment as note from customer
    where not exists (select 1 from n where o_custkey = c_custkey)
    union all
    select o_custkey, o_orderkey, o_orderpriority from n where o_orderstatus <> 'P'""")
def upsert_latest(spark, sf):
    target = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit(-1).cast("bigint").alias("order_id"), F.col("c_mktsegment").alias("note")
    )
    latest = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("order_id"),
        F.col("o_orderpriority").alias("note"), "o_orderdate", "o_orderstatus",
    )
    return changes.upsert_latest(
        target, latest, ["user_id"], ["o_orderdate", "order_id"], F.col("o_orderstatus") == "P"
    )


# Orders as changes to a customer table: some fields null, some orders are deletes.
DIM_CHANGE = {
    "rowkey": "case when o_orderpriority = '3-MEDIUM' then -o_custkey else o_custkey end",  # some are not in the table yet
    "status": "case when o_orderpriority <> '1-URGENT' then o_orderstatus end",
    "priority": "case when o_totalprice > 250000 then o_orderpriority end",
    "gone": "o_orderstatus = 'F' and o_orderpriority = '5-LOW'",
    "o_orderdate": "o_orderdate",
    "o_orderkey": "o_orderkey",
}
DIM_CHANGE_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in DIM_CHANGE.items()) + " from orders"
FOLDED_SQL = f"""
    with c as ({DIM_CHANGE_SQL}),
    d as (select rowkey, max((o_orderdate, o_orderkey)) as wiped from c where gone group by rowkey),
    p as (select c.*, d.wiped from c left join d using (rowkey)
          where not gone and (wiped is null or (o_orderdate, o_orderkey) > wiped)),
    f as (select rowkey,
                 arg_max(status, (o_orderdate, o_orderkey)) filter (where status is not null) as status,
                 arg_max(priority, (o_orderdate, o_orderkey)) filter (where priority is not null) as priority
          from p group by rowkey)"""


def dim_changes(spark, sf):
    return table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in DIM_CHANGE.items()])


@query("scd1_null_preserving_merge", f"""
    {FOLDED_SQL},
    s as (select c_custkey as rowkey, 'N' as status, c_mktsegment as priority from customer)
    select coalesce(s.rowkey, f.rowkey) as rowkey,
           coalesce(f.status, case when d.rowkey is null then s.status end) as status,
           coalesce(f.priority, case when d.rowkey is null then s.priority end) as priority
    from s full join f on f.rowkey = s.rowkey left join d on d.rowkey = coalesce(s.rowkey, f.rowkey)
    where f.rowkey is not null or d.rowkey is null""")
def scd1_null_preserving_merge(spark, sf):
    snapshot = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("rowkey"), F.lit("N").alias("status"), F.col("c_mktsegment").alias("priority")
    )
    return changes.scd1_merge(
        dim_changes(spark, sf), "rowkey", ["status", "priority"], ["o_orderdate", "o_orderkey"],
        F.col("gone"), snapshot,
    )


@query("scd1_delete", f"{FOLDED_SQL} select rowkey, status, priority from f")
def scd1_delete(spark, sf):
    return changes.scd1_merge(
        dim_changes(spark, sf), "rowkey", ["status", "priority"], ["o_orderdate", "o_orderkey"], F.col("gone")
    )


# Each routed record as a put, a second put that may leave a value out, and for some keys a delete before or after them.
PUTS_SQL = f"""
    with r as (select o_orderkey as k, total_amount as v from ({ROUTED_SQL}) where "table" = 'nation_0' and type <> 'bootstrap-start'),
    c as (select k, k % 5 as ts, 1 as xid, 1 as xoffset, v, false as gone from r
          union all select k, k % 5, k % 3, 2, case when k % 2 = 1 then '9' || v end, false from r
          union all select k, k % 5 + case when k % 4 = 0 then 1 else -1 end, 0, 0, null, true from r where k % 3 = 0),
    d as (select k, max((ts, xid, xoffset)) as wiped from c where gone group by k)"""


@query("dimension_upkeep", f"""
    {PUTS_SQL}
    select cast(k as varchar) as rowkey, arg_max(v, (ts, xid, xoffset)) filter (where v is not null) as total_amount
    from c left join d using (k) where not gone and (wiped is null or (ts, xid, xoffset) > wiped) group by k""")
def dimension_upkeep(spark, sf):
    """From the change log through the routing table to one dimension table; order values and deletes decide."""
    log = routed_log(spark, sf).withColumn("k", F.col("data")["id"].cast("bigint"))
    sound = log.filter(~F.col("type").isin(*S.NOT_ROUTED_TYPES))

    def at(rows, **values):
        return rows.withColumns({n: F.expr(e).cast("bigint") for n, e in values.items()}).drop("k")

    second = put_keys("data", total_amount=F.when(F.col("k") % 2 == 1, F.concat(F.lit("9"), F.col("data")["total_amount"])))
    changed = (
        at(log, ts="k % 5", xid="1", xoffset="1")
        .unionByName(at(sound.withColumn("data", second), ts="k % 5", xid="k % 3", xoffset="2"))
        .unionByName(at(sound.filter("k % 3 = 0").withColumn("type", F.lit("delete")),
                        ts="k % 5 + case when k % 4 = 0 then 1 else -1 end", xid="0", xoffset="0")))
    routed = dimensions.routed_changes(changed, config(spark, sf), "shop")
    return dimensions.dimension_after(routed, "dim_nation_0", ["total_amount"])
