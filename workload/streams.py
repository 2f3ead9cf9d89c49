"""Queries that run streams and sinks over the test tables and return what they wrote."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import functions as fn, schemas as S
from tidemark.operators import facts
from tidemark.operators.windows import tumble, window_bounds
from tidemark.plans import jobs, summaries as summary_jobs
from tidemark.session import shared_dir, use_rocksdb_state
from tidemark.sinks import append_batch, apply_table_ddl, topic_rows, write_summary, write_topic_files
from tidemark.sinks.tables import read_if_there
from tidemark.sources import read_cdc_log, read_order_detail, read_page_log, read_topic_files
from tidemark.streaming import daily_first_flag_stream, run_stream
from workload.facts import _time_text, _wide_sql
from workload.inputs import CDC_SQL, ROUTED_SQL, SOUND, VIEW_SQL, cdc_texts, config, log_texts, order_tables, routed_log, table, views
from workload.registry import SQL, query
from workload.windows import BUCKET, STT, carts


def topic_of(texts: DataFrame, name: str) -> DataFrame:
    """``value`` texts written as a topic's files, compressed as a broker keeps them, and opened as a stream."""
    path = shared_dir(texts.sparkSession, name)
    texts.filter(F.col("value").isNotNull()).select("value").write.option("compression", "gzip").text(path)
    return read_topic_files(texts.sparkSession, path)


def run_to_end(stream, spark: SparkSession, sink=None) -> None:
    """Run a stream over all that is there."""
    query_ = run_stream(stream, shared_dir(spark, "checkpoint"), sink, None)
    query_.awaitTermination()
    if query_.exception() is not None:
        raise query_.exception()


@query("topic_window_stream", f"""
    with v as (select make_timestamp((epoch_us(rt) // 1000) * 1000) as rt from ({VIEW_SQL}) where {SOUND})
    select {STT.format("'10 minutes'")}, count(*) as n from (select {BUCKET.format("'10 minutes'", 'rt')} as w from v)
    where w + interval 10 minute <= (select max(rt) from v) - interval 2 second group by w""")
def topic_window_stream(spark, sf):
    """Page records from a topic's files, with event time and watermark, counted in windows that have closed."""
    pages = read_page_log(topic_of(log_texts(spark, sf), "topic"))
    out = shared_dir(spark, "windows")
    counted = window_bounds(tumble(pages, "rt", "10 minutes", aggs=[F.count("*").alias("n")]))
    run_to_end(counted, spark, append_batch(out))
    return spark.read.parquet(out).select("stt", "edt", "n")


@query("topic_files_sink", "select concat('t_', event_type) as topic, event_id, value from events")
def topic_files_sink(spark, sf):
    """Rows as JSON to the topic each one names, by a stream, and read back."""
    rows = fn.to_json_rows(table(spark, sf, "events").select("event_id", "event_type", "value"))
    stream = topic_of(rows, "events")
    out = shared_dir(spark, "topics")
    named = topic_rows(stream, F.concat(F.lit("t_"), F.get_json_object("value", "$.event_type")), F.col("value"))
    run_to_end(write_topic_files(named, out), spark)
    back = fn.parsed(spark.read.text(out), "event_id BIGINT, value DOUBLE")
    return back.select("topic", "event_id", "value")


@query("order_detail_topic", _wide_sql())
def order_detail_topic(spark, sf):
    """The wide fact through its topic: rows as JSON, read as a stream with event time."""
    wide = facts.order_detail_wide(**order_tables(spark, sf))
    stream = read_order_detail(topic_of(fn.to_json_rows(wide.withColumn("rt", F.col("rt").cast("timestamp"))), "details"))
    out = shared_dir(spark, "details")
    run_to_end(stream, spark, append_batch(out))
    return _time_text(spark.read.parquet(out).select(*S.order_detail_columns("rt")))


@query("summary_sink", SQL["cart_add_uu_window"])
def summary_sink(spark, sf):
    """A summary written by its sink, the batch twice, and read back."""
    out = shared_dir(spark, "summary")
    write, summary = write_summary(out), summary_jobs.cart_summary(carts(spark, sf))
    write(summary, 0)
    write(summary, 0)
    return spark.read.json(f"{out}/batch_id=0").select(*summary.columns)


@query("published_dimension", f"""
    select cast(o_orderkey as varchar) as id, total_amount from ({ROUTED_SQL})
    where "table" = 'nation_0' and type not in ('bootstrap-start', 'bootstrap-complete')""")
def published_dimension(spark, sf):
    """A dimension table created by its rule, kept from the change log and put into the catalog."""
    root = shared_dir(spark, "dims")
    database = root.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}/catalog'")
    rules = config(spark, sf).filter("source_table = 'nation_0'")
    apply_table_ddl(spark, rules.selectExpr("'c' as op", "1L as ts_ms", "*"), database=database)
    dims = jobs.DimensionTables(spark, root, lambda: config(spark, sf), "shop")
    log = routed_log(spark, sf).withColumns({n: F.lit(1).cast("bigint") for n in ("ts", "xid", "xoffset")})
    dims.write(log, 0)
    dims.table("dim_nation_0").rewrite()
    jobs.publish_dimension(dims, "dim_nation_0", database)
    return spark.table(f"{database}.dim_nation_0").select("id", "total_amount")


@query("stamped_log", f"select cast(o_orderkey as varchar) as id, type, true as stamped from ({CDC_SQL})")
def stamped_log(spark, sf):
    """Change records carry the time they were worked on."""
    log = read_cdc_log(cdc_texts(spark, sf))
    now = F.current_timestamp()
    return log.select(F.col("data")["id"].alias("id"), "type", F.col("pt").between(now - F.expr("interval 1 hour"), now).alias("stamped"))


@query("daily_first_ttl_stream", f"""
    select event_id, cast(case when row_number() over (partition by mid, cast(rt as date) order by rt, event_id) = 1
                          then 1 else 0 end as bigint) as uv
    from ({VIEW_SQL})""")
def daily_first_ttl_stream(spark, sf):
    """First of the day on a stream whose state has a lifetime; such a query goes on, so it is stopped when all is worked off."""
    use_rocksdb_state(spark)
    path, out = shared_dir(spark, "views"), shared_dir(spark, "flags")
    rows = views(spark, sf).select("event_id", "mid", "rt")
    # All there is at the start makes one micro-batch: some files, written and read by all cores.
    rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000_000).parquet(path).withWatermark("rt", "2 seconds")
    running = run_stream(daily_first_flag_stream(stream, "mid", "rt"), shared_dir(spark, "checkpoint"), append_batch(out), "1 second")
    expected, deadline = rows.count(), time.monotonic() + 600
    try:
        while running.isActive:
            written = read_if_there(spark, out)
            if written is not None and written.count() >= expected:
                break
            if time.monotonic() > deadline:
                raise TimeoutError("the stream did not work off its input")
            time.sleep(0.5)
    finally:
        running.stop()
    return spark.read.parquet(out).select("event_id", "uv")
