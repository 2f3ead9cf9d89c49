"""Streams against their stored-table forms."""

import datetime as dt
import glob
import json
import os
import time

import pytest
from pyspark.sql import SparkSession, functions as F

from tidemark import functions as fn, schemas as S
from tidemark.operators import facts, firsts, joins, summaries, traffic
from tidemark.operators.windows import tumble, window_bounds
from tidemark.operators.routing import read_config_changes
from tidemark.plans import facts as stored_facts, firsts as kept, jobs, streams, summaries as stored
from tidemark.session import shared_dir, use_rocksdb_state
from tidemark.sinks import (
    KeyedTable, append_batch, apply_table_ddl, debug_stream, topic_rows, write_json_topic,
    write_summary, write_topic, write_topic_files,
)
from tidemark.sources import read_cdc_log, read_json_topic, read_order_detail, read_page_log, read_topic_files
from tidemark.streaming import (
    RecordCounts, daily_first_flag_stream, repair_is_new_stream, run_stream, with_event_time,
)
from workload.inputs import VIEW, log_texts, order_tables, table, views


def finish(stream, sink=None):
    """Run a stream over what is there and return the folder its batches were written to."""
    spark = stream.sparkSession
    out = shared_dir(spark, "out")
    query = run_stream(stream, shared_dir(spark, "checkpoint"), sink or append_batch(out), None)
    query.awaitTermination(180)
    assert not query.isActive and query.exception() is None
    return spark.read.parquet(out).drop("batch_id") if sink is None else None


def stream_of(df, delay="2 seconds", time="rt"):
    """A stored table written out and read back as a stream with event time."""
    path = shared_dir(df.sparkSession, "input")
    df.write.parquet(path)
    stream = df.sparkSession.readStream.schema(df.schema).parquet(path)
    return stream.withWatermark(time, delay) if delay else stream


def run_until(query, path, rows, seconds=60):
    """Let a query without an end run until it has written so many rows, then stop it."""
    spark, deadline = SparkSession.active(), time.monotonic() + seconds
    try:
        while time.monotonic() < deadline and query.exception() is None:
            if os.path.isdir(path) and any(glob.glob(f"{path}/*/_SUCCESS")):
                if spark.read.parquet(path).count() >= rows:
                    return
            time.sleep(0.5)
        raise AssertionError(f"{rows} rows not written in time")
    finally:
        query.stop()


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def assert_same_but_open_windows(streamed, batch, newest, delay=2):
    """Equal, except for windows the watermark has not passed."""
    closed = (newest - dt.timedelta(seconds=delay)).strftime("%Y-%m-%d %H:%M:%S")
    done = batch.filter(F.col("edt") <= closed)
    assert rows_of(streamed, *batch.columns) == rows_of(done, *batch.columns)
    assert batch.count() - done.count() <= 3


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    use_rocksdb_state(spark)
    return views(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def newest(pages):
    return pages.agg(F.max("rt").alias("m")).first().m


@pytest.fixture(scope="module")
def page_stream(pages):
    path = shared_dir(pages.sparkSession, "pages")
    pages.coalesce(1).write.parquet(path)

    def open_stream():
        return pages.sparkSession.readStream.schema(pages.schema).parquet(path).withWatermark("rt", "2 seconds")

    return open_stream


# --- summaries ----------------------------------------------------------------

def last_of(df, ts="rt"):
    return df.agg(F.max(ts).alias("m")).first().m


def test_traffic(pages, page_stream, newest):
    assert_same_but_open_windows(finish(streams.traffic_summary(page_stream())), stored.traffic_summary(pages), newest)


def test_home_detail(pages, page_stream):
    seen = last_of(traffic.pages_of(pages, ["home", "good_detail"]))
    assert_same_but_open_windows(
        finish(streams.home_detail_summary(page_stream())), stored.home_detail_summary(pages), seen
    )


def test_login(pages, page_stream):
    seen = last_of(traffic.login_pages(pages))
    assert_same_but_open_windows(finish(streams.login_summary(page_stream())), stored.login_summary(pages), seen)


def cart_rows(pages):
    return pages.filter("event_type = 'click'").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.date_format("rt", "yyyy-MM-dd HH:mm:ss").alias("create_time"), F.lit(None).cast("string").alias("operate_time"),
    )


def test_cart(pages):
    carts = cart_rows(pages)
    newest = last_of(stored.changed_time(carts))
    assert_same_but_open_windows(finish(streams.cart_summary(stream_of(carts, None))), stored.cart_summary(carts), newest)


def test_order_users(pages):
    orders = cart_rows(pages)
    newest = last_of(stored.changed_time(orders))
    assert_same_but_open_windows(
        finish(streams.order_user_summary(stream_of(orders, None))), stored.order_user_summary(orders), newest
    )


def order_line_rows(pages, repeats=2):
    """Clicks as order lines, each delivered more than once."""
    lines = pages.filter("event_type = 'click'").select(
        F.col("event_id").cast("string").alias("order_detail_id"), F.col("k").cast("string").alias("order_id"),
        F.col("k").cast("string").alias("sku_id"), F.lit("name").alias("sku_name"),
        F.date_format("rt", "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        F.lit("10.00").alias("original_total_amount"), F.lit("9.00").alias("split_total_amount"),
        F.lit(None).cast("string").alias("split_activity_amount"), F.lit("1.00").alias("split_coupon_amount"),
        F.substring("user_id", 1, 1).alias("province_id"),
    )
    return lines.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).drop("_copy")


def test_sku_orders(spark, sf_dir, pages):
    from workload.windows import flat_sku

    lines, flat = order_line_rows(pages), flat_sku(spark, sf_dir)
    newest = last_of(lines.select(F.to_timestamp("create_time").alias("rt")))
    batch = stored.sku_summary(lines, flat, ["rt"])
    out = shared_dir(spark, "skus")
    finish(streams.sku_summary(stream_of(lines, None)), jobs.sku_summary_writer(lambda: flat, append_batch(out)))
    assert_same_but_open_windows(spark.read.parquet(out).drop("batch_id"), batch, newest, 5)


def test_province_orders(spark, pages):
    lines = order_line_rows(pages)
    names = spark.createDataFrame([("1", "One"), ("2", "Two")], "id string, name string")
    newest = last_of(lines.select(F.to_timestamp("create_time").alias("rt")))
    out = shared_dir(spark, "provinces")
    finish(streams.province_summary(stream_of(lines, None)), jobs.province_summary_writer(lambda: names, append_batch(out)))
    assert_same_but_open_windows(
        spark.read.parquet(out).drop("batch_id"), stored.province_summary(lines, names), newest, 5)


def test_keywords_from_raw_records(spark, sf_dir, newest):
    raw = log_texts(spark, sf_dir)
    path = shared_dir(spark, "raw")
    raw.filter(F.col("value").isNotNull()).write.text(path)
    batch = stored.keyword_summary(read_page_log(read_topic_files(spark, path, stream=False)))
    streamed = finish(streams.keyword_summary(read_page_log(read_topic_files(spark, path))))
    # Spark filters before it takes the watermark, so only searches move it.
    searches = stored.search_texts(read_page_log(read_topic_files(spark, path, stream=False)))
    assert_same_but_open_windows(streamed, batch, last_of(searches))


# --- state --------------------------------------------------------------------

def test_repair(pages, page_stream):
    columns = ["event_id", "is_new"]
    streamed = finish(repair_is_new_stream(page_stream(), "mid", "rt", "is_new"))
    assert rows_of(streamed, *columns) == rows_of(traffic.repair_is_new(pages, "mid", "rt", "is_new"), *columns)
    assert streamed.columns == pages.columns


def test_repair_remembers_across_batches(spark):
    use_rocksdb_state(spark)
    path, out = shared_dir(spark, "input"), shared_dir(spark, "out")
    checkpoint = shared_dir(spark, "checkpoint")
    schema = "mid string, is_new string, rt timestamp, n int"
    for batch in ([("a", "1", at(1), 1), ("b", "0", at(1), 2)], [("a", "1", at(2), 3), ("b", "1", at(1), 4), ("c", "1", at(2), 5)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        run_stream(repair_is_new_stream(stream, "mid", "rt", "is_new"), checkpoint, append_batch(out), None).awaitTermination(120)
    assert rows_of(spark.read.parquet(out), "n", "is_new") == [(1, "1"), (2, "0"), (3, "0"), (4, "0"), (5, "1")]


def test_split_to_topic_files(spark, sf_dir):
    """Repair and five-way split on a stream, written to one folder per topic."""
    use_rocksdb_state(spark)
    raw = log_texts(spark, sf_dir).filter(F.col("value").isNotNull())
    path, out = shared_dir(spark, "raw"), shared_dir(spark, "topics")
    raw.write.text(path)
    run_stream(
        write_topic_files(streams.log_topics(read_topic_files(spark, path)), out), shared_dir(spark, "checkpoint"), None, None
    ).awaitTermination(120)
    expected = stored_facts.log_topics(raw)
    written = spark.read.text(out).select("topic", "value")
    def canon(df):
        return sorted((r.topic, r.value if r.topic == "dwd_traffic_bad" else json.dumps(json.loads(r.value), sort_keys=True)) for r in df.collect())

    assert canon(written) == canon(expected)
    assert set(os.path.basename(p) for p in glob.glob(f"{out}/topic=*")) == {f"topic={t}" for t in S.LOG_TOPICS.values()}


def test_log_split_batch_by_batch(spark):
    """With two times per visitor kept, batches in order give what one run over everything gives; a batch may come again."""
    import random

    rng, texts = random.Random(9), []
    for k in range(600):
        mid = "hot" if k % 2 else f"m{rng.randint(0, 60)}"
        day = k // 150
        shown = ',"displays":[{"item":"1"}]' if k % 5 == 0 else ""
        texts.append((k, f'{{"common":{{"mid":"{mid}","is_new":"{rng.choice("011")}"}},"page":{{"page_id":"p"}}{shown},"ts":{1_704_067_200_000 + day * 86_400_000 + k}}}'))
    texts += [(k, bad) for k, bad in ((10, "{cut"), (200, '{"common":{"is_new":"1"},"ts":7}'))]
    expected = stored_facts.log_topics(spark.createDataFrame([(t,) for _, t in texts], "value string"))
    log, out = kept.VisitorLog(spark, shared_dir(spark, "visitors")), shared_dir(spark, "out")
    write = kept.batch_writer(log, append_batch(out))
    def batch(n):
        rows = [(t,) for k, t in texts if k // 120 == n]
        return spark.createDataFrame(rows, "value string").repartition(4)

    for n in (0, 1, 1, 2, 3):
        write(batch(n), n)
    log.table.rewrite()
    log.table.write(spark.createDataFrame([], "_visitor string, _first_new timestamp, _first_old timestamp"), 98)
    write(batch(4), 4)
    def canon(df):
        return sorted((r.topic, r.value if r.topic == "dwd_traffic_bad" else json.dumps(json.loads(r.value), sort_keys=True)) for r in df.collect())

    assert canon(spark.read.parquet(out).select("topic", "value")) == canon(expected)
    # Half of a batch is one visitor's: its records stay in the four tasks they came in.
    rows = log.run(batch(2), 2).groupBy(F.spark_partition_id()).count().collect()
    counts = sorted(r["count"] for r in rows)
    assert len(counts) == 4 and counts[-1] < 2 * counts[1], counts


def test_day_flags_batch_by_batch(spark):
    """Days in any order, nulls, ties and a batch that comes again: one first per key and day."""
    path = shared_dir(spark, "flags")
    flags = kept.DayFlags(spark, path, "mid", "rt", ["n"])
    schema = "mid string, rt timestamp, n int"
    batches = [
        [("a", at(1, 5), 1), ("a", at(1, 5), 2), ("a", at(2), 3), (None, at(1), 4)],
        [("a", at(1, 1), 5), ("b", at(1), 6), ("a", at(3), 7), (None, at(3), 8)],
        [("b", at(1, 2), 9), ("b", at(2), 10), ("a", at(2, 1), 11), ("c", None, 12)],
    ]
    got = []
    for k in (0, 1, 1, 2):
        got.append(rows_of(flags.run(spark.createDataFrame(batches[k], schema), k), "n", "uv"))
        if k == 1:
            flags.table.rewrite(before=1)
    assert got[1] == got[2] and got[0] + got[1] + got[3] == [
        (1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 1), (7, 1), (8, 0), (9, 0), (10, 1), (11, 0), (12, 0)]
    assert {os.path.basename(p) for p in glob.glob(f"{path}/table/*=*")} == {"_part=p2024-01-01", "_part=p2024-01-02"}


def test_ttl_state(pages, page_stream):
    """State with a wall-clock lifetime: the query goes on by itself, so it is stopped."""
    spark = pages.sparkSession
    out = shared_dir(spark, "out")
    stream = daily_first_flag_stream(page_stream(), "mid", "rt")
    query = run_stream(stream, shared_dir(spark, "checkpoint"), append_batch(out), "1 second")
    run_until(query, out, pages.count())
    columns = ["event_id", "uv"]
    batch = firsts.flag_first_of_day(pages, "mid", "rt", ["event_id"])
    assert rows_of(spark.read.parquet(out), *columns) == rows_of(batch, *columns)


def test_ttl_expires(spark):
    """A key forgotten after its lifetime is a first one again, on the same day."""
    use_rocksdb_state(spark)
    path, out, checkpoint = (shared_dir(spark, n) for n in ("input", "out", "checkpoint"))
    schema = "mid string, rt timestamp, n int"

    def send(n):
        spark.createDataFrame([("m", at(1), n)], schema).coalesce(1).write.mode("append").parquet(path)

    for n in (1, 2):
        send(n)
        stream = daily_first_flag_stream(spark.readStream.schema(schema).parquet(path), "mid", "rt", ttl_ms=3000)
        run_until(run_stream(stream, checkpoint, append_batch(out), "1 second"), out, n)
        time.sleep(4)
    assert rows_of(spark.read.parquet(out), "n", "uv") == [(1, 1), (2, 1)]


# --- event time ---------------------------------------------------------------

def test_bad_and_late_records_are_counted(spark):
    """Counted as they pass: of a stored table, of a stream's batches, and what came behind the watermark."""
    from pyspark.sql import Observation

    use_rocksdb_state(spark)
    texts = [change("t", k, id=str(k)) for k in range(5)] + [("{cut",), ("[1]",), (None,)]
    seen = Observation("cdc")
    rows = fn.parsed(spark.createDataFrame(texts, "value string"), S.CDC)
    rows.observe(seen, F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"bad": 2}

    counts = RecordCounts().start(spark)
    try:
        path, out, checkpoint = (shared_dir(spark, n) for n in ("input", "out", "checkpoint"))
        def deliver(batch):
            spark.createDataFrame(batch, "value string").coalesce(1).write.mode("append").text(path)
            log = read_cdc_log(read_topic_files(spark, path), count_as="cdc")
            counted = window_bounds(tumble(log, "rt", "10 seconds", aggs=[F.count("*").alias("n")]))
            query = run_stream(counted, checkpoint, append_batch(out), None)
            query.awaitTermination(120)
            return str(query.id)

        deliver([change("t", 100, id="1"), ("{cut",), change("t", 200, id="2")])
        query = deliver([change("t", 101, id="3"), ("x",), ("[2]",), change("t", 300, id="4")])
        log_path = shared_dir(spark, "log")
        spark.createDataFrame([('{"common":{"mid":"m","is_new":"1"},"page":{},"ts":1}',), ("{cut",)], "value string").write.text(log_path)
        finish(streams.log_topics(read_topic_files(spark, log_path), count_as="log"))
        deadline = time.monotonic() + 30
        while time.monotonic() < deadline and (counts.counts["log"]["records"] < 2 or counts.counts["cdc"]["bad"] < 3):
            time.sleep(0.2)
        assert counts.counts["cdc"] == {"records": 7, "bad": 3}
        assert counts.counts["log"] == {"records": 2, "bad": 1}
        assert counts.late[query] == 1
    finally:
        counts.stop(spark)


def test_late_record_does_not_change_a_closed_window(spark):
    path, out, checkpoint = (shared_dir(spark, n) for n in ("input", "out", "checkpoint"))
    schema = "n int, rt timestamp"
    batches = [[(1, at(1, 0, 0, 1)), (2, at(1, 0, 1))], [(3, at(1, 0, 0, 2)), (4, at(1, 0, 0, 59)), (5, at(1, 0, 3))]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        stream = with_event_time(spark.readStream.schema(schema).parquet(path), "rt")
        counted = window_bounds(tumble(stream, "rt", "10 seconds", aggs=[F.collect_list("n").alias("n")]))
        run_stream(counted, checkpoint, append_batch(out), None).awaitTermination(120)
    got = {r.stt[-5:]: r.n for r in spark.read.parquet(out).collect()}
    # 3 is behind the watermark of 00:58, 4 is not; the window of 5 is still open.
    assert got == {"00:00": [1], "00:50": [4], "01:00": [2]}


def test_dedup_forgets_after_the_delay(spark):
    path, out, checkpoint = (shared_dir(spark, n) for n in ("input", "out", "checkpoint"))
    schema = "id string, n int, rt timestamp"
    for batch in ([("a", 1, at(1, 0, 0, 0)), ("a", 2, at(1, 0, 0, 0))], [("b", 3, at(1, 0, 5))], [("a", 4, at(1, 0, 6)), ("b", 5, at(1, 0, 5))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path).withWatermark("rt", "5 seconds")
        run_stream(firsts.dedup_within(stream, ["id"]), checkpoint, append_batch(out), None).awaitTermination(120)
    kept = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(kept) == ["a", "a", "b"]


# --- joins --------------------------------------------------------------------

def test_payment_interval_join(spark, sf_dir):
    from workload.facts import clicked_lines, payments
    from tidemark.sources import dictionary

    types = dictionary(table(spark, sf_dir, "region"), "r_regionkey", "r_name")
    pays, lines = payments(spark, sf_dir), clicked_lines(spark, sf_dir)
    wide = ("-2 days", "6 hours")
    batch = facts.pay_detail(pays, lines, types, *wide)
    streamed = finish(facts.pay_detail(stream_of(pays), stream_of(lines, "0 seconds"), types, *wide))
    assert batch.count() > 0
    assert rows_of(streamed, *batch.columns) == rows_of(batch, *batch.columns)


def change(name, ts, kind="insert", old=None, **data):
    return (json.dumps({"database": "shop", "table": name, "type": kind, "ts": ts, "data": data, "old": old}),)


def order_changes(order, ts, lines=2):
    """An order made at ``ts`` (seconds), its lines, and an activity and a coupon on the first of them."""
    made = dt.datetime.fromtimestamp(ts, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    rows = [change("order_info", ts, id=order, user_id="u", create_time=made, more="x")]
    rows += [change("order_detail", ts + 1, id=f"{order}-{k}", order_id=order, sku_id=f"s{k}") for k in range(lines)]
    return rows + [
        change("order_detail_activity", ts + 2, id=f"a{order}", order_id=order, order_detail_id=f"{order}-0", activity_id="7"),
        change("order_detail_coupon", ts + 2, id=f"c{order}", order_id=order, order_detail_id=f"{order}-0", coupon_id="8")]


HOUR = 3600
DAY_ONE = 1_704_067_200  # 2024-01-01


def run_batches(spark, batches, build):
    """Deliver change-log texts batch by batch; ``build`` starts the stream's writer."""
    path, checkpoint = shared_dir(spark, "cdc"), shared_dir(spark, "checkpoint")
    for batch in batches:
        spark.createDataFrame(batch, "value string").coalesce(1).write.mode("append").text(path)
        stream, write = build(read_cdc_log(read_topic_files(spark, path)))
        run_stream(stream, checkpoint, write, None).awaitTermination(180)
    return read_cdc_log(read_topic_files(spark, path, stream=False))


def test_late_parts_are_kept_and_paired(spark):
    """A coupon 30 hours late, a line after its order has left, parts without an order, an order behind the watermark: nothing is lost."""
    use_rocksdb_state(spark)
    facts_of = jobs.OrderFacts(spark, shared_dir(spark, "facts"))
    clock = [change("order_info", DAY_ONE + 90 * HOUR, id="clock")]
    batches = [
        order_changes("1", DAY_ONE) + order_changes("2", DAY_ONE + 60) + [
            change("order_detail", DAY_ONE, id="9-0", order_id="9"), change("order_detail", DAY_ONE, id="null-0", order_id=None)],
        [change("order_info", DAY_ONE + 28 * HOUR, id="clock")],
        [change("order_detail_coupon", DAY_ONE + 30 * HOUR, id="c9", order_id="1", order_detail_id="1-1", coupon_id="late"),
         change("order_detail", DAY_ONE + 30 * HOUR, id="2-9", order_id="2", sku_id="late"),
         change("other", DAY_ONE + 30 * HOUR, id="x")],
        clock + order_changes("3", DAY_ONE + HOUR),  # behind the watermark by days
        [change("order_info", DAY_ONE + 200 * HOUR, id="clock")],
        [change("order_info", DAY_ONE + 300 * HOUR, id="clock")],
    ]
    log = run_batches(spark, batches, lambda log: (streams.order_facts(log, "shop"), facts_of.write))
    columns = [c for c in S.order_detail_columns("rt") if c != "rt"]

    def now():
        return sorted((tuple(r) for r in facts_of.read().select(*columns).collect()), key=str)

    wanted = sorted((tuple(r) for r in stored_facts.order_facts(log, "shop").filter("order_id <> 'clock'").select(*columns).collect()), key=str)
    lines = {r[columns.index("order_detail_id")] for r in wanted}
    assert lines == {"1-0", "1-1", "2-0", "2-1", "2-9", "3-0", "3-1"}
    late = facts_of.late()
    assert rows_of(late.filter("row not like '%clock%'").selectExpr("kind", "get_json_object(row, '$.id') id"), "kind", "id") == [
        ("order_detail", "2-9"), ("order_detail", "9-0"), ("order_detail", "null-0"), ("order_detail_coupon", "c9")]
    assert {r[columns.index("order_detail_id")] for r in now()} == lines - {"2-9"}
    facts_of.settle()
    assert now() == wanted  # as if all had been there at once
    facts_of.table.rewrite()
    facts_of.settle()
    assert now() == wanted
    # The order of a part that was there alone comes last of all.
    facts_of.write(spark.createDataFrame(
        [("order_info", at(9), json.dumps({"id": "9", "create_time": "2024-01-09 00:00:00"}))], "kind string, rt timestamp, row string"), 99)
    facts_of.settle()
    assert {r[columns.index("order_detail_id")] for r in now()} == lines | {"9-0"}


def test_cancelled_orders_on_a_stream(spark):
    """Cancellations meet the stored facts of their days; one that comes before its lines waits for them."""
    use_rocksdb_state(spark)
    root = shared_dir(spark, "cancel")
    facts_of, out = jobs.OrderFacts(spark, f"{root}/facts"), f"{root}/out"
    days = [DAY_ONE + k * 24 * HOUR for k in range(4)]
    orders = [r for k, day in enumerate(days) for r in order_changes(str(k), day)]
    spark_rows = read_cdc_log(spark.createDataFrame(orders, "value string"))

    def store(batch_id, *ids):
        wide = stored_facts.order_facts(spark_rows, "shop").filter(F.col("order_id").isin(*ids))
        facts_of._put(wide, F.lit(0).cast("long"), batch_id)
        facts_of.table.rewrite()

    def cancel(order, ts):
        made = dt.datetime.fromtimestamp(days[int(order)], dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        return change("order_info", ts, "update", {"order_status": "1001"}, id=order, order_status="1003", create_time=made)

    store(0, "0", "1", "3")
    plans, path, checkpoint = [], shared_dir(spark, "cdc"), shared_dir(spark, "checkpoint")

    def write(df, batch_id):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        append_batch(out)(df, batch_id)

    for k, batch in enumerate(([cancel("1", days[3]), cancel("2", days[3])], [cancel("3", days[3])], [change("order_info", days[3], "update", id="0")])):
        spark.createDataFrame(batch, "value string").coalesce(1).write.mode("append").text(path)
        log = read_cdc_log(read_topic_files(spark, path))
        run_stream(streams.cancelled_orders(log, "shop"), checkpoint, jobs.cancel_fact_writer(facts_of, f"{root}/cancel", write), None).awaitTermination(180)
        if k == 0:
            assert rows_of(spark.read.parquet(out), "order_detail_id") == [("1-0",), ("1-1",)]
            store(1, "2")
    every = read_cdc_log(read_topic_files(spark, path, stream=False))
    columns = [c for c in S.order_detail_columns("pt") if c not in ("pt", "order_status")]
    both = spark_rows.unionByName(every)
    expected = stored_facts.cancel_facts(both, "shop")
    got = spark.read.parquet(out)
    names = ["order_id", "order_detail_id", "sku_id", "activity_id", "coupon_id", "order_status"]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, expected.select(*names).collect()))
    assert got.count() == 6 and set(S.order_detail_columns("pt")) <= set(got.columns) and columns
    assert "IN (p2024-01-02,p2024-01-03)" in plans[0] and "PartitionFilters" in plans[0]


def test_names_change_between_batches(spark):
    """A category, a trademark and a sku change; only the skus under them are worked out anew, and the next batch sees them."""
    root = shared_dir(spark, "flat")
    def frame(rows, columns):
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))

    tables = {
        "sku": frame([(str(k), f"p{k % 2}", f"t{k % 3}", f"c{k % 4}") for k in range(12)], ["id", "spu_id", "tm_id", "category3_id"]),
        "spu": frame([("p0", "spu 0"), ("p1", "spu 1")], ["id", "spu_name"]),
        "trademark": frame([("t0", "mark 0"), ("t1", "mark 1")], ["id", "tm_name"]),  # t2 comes later
        "category3": frame([(f"c{k}", f"three {k}", f"d{k % 2}") for k in range(4)], ["id", "name", "category2_id"]),
        "category2": frame([("d0", "two 0", "e"), ("d1", "two 1", "e")], ["id", "name", "category1_id"]),
        "category1": frame([("e", "one")], ["id", "name"]),
    }
    flat = jobs.FlatSkus(spark, root, lambda: tables)
    flat.write(None, 0)

    def same():
        whole = joins.flatten_sku(**tables)
        assert sorted(map(str, flat.read().select(*whole.columns).collect())) == sorted(map(str, whole.collect()))

    same()
    written = []
    write = jobs.sku_summary_writer(flat.read, lambda df, _: written.append(rows_of(df, "sku_id", "category2_name")))
    batch = spark.createDataFrame([("1", "2")], "sku_id string, x string")
    for c in S.SKU_SUMMARY:
        if c not in batch.columns and c not in joins.SKU_ATTRIBUTES:
            batch = batch.withColumn(c, F.lit("0"))
    write(batch, 0)
    tables["category2"] = frame([("d0", "two 0", "e"), ("d1", "new name", "e")], ["id", "name", "category1_id"])
    flat.write({"category2": frame([("d1",)], ["id"])}, 1)
    same()
    assert spark.read.parquet(f"{root}/changes").filter("_batch = 1").count() == 6  # c1 and c3 lie under d1
    write(batch, 1)
    assert written == [[("1", "two 1")], [("1", "new name")]]
    tables["trademark"] = tables["trademark"].union(frame([("t2", "mark 2")], ["id", "tm_name"]))
    tables["sku"] = tables["sku"].filter("id <> '4'").union(frame([("99", "p0", "t0", "c9")], ["id", "spu_id", "tm_id", "category3_id"]))
    flat.write({"trademark": frame([("t2",)], ["id"]), "sku": frame([("4",), ("99",)], ["id"])}, 2)
    same()
    flat.table.rewrite()
    same()


# --- sinks --------------------------------------------------------------------

def test_json_topic_round_trip(spark):
    df = spark.createDataFrame([("1", "x", at(1))], "order_id string, sku_id string, rt timestamp")
    path = shared_dir(spark, "topic")
    fn.to_json_rows(df).write.text(path)
    back = finish(read_order_detail(read_topic_files(spark, path)))
    assert back.columns == S.order_detail_columns()
    assert rows_of(back, "order_id", "sku_id", "rt") == [("1", "x", at(1))]


def test_topic_writers_are_set_up(spark):
    """The Kafka connector is not installed here, so the writers are only built."""
    stream = spark.readStream.format("rate").load().select(F.col("value").cast("string").alias("value"))
    for writer in (write_topic(stream, "host:1", "t"), write_json_topic(stream, "host:1", "t"), debug_stream(stream)):
        assert writer is not None
    rows = topic_rows(spark.range(2), F.lit("t"), F.col("id").cast("string"))
    assert rows_of(rows, "topic", "value") == [("t", "0"), ("t", "1")]


def test_write_summary(spark):
    out = shared_dir(spark, "summary")
    write = write_summary(out)
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "cur_date string, n int")
    write(df, 3)
    write(df, 3)  # the batch is run again
    assert rows_of(spark.read.json(f"{out}/batch_id=3"), "cur_date", "n") == [("2024-01-01", 1), ("2024-01-02", 2)]
    assert os.path.isdir(f"{out}/batch_id=3/date=2024-01-02")


@pytest.mark.parametrize("mode, after_second", [("row", ("k", None, "3")), ("cell", ("k", "1", "3"))])
def test_keyed_table(spark, mode, after_second):
    table = KeyedTable(spark, shared_dir(spark, "table"), "id", ["a", "b"], ["n"], mode=mode)
    assert table.read() is None and table.rewrite() == []
    schema = "id string, a string, b string, n int, deleted boolean"

    def put(batch_id, *rows):
        table.write(spark.createDataFrame(list(rows), schema), batch_id)

    def now():
        return sorted(map(tuple, table.read().collect()))

    put(0, ("k", "1", "2", 1, False), ("x", "0", "0", 1, False))
    put(1, ("k", None, "3", 2, False))
    put(1, ("k", None, "3", 2, False))  # the batch is run again
    expected = sorted([after_second, ("x", "0", "0")])
    assert now() == expected
    assert 1 <= len(table.rewrite()) <= 2
    assert now() == expected
    put(2, ("x", None, None, 3, True), ("y", "5", "5", 3, False))
    expected = sorted([after_second, ("y", "5", "5")])
    assert now() == expected
    table.rewrite()
    table.rewrite()
    assert now() == expected
    assert sorted(map(tuple, table.read(since="2999-01-01").collect())) == expected  # the table alone


@pytest.mark.parametrize("mode", ["row", "cell"])
def test_table_is_the_same_whenever_it_is_rewritten(spark, mode):
    """Late puts, late deletes and equal order values, in any order of batches, rewritten never, always and in between."""
    import random

    schema, rng = "id string, a string, b string, n int, deleted boolean", random.Random(mode)
    batches = [
        [("k", "old", None, 5, False), ("z", "gone", "gone", 5, False), ("z", None, None, 6, True)],
        [("k", "late", "x", 3, False), ("z", "late", "y", 3, False), ("k", None, "y", 5, False)],
    ] + [
        [(rng.choice("abcz"), rng.choice([None, "1", "2"]), rng.choice([None, "3"]), rng.randint(1, 9), rng.random() < 0.3) for _ in range(6)]
        for _ in range(2)
    ]

    def after(points, order=(0, 1, 2, 3)):
        table = KeyedTable(spark, shared_dir(spark, "table"), "id", ["a", "b"], ["n"], mode=mode, parts=3)
        for k in order:
            table.write(spark.createDataFrame(batches[k], schema), k)
            if k in points:
                table.rewrite()
                table.write(spark.createDataFrame(batches[k], schema), k)  # comes again after it was folded
        return sorted(map(tuple, table.read().collect()), key=str)

    expected = after(())
    keys = {}
    for id_, a, b, n, gone in sorted((r for rows in batches for r in rows), key=lambda r: (r[3], not r[4], r[1] or "", r[2] or "")):
        had = keys.get(id_, (None, None))
        keys[id_] = None if gone else (a, b) if mode == "row" else tuple(
            new if new is not None else old for new, old in zip((a, b), had or (None, None)))
    assert expected == sorted(((k, *v) for k, v in keys.items() if v is not None), key=str)
    for points, order in (((0,), (0, 1, 2, 3)), ((0, 1, 2, 3), (3, 1, 0, 2)), ((1, 3), (2, 3, 1, 0))):
        assert after(points, order) == expected, (points, order)


def test_table_partitioned_by_day(spark):
    """Only the days of the changes are overwritten, and only the days asked for are read."""
    path = shared_dir(spark, "days")
    table = KeyedTable(spark, path, "line", ["v"], ["n"], partition="day")
    schema = "line string, v string, n int, day date, deleted boolean"
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    table.write(spark.createDataFrame([(f"l{d.day}", "old", 1, d, False) for d in days] + [("l9", "x", 1, None, False)], schema), 0)
    assert table.rewrite() == ["", "2024-01-01", "2024-01-02", "2024-01-03"]
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/table/*/*.parquet")}
    table.write(spark.createDataFrame([("l2", "new", 2, days[1], False)], schema), 1)
    table._shared = lambda since: spark.read.parquet(f"{path}/changes").filter("_batch = 1")
    assert table.rewrite() == ["2024-01-02"]
    kept = set(files) & set(glob.glob(f"{path}/table/*/*.parquet"))
    assert len(kept) == len(files) - 1
    pruned = table.read(since="2999-01-01", parts=["2024-01-02", "2024-01-03"])
    assert rows_of(pruned, "line", "v") == [("l2", "new"), ("l3", "old")]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part#" in plan and "IN (p2024-01-02,p2024-01-03)" in plan, plan


def test_keyless_rows_stay_on_streams(spark):
    """Stored and streamed repair and daily flags agree on rows without a key, and on days out of order."""
    use_rocksdb_state(spark)
    path = shared_dir(spark, "keyless")
    schema = "n int, mid string, rt timestamp, is_new string"
    rows = [(1, None, at(1), "1"), (2, None, at(1), "1"), (3, "m", at(1), "1"), (4, "m", at(1) + dt.timedelta(days=1), "1"), (5, "m", at(2), "1")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    expected = rows_of(traffic.repair_is_new(stored, "mid", "rt", "is_new"), "n", "is_new")
    assert rows_of(finish(repair_is_new_stream(stream, "mid", "rt", "is_new")), "n", "is_new") == expected
    assert expected == [(1, "1"), (2, "1"), (3, "1"), (4, "0"), (5, "0")]


def test_dimension_upkeep_on_a_stream(spark):
    rules = spark.createDataFrame(
        [("user", "ALL", "dim_user", "dim", "info", "id,name,city", "id", None)], S.TABLE_PROCESS
    )
    dims = jobs.DimensionTables(spark, shared_dir(spark, "dim"), lambda: rules, "shop")
    path, checkpoint = shared_dir(spark, "cdc"), shared_dir(spark, "checkpoint")

    def record(kind, ts, **data):
        return (json.dumps({"database": "shop", "table": "user", "type": kind, "ts": ts, "xid": 1, "xoffset": ts, "data": data}),)

    for batch in (
        [record("insert", 1, id="1", name="n", city="c", secret="s"), record("insert", 1, id="2", name="m", city="d")],
        [record("update", 2, id="1", name=None, city="e"), record("delete", 2, id="2", name="m"), record("bootstrap-start", 3, id="3")],
    ):
        spark.createDataFrame(batch, "value string").coalesce(1).write.mode("append").text(path)
        log = read_cdc_log(read_topic_files(spark, path))
        run_stream(log, checkpoint, dims.write, None).awaitTermination(120)
        dims.table("dim_user").rewrite()
        apply_table_ddl(spark, rules.selectExpr("'c' as op", "1L as ts_ms", "*"))
        jobs.publish_dimension(dims, "dim_user")
    assert spark.table("dim_user").columns == ["id", "name", "city"]
    assert rows_of(spark.table("dim_user"), "id", "name", "city") == [("1", "n", "e")]
    spark.sql("drop table dim_user")
    assert sorted(map(tuple, dims.table("dim_user").read().collect())) == [("1", "n", "e")]


def test_rules_change_while_the_jobs_run(spark):
    """A rule is added, moved and deleted between batches; dimensions and facts follow, lookups see new names."""
    root = shared_dir(spark, "jobs")
    rules = jobs.RuleTable(spark, f"{root}/rules")
    dims = jobs.DimensionTables(spark, f"{root}/dims", rules.read, "shop")
    route = jobs.fact_router(f"{root}/facts", rules.read, "shop")

    def image(source, sink, kind, columns):
        return {"source_table": source, "source_type": "insert", "sink_table": sink, "sink_type": kind, "sink_family": "info",
                "sink_columns": columns, "sink_row_key": "id", "sink_extend": None}

    def change_rules(batch_id, *changes):
        texts = [(json.dumps({"op": op, "ts_ms": ts, "before": before, "after": after}),) for op, ts, before, after in changes]
        rules.write(read_config_changes(spark.createDataFrame(texts, "value string"))[0], batch_id)

    def log(batch_id, *records):
        texts = [(json.dumps({"database": "shop", "table": t, "type": kind, "ts": ts, "xid": 1, "xoffset": ts, "data": data}),)
                 for t, kind, ts, data in records]
        batch = read_cdc_log(spark.createDataFrame(texts, "value string"))
        dims.write(batch, batch_id)
        route(batch, batch_id)

    user, city = image("user", "dim_user", "dim", "id,name"), image("city", "dim_city", "dim", "id,name")
    pay = image("pay", "dwd_pay", "dwd", "id,sum")
    assert dims.table("dim_user") is None
    log(0, ("user", "insert", 1, {"id": "0", "name": "early"}))
    change_rules(0, ("r", 1, None, user), ("r", 1, None, pay))
    log(1, ("user", "insert", 2, {"id": "1", "name": "n", "secret": "s"}), ("city", "insert", 2, {"id": "9", "name": "c"}),
        ("pay", "insert", 2, {"id": "5", "sum": "1", "x": "y"}), ("user", "insert", 2, {"name": "keyless"}))
    lookups = []
    look = jobs.with_fresh(
        lambda batch, users: joins.enrich(batch, users, "user_id", {"name": "info.name"}),
        lambda df, batch_id: lookups.append(rows_of(df, "user_id", "name")), users=lambda: jobs.as_dimension(dims.table("dim_user")))
    look(spark.createDataFrame([("1",)], "user_id string"), 0)
    change_rules(1, ("c", 3, None, city), ("u", 3, pay, image("paid", "dwd_pay", "dwd", "id")), ("d", 4, image("gone", "x", "dim", "id"), None))
    log(2, ("city", "insert", 4, {"id": "8", "name": "d"}), ("user", "update", 4, {"id": "1", "name": "new"}),
        ("pay", "insert", 4, {"id": "6"}), ("paid", "insert", 4, {"id": "7", "sum": "2"}))
    look(spark.createDataFrame([("1",)], "user_id string"), 1)
    assert lookups == [[("1", "n")], [("1", "new")]]
    assert dims.table("dim_user").rewrite()
    log(3, ("user", "delete", 5, {"id": "1"}), ("city", "update", 1, {"id": "8", "name": "late"}))
    assert rows_of(dims.table("dim_city").read(), "rowkey", "name") == [("8", "d")]
    assert dims.table("dim_user").read().count() == 0
    facts_out = spark.read.text(f"{root}/facts/batch_id=*/topic=*")
    assert sorted(r.value for r in facts_out.collect()) == ['{"id":"5","sum":"1"}', '{"id":"7"}']
    assert dims.last_rejected == {"records": 0, "no_rule": 0, "no_key": 0}
    rejected = spark.read.parquet(f"{root}/dims/rejected")
    assert ("user", "no key") in rows_of(rejected, "table", "reason") and ("city", "no rule") in rows_of(rejected, "table", "reason")
    change_rules(2, ("d", 9, user, None))
    assert dims.table("dim_user") is None


def test_wide_facts_through_the_stored_log(spark):
    path = shared_dir(spark, "log")
    write = jobs.change_log_writer(path)
    write(spark.createDataFrame([('{"database":"shop","table":"t","type":"insert","ts":1,"data":{"id":"1"}}',), ("{cut",), (None,)], "value string"), 0)
    assert rows_of(jobs.stored_change_log(spark, path), "table", "type") == [("t", "insert")]
    assert rows_of(jobs.bad_changes(spark, path), "value") == [("{cut",)]


def test_apply_table_ddl(spark):
    def changes(*rows):
        return spark.createDataFrame(
            [(op, ts, "s", "ALL", table, kind, "info", "name, id", "id", None) for op, ts, table, kind in rows],
            "op string, ts_ms bigint, " + S.TABLE_PROCESS,
        )

    apply_table_ddl(spark, changes(("r", 1, "dim_t", "dim"), ("c", 2, "dwd_t", "dwd")))
    assert spark.catalog.tableExists("dim_t") and not spark.catalog.tableExists("dwd_t")
    assert spark.table("dim_t").columns == ["id", "name"]
    spark.sql("insert into dim_t values ('1', 'x')")
    apply_table_ddl(spark, changes(("c", 3, "dim_t", "dim")))
    assert spark.table("dim_t").count() == 1
    apply_table_ddl(spark, changes(("u", 4, "dim_t", "dim")))
    assert spark.table("dim_t").count() == 0
    assert apply_table_ddl(spark, changes(("d", 5, "dim_t", "dim"))) == [("drop", "dim_t")]
    assert not spark.catalog.tableExists("dim_t")
