"""What keeps work and disk in step with the input: files, passes, exchanges, sorts."""

import glob
import os
import re
import time

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import workload.all  # noqa: F401
from tidemark.operators import facts, firsts, keywords
from tidemark.plans import facts as plan_facts, jobs
from tidemark.session import DROP_SHUFFLES, shared_dir, shuffles_dropped, written
from tidemark.sources import read_cdc_log
from tidemark.streaming.state import DailyFirst
from workload.facts import change_texts
from workload.inputs import order_tables, table
from workload.registry import QUERIES
from workload.streams import topic_of


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topic_files_are_compressed(spark):
    texts = spark.range(20_000, numPartitions=1).select(F.to_json(F.struct("id", F.lit("x" * 100).alias("x"))).alias("value"))
    size = texts.agg(F.sum(F.octet_length("value"))).first()[0]
    topic_of(texts, "packed")
    files = glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/packed-*/part-*")
    assert 0 < sum(map(os.path.getsize, files)) < size / 5
    assert spark.read.text(files).exceptAll(texts).isEmpty() and spark.read.text(files).count() == 20_000


def test_rare_repeats_are_sorted_once(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 1, "a"), (1, 1, None), (2, None, "b")], "k int, at int, v string")
    once = firsts.dedup_within(df, ["k"], ["at"])
    plan = plan_of(once)
    assert sorted((tuple(r) for r in once.collect()), key=str) == [(1, 1, None), (2, None, "b")]
    assert plan.count("Sort [") == 1 and "WindowGroupLimit" not in plan, plan


def test_reductions_are_joined_where_they_lie(spark, sf_dir):
    """Lines, activities and coupons move once each, by the line's id; the lines a second time, to their orders."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = plan_of(facts.order_detail_wide(**order_tables(spark, sf_dir)))
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("Exchange hashpartitioning") == 5, plan


def test_change_log_is_read_once_and_has_few_files(spark):
    seen, path = spark.sparkContext.accumulator(0), shared_dir(spark, "log")

    def text(n):
        seen.add(1)
        return ("{cut" if n == 0 else '{"database":"shop","table":"t","type":"insert","ts":%d,"data":{"id":"%d"}}' % (n % 20 * 86_400, n),)

    raw = spark.createDataFrame(spark.sparkContext.parallelize(range(400), 8).map(text), "value string")
    jobs.change_log_writer(path)(raw, 0)
    assert seen.value == 400
    assert len(glob.glob(f"{path}/log/**/*.parquet", recursive=True)) <= 30  # 20 days, and not 8 times as many
    log = jobs.stored_change_log(spark, path)
    assert {r.id for r in log.select(F.col("data")["id"].alias("id")).collect()} == {str(n) for n in range(1, 400)}
    assert [r.value for r in jobs.bad_changes(spark, path).collect()] == ["{cut"]


def stages_of(spark, group):
    """Stages that the jobs of a group ran."""
    jobs_of = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    return {stage for job in jobs_of for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds}


def test_change_log_is_written_where_it_lies(spark):
    """No shuffle, a file a task and table whatever the days, and a day's rows are found without reading the file."""
    path = shared_dir(spark, "log")
    day = (F.pmod(F.xxhash64("id"), F.lit(40)) * 86_400).alias("ts")
    raw = spark.range(100_000, numPartitions=1).select(F.to_json(F.struct(
        F.lit("shop").alias("database"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("table"), F.lit("insert").alias("type"), day,
        F.struct(F.col("id").cast("string").alias("id")).alias("data"))).alias("value"))
    spark.sparkContext.setJobGroup("store", "store")
    try:
        jobs.change_log_writer(path)(raw, 0)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages_of(spark, "store")) == 1
    files = glob.glob(f"{path}/log/**/*.parquet", recursive=True)
    assert len(files) == 2
    for file in files:
        days = pq.read_table(file, columns=["day"], partitioning=None)["day"].to_pylist()
        assert days == sorted(days) and len(set(days)) == 40
        assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"
    log = jobs.stored_change_log(spark, path)
    assert log.count() == 100_000 and dict(log.dtypes)["day"] == "date"
    one = log.filter((F.col("table") == "odd") & (F.col("day") == "1970-01-03")).select("table", "day", F.col("data")["id"].alias("id"))
    wanted = log.select("table", F.col("day").cast("string").alias("day"), F.col("data")["id"].alias("id")).collect()
    assert {r.id for r in one.collect()} == {r.id for r in wanted if (r.table, r.day) == ("odd", "1970-01-03")} != set()
    (scan,) = [one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)]
    assert scan.metrics().apply("numOutputRows").value() <= 25_000  # of 50,000 rows of the table, 100,000 of the log


def test_odd_table_names_are_stored(spark):
    path = shared_dir(spark, "log")
    rows = [('{"database":"shop",%s"type":"insert","ts":%s,"data":{"id":"%d"}}' % (name, ts, n),) for n, (name, ts) in enumerate(
        [("", 1), ('"table":null,', 1), ('"table":"",', 1), ('"table":"t",', "null"), ('"table":"a b/c=d",', 86_400)])]
    jobs.change_log_writer(path)(spark.createDataFrame([*rows, ("[1]",)], "value string"), 0)
    log = jobs.stored_change_log(spark, path)
    assert sorted((r.id, r.table, str(r.day)) for r in log.select(F.col("data")["id"].alias("id"), "table", "day").collect()) == [
        ("0", None, "1970-01-01"), ("1", None, "1970-01-01"), ("2", None, "1970-01-01"), ("3", "t", "None"), ("4", "a b/c=d", "1970-01-02")]
    assert log.columns == ["database", "type", "ts", "xid", "xoffset", "data", "old", "rt", "pt", "table", "day"]
    assert [r.value for r in jobs.bad_changes(spark, path).collect()] == ["[1]"]


def test_shuffle_files_go_as_a_write_ends(spark):
    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}

    rows, before, setting = spark.range(1000).repartition(3, "id"), files(), spark.conf.get(DROP_SHUFFLES, None)
    assert written(rows, "kept").count() == 1000
    left = files() - before
    assert left
    with shuffles_dropped(spark):
        gone = written(rows, "gone")
    assert spark.conf.get(DROP_SHUFFLES, None) == setting
    until = time.time() + 20
    while files() - before - left and time.time() < until:  # deleted in the background
        time.sleep(0.1)
    assert not files() - before - left
    assert gone.count() == 1000


def test_lines_are_shuffled_one_time_at_once(spark):
    """The lines with their reductions are written before they move to their orders; nothing of the job is left out."""
    def row(table, id_, **data):
        return ("shop", table, "insert", {"id": id_, **data}, None)

    log = spark.createDataFrame([
        row("order_info", "1", user_id="u"), row("order_info", "2", user_id="v"), row("order_info", "4"),
        row("order_detail", "a", order_id="1", sku_id="s"), row("order_detail", "a", order_id="2"), row("order_detail", "b", order_id="1"),
        row("order_detail", "c", order_id="3"), row("order_detail", "d"), row("order_detail", None, order_id="2"),
        row("order_detail_activity", "r1", order_detail_id="a", order_id="9", activity_id="x"), row("order_detail_activity", "r2", order_detail_id="a"),
        row("order_detail_coupon", "k1", order_detail_id="a", coupon_id="y"), row("order_detail_coupon", "k2", order_detail_id="c"),
    ], "database string, table string, type string, data map<string,string>, old map<string,string>").withColumn("rt", F.lit(0).cast("timestamp"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        wide = plan_facts.order_facts(log, "shop")
        plan = plan_of(wide)
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("Exchange hashpartitioning") == 2, plan
    columns = ["order_id", "user_id", "order_detail_id", "sku_id", "order_detail_activity_id", "activity_id", "order_detail_coupon_id", "coupon_id"]
    assert sorted((tuple(r) for r in wide.select(*columns).collect()), key=str) == sorted([
        ("1", "u", "a", "s", "r1", "x", "k1", "y"), ("1", "u", "a", "s", "r2", None, "k1", "y"), ("1", "u", "b", None, None, None, None, None),
        ("2", "v", "a", None, "r1", "x", "k1", "y"), ("2", "v", "a", None, "r2", None, "k1", "y"),
        ("2", "v", None, None, None, None, None, None)], key=str)


def test_cancelled_lines_are_shuffled_one_time_at_once(spark):
    def row(table, type_, id_, old=None, **data):
        return ("shop", table, type_, {"id": id_, **data}, old)

    log = spark.createDataFrame([
        row("order_info", "update", "1", {"order_status": "1001"}, order_status="1003"), row("order_info", "insert", "2", order_status="1003"),
        row("order_info", "update", "3", {"order_status": "1001"}, order_status="1002"),
        row("order_info", "update", "4", {"order_status": "1002"}, order_status="1003"),
        *[row("order_detail", "insert", f"{o}-{n}", order_id=o, sku_id="s") for o in "1234" for n in (1, 2)], row("order_detail", "insert", "0"),
        row("order_detail_activity", "insert", "r1", order_detail_id="1-2", order_id="9"), row("order_detail_activity", "insert", "r2", order_detail_id="1-2"),
        row("order_detail_coupon", "insert", "k1", order_detail_id="4-1"), row("order_detail_coupon", "insert", "k2", order_detail_id="2-1"),
    ], "database string, table string, type string, data map<string,string>, old map<string,string>").withColumns(
        {"rt": F.lit(0).cast("timestamp"), "pt": F.lit(1).cast("timestamp")})
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        wide = plan_facts.cancel_facts(log, "shop")
        plan = plan_of(wide)
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("Exchange hashpartitioning") == 3 and "order_info" not in plan, plan
    columns = ["order_id", "order_detail_id", "sku_id", "order_detail_activity_id", "order_detail_coupon_id"]
    assert sorted((tuple(r) for r in wide.select(*columns).collect()), key=str) == sorted([
        ("1", "1-1", "s", None, None), ("1", "1-2", "s", "r1", None), ("1", "1-2", "s", "r2", None),
        ("4", "4-1", "s", None, "k1"), ("4", "4-2", "s", None, None)], key=str)
    assert [r.n for r in wide.select(F.unix_timestamp("pt").alias("n")).distinct().collect()] == [1]


def test_buckets_grow_with_the_lines(spark, sf_dir):
    assert plan_facts.buckets_for(0) == 8 and plan_facts.buckets_for(36_000_000) == 240
    log = read_cdc_log(change_texts(spark, sf_dir))
    path = shared_dir(spark, "parts")
    plan_facts.store_order_parts(log, path.rsplit("/", 1)[1].replace("-", "_"), path, 5, "shop")
    assert all(len(glob.glob(f"{kind}/part-*")) <= 5 for kind in glob.glob(f"{path}/kind=*"))


def test_days_of_a_key_are_asked_for_together():
    """State calls of a key do not grow with its days."""
    calls = []

    class Days:
        def __init__(self):
            self.known = []

        def get(self):
            calls.append("get")
            return iter(self.known)

        def appendList(self, rows):
            calls.append("append")
            self.known += rows

    class Handle:
        def getListState(self, name, schema, ttl):
            return Days()

    first = DailyFirst(1000)
    first.init(Handle())

    def flags(days):
        pdf = pd.DataFrame([["m", at, f"2024-01-{d:02}", None, str(at)] for at, d in enumerate(days)])
        out = next(iter(first.handleInputRows(("m",), iter([pdf]), None)))
        return out["_uv"].tolist()

    assert flags([1, 2, 2, *range(3, 29)]) == [1, 1, 0, *[1] * 26]
    assert calls == ["get", "append"]
    assert flags([5, 29, 5]) == [0, 1, 0] and len(calls) == 4


def test_ttl_stream_input_is_written_by_all_cores(spark, sf_dir):
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/views-*"))
    df = QUERIES["daily_first_ttl_stream"](spark, sf_dir)
    assert df.count() == table(spark, sf_dir, "events").count()
    (path,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/views-*")) - before
    assert len(glob.glob(f"{path}/part-*")) == spark.sparkContext.defaultParallelism


def test_pieces_are_counted_before_their_script_is_looked_at(spark):
    df = spark.createDataFrame([(1, "大数a 大数a b b"), (2, "b 大数a")], "doc int, text string")
    known = spark.createDataFrame([("大数",)], "word string")
    found = keywords.segment(df, "text", known)
    assert re.search(r"HashAggregate\(keys=\[doc#\d+, _piece#", plan_of(found)), plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", 2), (1, "b", 2), (1, "大数", 2), (2, "a", 1), (2, "b", 1), (2, "大数", 1)]
