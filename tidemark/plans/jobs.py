"""Whole jobs driven by the routing table, and the stored change log they start from.

The rules live in a keyed table that a stream of their changes keeps up to date; each
micro-batch of the business log reads them anew, so a rule that is added, moved or
deleted takes effect with the next batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tidemark import schemas as S
from tidemark.functions.jsons import CORRUPT
from tidemark.functions.times import date_part
from tidemark.operators.cdc import cdc_rows
from tidemark.operators.joins import SKU_ATTRIBUTES, enrich, enrich_sku, flatten_sku, skus_under
from tidemark.operators.routing import DIM_KEY, FACT_KEY, dim_route, dwd_route, route_by_topic
from tidemark.plans.dimensions import ORDER
from tidemark.session import shuffles_dropped
from tidemark.sinks.ddl import table_columns
from tidemark.sinks.tables import KeyedTable, overwrite_partitions, read_if_there
from tidemark.streaming.joins import cancel_detail, late_parts, order_details, reassembled

Write = Callable[[DataFrame, int], None]


# --- routing rules ---------------------------------------------------------------

class RuleTable:
    """The routing table, kept from its changes (see ``read_config_changes``)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.table = KeyedTable(spark, path, "rule", S.TABLE_PROCESS_COLUMNS, ["ts_ms"], parts=1)

    @staticmethod
    def _rule(prefix: str = "") -> Column:
        """Dimension rules are known by their table, fact rules by table and operation."""
        kind = F.col(f"{prefix}sink_type")
        keys = {k: [F.col(f"{prefix}{c}") for c in columns] for k, columns in (("dim", DIM_KEY), ("dwd", FACT_KEY))}
        return F.when(kind == "dim", F.to_json(F.array(kind, *keys["dim"]))).otherwise(F.to_json(F.array(kind, *keys["dwd"])))

    def write(self, changes: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` writer: puts, deletes, and the old keys of moved rules."""
        columns = S.TABLE_PROCESS_COLUMNS
        events = changes.select(self._rule().alias("rule"), *columns, "ts_ms", (F.col("op") == "d").alias("deleted"))
        moved = changes.filter((F.col("op") != "d") & F.col("old_source_table").isNotNull() & (self._rule() != self._rule("old_")))
        left = moved.select(
            self._rule("old_").alias("rule"), *[F.lit(None).cast("string").alias(c) for c in columns], "ts_ms",
            F.lit(True).alias("deleted"))
        self.table.write(events.unionByName(left), batch_id)

    def read(self) -> DataFrame:
        """The rules of this moment."""
        now = self.table.read()
        return self.spark.createDataFrame([], S.TABLE_PROCESS) if now is None else now.select(*S.TABLE_PROCESS_COLUMNS)


# --- dimensions ------------------------------------------------------------------

class DimensionTables:
    """All dimension tables under ``path``: changes written once a batch, tables read by the rules.

    A micro-batch is one write, partitioned by table, with the row's columns as an
    open map; so a table the rules did not know when the job began needs nothing
    set up.  Records without a rule or without a key are kept apart in ``rejected``, and
    counted: ``last_rejected`` has the last batch's ``records``, ``no_rule`` and ``no_key``.
    """

    def __init__(self, spark: SparkSession, path: str, rules: Callable[[], DataFrame], database: str | None = None) -> None:
        self.spark, self.path, self.rules, self.database = spark, path.rstrip("/"), rules, database
        self.last_rejected: dict[str, int] = {}

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` writer for the business change log."""
        rules = self.rules()
        mine = batch if self.database is None else batch.filter(F.col("database") == self.database)
        kept = mine.filter(~F.col("type").isin(*S.NOT_ROUTED_TYPES)).persist()
        try:
            routed = dim_route(kept, rules).withColumn("rowkey", F.col("data")[F.col("row_key_column")])
            number = F.lit(batch_id).alias("_batch")
            overwrite_partitions(routed.filter(F.col("rowkey").isNotNull()).select(
                "sink_table", "rowkey", "data", (F.col("type") == "delete").alias("deleted"), *ORDER,
                F.current_date().alias("_arrived"), number,
            ), f"{self.path}/changes", "sink_table", "_arrived", "_batch")
            known = rules.filter(F.col("sink_type") == "dim").select(F.col("source_table").alias("table")).distinct()
            lost = kept.join(known, "table", "left_anti").select("table", "type", "data", *ORDER, F.lit("no rule").alias("reason"), number)
            keyless = routed.filter(F.col("rowkey").isNull()).select(
                "table", "type", "data", *ORDER, F.lit("no key").alias("reason"), number)
            seen = Observation("rejected")
            rejected = lost.unionByName(keyless).observe(
                seen, F.count(F.lit(1)).alias("records"), F.count_if(F.col("reason") == "no rule").alias("no_rule"),
                F.count_if(F.col("reason") == "no key").alias("no_key"))
            overwrite_partitions(rejected, f"{self.path}/rejected", "_batch")
            self.last_rejected = seen.get
        finally:
            kept.unpersist()

    def table(self, name: str) -> KeyedTable | None:
        """One dimension table with the columns its rule names now; None without a rule."""
        rule = self.rules().filter((F.col("sink_type") == "dim") & (F.col("sink_table") == name)).first()
        if rule is None:
            return None
        columns = [c for c in table_columns(rule.sink_columns, rule.sink_row_key) if c != rule.sink_row_key]

        def changes(since: str | None) -> DataFrame | None:
            rows = read_if_there(self.spark, f"{self.path}/changes")
            if rows is None:
                return None
            mine = rows.filter(F.col("sink_table") == name)
            if since is not None:
                mine = mine.filter(F.col("_arrived") >= F.lit(since).cast("date"))
            return mine.select("rowkey", *[F.col("data")[c].alias(c) for c in columns], "deleted", *ORDER)

        return KeyedTable(self.spark, f"{self.path}/tables/{name}", "rowkey", columns, ORDER, mode="cell", changes=changes)


def publish_dimension(dims: DimensionTables, name: str, database: str = "default") -> None:
    """Put the rows of this moment into the catalog table that ``apply_table_ddl`` made for the dimension."""
    table = dims.table(name)
    rows = None if table is None else table.read()
    if rows is not None:
        target = f"`{database}`.`{name}`"
        key, *columns = dims.spark.table(target).columns
        rows.select(F.col("rowkey").alias(key), *columns).write.insertInto(target, overwrite=True)


def as_dimension(table: KeyedTable) -> DataFrame | None:
    """A table's rows of this moment as ``(rowkey, info)`` for the lookup operators."""
    now = table.read()
    return None if now is None else now.select(
        F.col(table.key).cast("string").alias("rowkey"), F.struct(*table.columns).alias("info"))


def with_fresh(
    build: Callable[..., DataFrame], write: Write, **openers: Callable[[], DataFrame],
) -> Write:
    """``foreachBatch`` writer of ``build(batch, name=...)``, the named tables opened anew each batch.

    ``with_fresh(lambda batch, users: enrich(batch, users, ...), sink, users=lambda: as_dimension(table))``
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        write(build(batch, **{name: open_() for name, open_ in openers.items()}), batch_id)

    return run


# --- facts by configuration ------------------------------------------------------

def fact_router(path: str, rules: Callable[[], DataFrame], database: str | None = None) -> Write:
    """``foreachBatch`` writer: facts to one folder of lines per topic under ``path``, by the rules of the batch.

    One write a batch; a batch that comes again replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = route_by_topic(dwd_route(batch, rules(), database))
        rows.write.mode("overwrite").partitionBy("topic").text(f"{path}/batch_id={batch_id}")

    return write


# --- the change log, parsed once -------------------------------------------------

def change_log_writer(path: str) -> Write:
    """``foreachBatch`` writer of raw change-log texts: parsed once, stored by table, a task's rows of a table in order of their day.

    Texts that do not parse are stored beside the log in the same pass (``bad_changes``).  Each task writes its rows
    where it has them, one file a table: nothing is shuffled, and files do not multiply with days.  The days of a
    file are told apart by its statistics, so the jobs on top read their tables' parts, and of those their days, only.
    A batch of many small tasks has as many small files; ``coalesce`` it before.
    """
    def write(raw: DataFrame, batch_id: int) -> None:
        rows = cdc_rows(raw).withColumn("day", F.to_date("rt"))
        rows = rows.withColumn("bad", F.col(CORRUPT).isNotNull().cast("int")).withColumnRenamed(CORRUPT, "text")
        # What could be read of a bad record is not stored.
        rows = rows.select("text", "bad", *[
            F.when(F.col("bad") == 0, F.col(c)).alias(c) for c in rows.columns if c not in ("text", "bad")])
        # A table that is never null, as an empty name is stored like none: else the writer sorts once more, by table alone.
        rows = rows.withColumn("table", F.coalesce("table", F.lit(""))).sortWithinPartitions("bad", "table", "day")
        with shuffles_dropped(raw.sparkSession):
            (rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bad", "table")
             .parquet(f"{path}/log/batch_id={batch_id}"))

    return write


def _stored_rows(spark: SparkSession, path: str, bad: int) -> DataFrame:
    rows = spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log")
    rows = rows.filter(F.col("bad") == bad).drop("batch_id", "bad")
    return rows.select(*[c for c in rows.columns if c != "day"], "day")


def stored_change_log(spark: SparkSession, path: str) -> DataFrame:
    """What ``change_log_writer`` stored; a filter on ``table`` or ``day`` reads that part only."""
    return _stored_rows(spark, path, 0).drop("text")


def bad_changes(spark: SparkSession, path: str) -> DataFrame:
    """The texts that did not parse."""
    return _stored_rows(spark, path, 1).select(F.col("text").alias("value"))


# --- wide facts --------------------------------------------------------------------

class OrderFacts:
    """The wide order fact under ``path``, one row per order line, partitioned by the day the order was made.

    ``write`` takes what ``streams.order_facts`` releases, ``settle`` pairs the parts that came late with the
    stored rows.  A row that was settled later replaces the earlier one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.table = KeyedTable(
            spark, f"{self.path}/details", "order_detail_id", S.order_detail_columns("rt"), ["version"], partition="day")

    def _put(self, rows: DataFrame, version: Column, batch_id: int) -> None:
        self.table.write(rows.select(
            "*", date_part("create_time").alias("day"), version.alias("version"), F.lit(False).alias("deleted")), batch_id)

    def write(self, released: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` writer of ``streams.order_facts``."""
        kept = released.persist()
        try:
            self._put(order_details(kept), F.lit(0).cast("long"), batch_id)
            late = late_parts(kept).select("*", F.current_date().alias("_arrived"), F.lit(batch_id).alias("_batch"))
            overwrite_partitions(late, f"{self.path}/late", "_arrived", "_batch")
        finally:
            kept.unpersist()

    def late(self, since: str | None = None) -> DataFrame | None:
        """The parts that found no partner in time, those that arrived from the day ``since`` on."""
        rows = read_if_there(self.spark, f"{self.path}/late")
        return rows if rows is None or since is None else rows.filter(F.col("_arrived") >= F.lit(since).cast("date"))

    def settle(self, since: str | None = None) -> None:
        """Pair late parts with the stored rows; run it now and then.  Doing it again changes nothing."""
        late = self.late(since)
        if late is not None:
            none = self.spark.createDataFrame([], S.order_detail_schema("rt"))
            facts = self.table.read()
            self._put(reassembled(late, none if facts is None else facts), F.unix_timestamp(), -1)

    def read(self, days: list[str] | None = None) -> DataFrame | None:
        """The wide rows, of orders made on ``days`` if given: other days' files are not read."""
        return self.table.read(parts=days)


def cancel_fact_writer(facts: OrderFacts, path: str, write: Write) -> Write:
    """``foreachBatch`` writer of cancelled orders (``cdc.order_cancel``): their wide rows go to ``write``.

    Of the facts only the days that the batch's orders were made on are read.  An order whose lines are not
    there yet waits under ``path`` and is looked up again with the next batch.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        waiting = read_if_there(facts.spark, f"{path}/waiting")
        orders = batch
        if waiting is not None:
            orders = orders.unionByName(waiting.filter(F.col("_batch") == batch_id - 1).select(*batch.columns))
        orders = orders.persist()
        try:
            made = F.coalesce(date_part("create_time"), F.lit(""))
            days = sorted(r[0] for r in orders.select(made).distinct().collect())  # as many as there are days
            lines = facts.read(days) if days else None
            lines = facts.spark.createDataFrame([], S.order_detail_schema("rt")) if lines is None else lines
            write(cancel_detail(orders, lines), batch_id)
            left = orders.join(lines, orders["id"] == lines["order_id"], "left_anti")
            overwrite_partitions(left.withColumn("_batch", F.lit(batch_id)), f"{path}/waiting", "_batch")
        finally:
            orders.unpersist()

    return run


# --- summaries beside dimensions of the moment -----------------------------------------

class FlatSkus:
    """``flatten_sku`` kept as a table: a change on any level works out anew only the skus under it.

    ``tables`` opens the six levels by name (sku, spu, trademark, category3, category2, category1).
    """

    def __init__(self, spark: SparkSession, path: str, tables: Callable[[], dict[str, DataFrame]]) -> None:
        self.tables = tables
        self.table = KeyedTable(spark, path, "sku_id", SKU_ATTRIBUTES, ["version"])

    def write(self, changed: dict[str, DataFrame] | None, batch_id: int) -> None:
        """After the levels have changed; ``changed`` has the ``id`` of what was put or deleted, by level (None: everything)."""
        levels, flat = self.tables(), self.table.read()
        if changed is None or flat is None:
            rows = flatten_sku(**levels).withColumn("deleted", F.lit(False))
        else:
            ids = skus_under(flat, changed)
            fresh = flatten_sku(**{**levels, "sku": levels["sku"].join(ids, levels["sku"]["id"] == ids["sku_id"], "left_semi")})
            # What has no row any more is gone.
            rows = ids.join(fresh.withColumn("deleted", F.lit(False)), "sku_id", "left").fillna({"deleted": True})
        self.table.write(rows.select("sku_id", *SKU_ATTRIBUTES, "deleted", F.lit(batch_id).alias("version")), batch_id)

    def read(self) -> DataFrame:
        """The flat table of this moment."""
        return self.table.read()


def sku_summary_writer(skus: Callable[[], DataFrame], write: Write) -> Write:
    """``foreachBatch`` writer of ``streams.sku_summary``: names are looked up in the table of the moment."""
    return with_fresh(lambda batch, flat: enrich_sku(batch, flat).select(*S.SKU_SUMMARY), write, flat=skus)


def province_summary_writer(provinces: Callable[[], DataFrame], write: Write) -> Write:
    """``foreachBatch`` writer of ``streams.province_summary``, as above."""
    return with_fresh(
        lambda batch, names: enrich(batch, names, "province_id", {"province_name": "name"}, "id").select(*S.PROVINCE_SUMMARY),
        write, names=provinces)
