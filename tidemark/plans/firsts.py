"""Firsts over days and micro-batches, with what came before kept as a small table.

A run aggregates its own rows first, per task and then per key, and meets one row per key
of the history; so neither a hot key nor a long history makes a task large.  Each takes
the rows of a day or a micro-batch with its number, in order, and can be given the same
batch again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.times import day_of
from tidemark.operators import traffic
from tidemark.operators.firsts import flag_first_of_day, login_first_of_day, order_first_flags
from tidemark.sinks.tables import FirstsTable

Write = Callable[[DataFrame, int], None]


class LoginDays:
    """``login_first_of_day`` day by day; of all logins before only each user's last day is kept."""

    def __init__(self, spark: SparkSession, path: str, key: str = "uid", ts: str = "rt", back_days: int = 7, tz: str | None = None) -> None:
        self.key, self.ts, self.back_days, self.tz = key, ts, back_days, tz
        self.table = FirstsTable(spark, path, key, greatest=["cur_date"])

    def run(self, logins: DataFrame, batch_id: int) -> DataFrame:
        """First logins of whole days, later ones than those before."""
        history = self.table.read(before=batch_id)
        days = login_first_of_day(logins, self.key, self.ts, self.back_days, self.tz, history)
        self.table.write(days.groupBy(self.key).agg(F.max("cur_date").alias("cur_date")), batch_id)
        return days


class OrderUsers:
    """``order_first_flags`` day by day; of all orders before only each user's first time is kept."""

    def __init__(self, spark: SparkSession, path: str, key: str = "user_id", ts: str = "rt", day: str | None = None) -> None:
        self.key, self.ts, self.day = key, ts, day
        self.table = FirstsTable(spark, path, key, least=[ts])

    def run(self, orders: DataFrame, batch_id: int) -> DataFrame:
        """First orders of whole days, later ones than those before."""
        days = order_first_flags(orders, self.key, self.ts, self.day, self.table.read(before=batch_id))
        self.table.write(days.groupBy(self.key).agg(F.min(self.ts).alias(self.ts)), batch_id)
        return days


class DayFlags:
    """``flag_first_of_day`` batch by batch; the keys of a day are kept in that day's partition."""

    def __init__(self, spark: SparkSession, path: str, key: str, ts: str, tie: list[str], flag: str = "uv", tz: str | None = None) -> None:
        self.key, self.ts, self.tie, self.flag, self.tz = key, ts, tie, flag, tz
        self.table = FirstsTable(spark, path, "_key_day", least=["_first"], greatest=["_key", "_day"], partition="_day")

    def run(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """All rows, 1 on those that are the first of their key and day; days may come in any order."""
        day, key = day_of(self.ts, self.tz), F.col(self.key).cast("string")
        keyed = rows.filter(key.isNotNull()).groupBy(key.alias("_key"), day.alias("_day")).agg(F.min(self.ts).alias("_first"))
        days = sorted(str(r[0]) for r in rows.select(day.alias("d")).filter("d IS NOT NULL").distinct().collect())
        known = self.table.read(parts=days, before=batch_id)
        known = None if known is None else known.select("_key", "_day")
        self.table.write(keyed.withColumn("_key_day", F.to_json(F.struct("_key", "_day"))), batch_id)
        return flag_first_of_day(rows, self.key, self.ts, self.tie, self.flag, self.tz, known)


class VisitorLog:
    """Log repair and split batch by batch; of each visitor two times are kept.

    The texts of a batch stay in their tasks: only (visitor, time, flag) is aggregated, so a
    visitor with half of the records makes no task larger.
    """

    def __init__(self, spark: SparkSession, path: str, tz: str | None = None) -> None:
        self.tz = tz
        self.table = FirstsTable(spark, path, "_visitor", least=["_first_new", "_first_old"])

    def run(self, raw: DataFrame, batch_id: int) -> DataFrame:
        """``(topic, value)`` rows of the batch."""
        heads = traffic.log_heads(raw)
        timed = heads.withColumn("_at", F.timestamp_millis("ts"))
        self.table.write(traffic.first_seen(timed, "mid", "_at", "is_new"), batch_id)
        return traffic.split_log_records(traffic.repair_log(heads, self.tz, history=self.table.read(before=batch_id)))


def batch_writer(firsts, write: Write) -> Write:
    """``foreachBatch`` writer of what ``firsts.run`` makes of each batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write(firsts.run(batch, batch_id), batch_id)

    return run
