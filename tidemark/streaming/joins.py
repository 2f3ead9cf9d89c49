"""Wide facts assembled on streams, without losing what comes late.

The parts of an order (the order, its lines, the activities and coupons of lines) wait
in one place.  When the watermark has passed the first of them by a bound, what
belongs together leaves as wide rows, and what found no partner leaves as it came.
State ends there; a part that comes later waits its own time and leaves as late, and
``reassembled`` pairs it with the stored facts.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from tidemark import schemas as S
from tidemark.operators.facts import order_detail_wide
from tidemark.operators.joins import seconds
from tidemark.operators.traffic import spread_null_keys

# Ship the processor with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER, LINE, ACTIVITY, COUPON = PARTS = ["order_info", "order_detail", "order_detail_activity", "order_detail_coupon"]
DETAIL = "detail"
PART = StructType([StructField("kind", StringType()), StructField("at", LongType()), StructField("row", StringType())])
RELEASED = StructType([
    StructField("kind", StringType()), StructField("rt", TimestampType()), StructField("row", StringType()),
])


def order_parts(log: DataFrame, database: str | None = None) -> DataFrame:
    """The parts of orders out of one reading of the change log: ``order_id``, ``kind``, ``rt``, ``row`` (JSON, all fields)."""
    wanted = F.col("table").isin(*PARTS) & (F.col("type") == "insert")
    if database is not None:
        wanted = wanted & (F.col("database") == database)
    data = F.col("data")
    order_id = F.when(F.col("table") == ORDER, data["id"]).otherwise(data["order_id"])
    return log.filter(wanted).select(
        order_id.alias("order_id"), F.col("table").alias("kind"), "rt", F.to_json("data").alias("row"))


def _wide(order: dict, line: dict, activity: dict | None, coupon: dict | None) -> dict:
    row = {"order_id": order["id"], **{c: order.get(c) for c in S.ORDER_INFO[1:]}}
    row |= {"order_detail_id": line["id"], **{c: line.get(c) for c in S.DETAIL_OF_LINE}}
    for name, part, columns in (("activity", activity, S.DETAIL_OF_ACTIVITY), ("coupon", coupon, S.DETAIL_OF_COUPON)):
        row |= {f"order_detail_{name}_id": part and part["id"], **{c: part and part.get(c) for c in columns}}
    return row


def _release(parts: list[tuple[str, int, str]]) -> list[tuple[str, int, str]]:
    """Wide rows of the parts that belong together, and the parts without a partner."""
    found = {kind: [] for kind in PARTS}
    for kind, at, text in parts:
        found[kind].append((at, json.loads(text), text))
    if not found[ORDER] or not found[LINE]:
        return parts
    out, lines = [], {line["id"] for _, line, _ in found[LINE]}
    by_line = {kind: {} for kind in (ACTIVITY, COUPON)}
    for kind, of_line in by_line.items():
        for at, part, text in found[kind]:
            if part.get("order_detail_id") in lines:
                of_line.setdefault(part["order_detail_id"], []).append(part)
            else:
                out.append((kind, at, text))
    for at, order, _ in found[ORDER]:
        for _, line, _ in found[LINE]:
            for activity in by_line[ACTIVITY].get(line["id"], [None]):
                for coupon in by_line[COUPON].get(line["id"], [None]):
                    out.append((DETAIL, at, json.dumps(_wide(order, line, activity, coupon))))
    return out


class OrderParts(StatefulProcessor):
    """Holds an order's parts until the watermark has passed the first one by ``bound_ms``."""

    def __init__(self, bound_ms: int) -> None:
        self.bound_ms = bound_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", PART)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [(kind, int(at), row) for pdf in rows
                 for kind, at, row in pdf.iloc[:, 1:].itertuples(index=False, name=None)]
        if not self.parts.exists():
            due = min(at for _, at, _ in found) + self.bound_ms
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        self.parts.appendList(found)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        released = _release([tuple(p) for p in self.parts.get()])
        self.parts.clear()
        kinds, times, rows = zip(*released)
        yield pd.DataFrame({"kind": kinds, "rt": pd.to_datetime(list(times), unit="ms", utc=True).tz_localize(None), "row": rows})

    def close(self) -> None:
        pass


def released_orders(parts: DataFrame, bound: str = "24 hours") -> DataFrame:
    """``order_parts`` with a watermark on ``rt`` to ``(kind, rt, row)``: wide rows (kind "detail") and parts without a partner.

    Nothing is dropped: a part behind the watermark waits for its timer like any other.
    """
    # As a number the time carries no watermark, so rows behind it are not thrown away.
    packed = parts.select(
        spread_null_keys(F.col("order_id"), "rt").alias("_key"), "kind", F.unix_millis("rt").alias("at"), "row")
    return packed.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=OrderParts(seconds(bound) * 1000), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime")


def _fields(names: list[str]) -> list[Column]:
    return [F.col("_data")[n].alias(n) for n in names]


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_data", F.explode(F.array(F.from_json("row", "map<string,string>"))))


def order_details(released: DataFrame) -> DataFrame:
    """The wide rows of ``released_orders``."""
    columns = [c for c in S.order_detail_columns("rt") if c != "rt"]
    return _parsed(released.filter(F.col("kind") == DETAIL)).select("rt", *_fields(columns)).select(*S.order_detail_columns("rt"))


def late_parts(released: DataFrame) -> DataFrame:
    """The parts of ``released_orders`` that found no partner."""
    return released.filter(F.col("kind") != DETAIL)


def reassembled(late: DataFrame, facts: DataFrame) -> DataFrame:
    """Wide rows of the orders that late parts belong to, from the parts and the stored wide ``facts``.

    The facts of those orders are taken apart, joined by the late parts and put together
    again.  Parts that still lack a partner give no row; they stay in ``late``.
    """
    parts = _parsed(late)

    def late_of(kind: str, columns: list[str], *more: str) -> DataFrame:
        return parts.filter(F.col("kind") == kind).select(*_fields(columns), *more)

    ids = parts.select(F.when(F.col("kind") == ORDER, F.col("_data")["id"]).otherwise(F.col("_data")["order_id"]).alias("_id"))
    lines = parts.select(F.col("_data")["order_detail_id"].alias("_line")).filter("_line IS NOT NULL").distinct()
    of_lines = facts.join(lines, facts["order_detail_id"] == lines["_line"], "left_semi").select(F.col("order_id").alias("_id"))
    ids = ids.union(of_lines).filter("_id IS NOT NULL").distinct()
    met = facts.join(ids, facts["order_id"] == ids["_id"], "left_semi")
    orders = met.select(F.col("order_id").alias("id"), *S.ORDER_INFO[1:], "rt").union(late_of(ORDER, S.ORDER_INFO, "rt"))
    line_columns = ["id", "order_id", *S.DETAIL_OF_LINE]
    of_facts = met.select(F.col("order_detail_id").alias("id"), "order_id", *S.DETAIL_OF_LINE)

    def extras(name: str, kind: str, columns: list[str]) -> DataFrame:
        known = met.filter(F.col(f"order_detail_{name}_id").isNotNull()).select(
            F.col(f"order_detail_{name}_id").alias("id"), "order_detail_id", *columns)
        return known.union(late_of(kind, ["id", "order_detail_id", *columns])).dropDuplicates(["id", "order_detail_id"])

    return order_detail_wide(
        orders.dropDuplicates(["id"]), of_facts.union(late_of(LINE, line_columns)).dropDuplicates(["id"]),
        extras("activity", ACTIVITY, S.DETAIL_OF_ACTIVITY), extras("coupon", COUPON, S.DETAIL_OF_COUPON))


def cancel_detail(cancelled: DataFrame, order_detail: DataFrame, time: str = "pt") -> DataFrame:
    """Cancelled orders joined with the wide fact, however old their lines are.

    A cancellation can come long after the order; looking the lines up in the
    table the order job has written needs no state at all.
    """
    lines = order_detail.select(
        F.col("order_id").alias("_order_id"), *[c for c in S.order_detail_columns("rt")[25:]])
    orders = cancelled.withColumnRenamed("id", "order_id")
    return orders.join(lines, orders["order_id"] == lines["_order_id"]).select(*S.order_detail_columns(time))
