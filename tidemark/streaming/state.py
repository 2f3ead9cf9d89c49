"""Operators that remember something per key.

They run on ``transformWithStateInPandas`` and need the RocksDB state store
(``use_rocksdb_state``).  Rows of a key come in Arrow batches, in any order
within a micro-batch; each batch is put in time order before it is worked on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from tidemark import schemas as S
from tidemark.functions.times import DATE, day_of
from tidemark.operators.traffic import NO_KEY, spread_null_keys

# Ship the processors with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEEN_BEFORE = "1970-01-01"  # fixed value: first day of visitors who were known already
TEXT = StructType([StructField("text", StringType())])
ROW_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


INPUT = ["_key", "_at", "_day", "_flag", "_row"]


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Name the columns, which come numbered, and sort by time."""
    return pdf.set_axis(INPUT, axis=1).sort_values("_at", kind="stable", ignore_index=True)


class _LastDay(StatefulProcessor):
    """Keeps one day per key, for ``ttl_ms`` of wall-clock time if given."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("day", TEXT, self.ttl_ms)

    def get(self) -> str | None:
        return self.state.get()[0] if self.state.exists() else None

    def close(self) -> None:
        pass


class VisitorRepair(_LastDay):
    """Keeps a visitor's first day and clears the new flag on later ones."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0].startswith(NO_KEY):  # nobody's records stay as they are
            for pdf in rows:
                pdf = pdf.set_axis(INPUT, axis=1)
                yield pdf[["_at", "_row", "_flag"]]
            return
        first = self.get()
        if first is None:
            # The first day is that of the earliest of all records at hand; of two at
            # the same instant the one that says new counts as earlier.
            pdfs = [p.set_axis(INPUT, axis=1) for p in rows]
            heads = pd.concat([p[["_at", "_day", "_flag"]] for p in pdfs])
            heads = heads.assign(_old=heads["_flag"] != "1").sort_values(["_at", "_old"], kind="stable")
            head = heads.iloc[0]
            first = head["_day"] if head["_flag"] == "1" else SEEN_BEFORE
            self.state.update((first,))
        else:
            pdfs = (p.set_axis(INPUT, axis=1) for p in rows)
        for pdf in pdfs:
            late = (pdf["_flag"] == "1") & (pdf["_day"] != first)
            yield pd.DataFrame({
                "_at": pdf["_at"], "_row": pdf["_row"], "_flag": pdf["_flag"].mask(late, "0"),
            })


class DailyFirst(StatefulProcessor):
    """Flags the first record of every key and day, in whatever order days come.

    A day is remembered for ``ttl_ms`` of wall-clock time.  A key's days are read and added to
    together: every question to the state store is a way to the JVM and back.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getListState("seen_days", TEXT, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The earliest of a day may stand in any of the batches.
        pdf = _in_order(pd.concat([p.set_axis(INPUT, axis=1) for p in rows]))
        flags = ~pdf["_day"].duplicated()
        if key[0].startswith(NO_KEY):  # nobody has no first
            flags[:] = False
        if flags.any():
            flags &= ~pdf["_day"].isin([day for (day,) in self.days.get()])
            fresh = [(day,) for day in pdf["_day"][flags]]
            if fresh:
                self.days.appendList(fresh)
        yield pd.DataFrame({
            "_at": pdf["_at"], "_row": pdf["_row"], "_uv": flags.astype("int64"),
        })

    def close(self) -> None:
        pass


class DayFirsts(StatefulProcessor):
    """Lets through the first record of every key and day.

    A day is remembered until the watermark has passed its end (and the margin
    ``slack_days``, for days that are not those of the event time).  With
    ``history`` the latest day of a key is kept for good, and each record tells
    how many days before its own that was.
    """

    def __init__(self, history: bool, slack_days: int) -> None:
        self.history, self.slack_days = history, slack_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", TEXT, TEXT)
        self.last = handle.getValueState("last", TEXT) if self.history else None

    def _end_ms(self, day: str) -> int:
        # 14 hours later the day is over in every zone west of UTC as well.
        end = pd.Timestamp(day, tz="UTC") + pd.Timedelta(days=1 + self.slack_days, hours=14)
        return int(end.timestamp() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.history and self.last.exists() else None
        for pdf in rows:
            pdf = _in_order(pdf).drop_duplicates("_day")
            fresh = pdf[[not self.days.containsKey((d,)) for d in pdf["_day"]]]
            gaps = []
            for day in fresh["_day"]:
                self.days.updateValue((day,), ("",))
                self.handle.registerTimer(self._end_ms(day))
                gaps.append((pd.Timestamp(day) - pd.Timestamp(last)).days if last else None)
                if self.history and (last is None or day > last):
                    last = day
                    self.last.update((last,))
            yield pd.DataFrame({
                "_at": fresh["_at"], "_row": fresh["_row"], "_day": fresh["_day"],
                "_gap": pd.array(gaps, dtype="Int32"),
            })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = [d for (d,) in self.days.keys() if self._end_ms(d) <= now]
        for day in over:
            self.days.removeKey((day,))
        return iter([])

    def close(self) -> None:
        pass


def _stateful(
    df: DataFrame, key: str, ts: str, processor: StatefulProcessor, extra: list[StructField],
    mode: str, day=None, flag: str | None = None, tz: str | None = None,
) -> DataFrame:
    """Run a processor over key, time, day and flag; the row itself rides along as text.

    Rows without a key go along under keys that begin with ``NO_KEY``, some hundreds
    of them, so that they neither vanish nor meet in one group.  Packing the row keeps the processors apart from the columns around them, and
    long or nested values whole on the way through pandas.
    """
    rest = [c for c in df.columns if c != ts]
    packed = df.select(
        spread_null_keys(F.col(key), ts).alias("_key"), F.col(ts).alias("_at"),
        F.date_format(day_of(ts, tz) if day is None else F.col(day), DATE).alias("_day"),
        (F.col(flag) if flag else F.lit(None).cast("string")).alias("_flag"),
        F.to_json(F.struct(*rest), ROW_JSON).alias("_row"),
    )
    out = StructType([StructField("_at", TimestampType()), StructField("_row", StringType()), *extra])
    done = packed.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode=mode,
        eventTimeColumnName="_at" if mode == "EventTime" else "",
    )
    schema = df.select(*rest).schema
    # One-element explode: unpack each row once, whatever is read from it.
    body = F.explode(F.array(F.from_json("_row", schema, ROW_JSON)))
    return done.select(
        F.col("_at").alias(ts), *[f.name for f in extra], body.alias("_row")
    ).select(ts, *[f.name for f in extra], *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def repair_is_new_stream(df: DataFrame, key: str, ts: str, flag: str, tz: str | None = None) -> DataFrame:
    """Streaming form of ``repair_is_new``; a visitor's first day is kept for good.

    Rows without a key pass unchanged.
    """
    rows = _stateful(
        df, key, ts, VisitorRepair(), [StructField("_flag", StringType())], "None", flag=flag, tz=tz
    )
    return rows.withColumn(flag, F.col("_flag")).select(*df.columns)


def repair_log_stream(heads: DataFrame, tz: str | None = None) -> DataFrame:
    """``repair_is_new_stream`` on ``log_heads``; the record's text rides along unparsed."""
    timed = heads.withColumn("_time", F.timestamp_millis("ts"))
    return repair_is_new_stream(timed, "mid", "_time", "is_new", tz).select(*heads.columns)


def daily_first_flag_stream(
    df: DataFrame, key: str, ts: str, flag: str = "uv", ttl_ms: int = 86_400_000, tz: str | None = None,
) -> DataFrame:
    """Streaming form of ``flag_first_of_day``: every row, with 1 on a key's first of a day.

    A key's day is forgotten ``ttl_ms`` of wall-clock time after its first record.
    Rows without a key get 0.
    """
    rows = _stateful(
        df, key, ts, DailyFirst(ttl_ms), [StructField("_uv", LongType())], "ProcessingTime", tz=tz
    )
    return rows.withColumnRenamed("_uv", flag).select(*df.columns, flag)


DAY = [StructField("_day", StringType()), StructField("_gap", IntegerType())]


def day_firsts_stream(
    df: DataFrame, keys: Sequence[str], ts: str = "rt", day: str | None = None, tz: str | None = None,
) -> DataFrame:
    """First record per key and day, whole, with ``cur_date``; ``ts`` keeps its watermark.

    So a windowed summary can follow in the same query.  State ends with the day.
    """
    return _firsts(df, keys, ts, False, day, tz).drop("_gap")


def _firsts(df, keys, ts, history, day, tz) -> DataFrame:
    keys = list(keys)
    # Several key columns become one; to_json keeps them apart whatever they hold.
    packed = df
    for k in keys:
        packed = packed.filter(F.col(k).isNotNull())
    key = F.to_json(F.struct(*keys)) if len(keys) > 1 else F.col(keys[0])
    rows = _stateful(
        packed.withColumn("_group", key), "_group", ts, DayFirsts(history, 1 if day else 0),
        DAY, "EventTime", day=day, tz=tz,
    )
    return rows.withColumn("cur_date", F.col("_day").cast("date")).drop("_group", "_day")


def login_firsts_stream(
    logins: DataFrame, key: str = "uid", ts: str = "rt", back_days: int = 7, tz: str | None = None,
) -> DataFrame:
    """Streaming form of ``login_first_of_day``; the last login day is kept for good."""
    rows = _firsts(logins.select(key, ts), [key], ts, True, None, tz)
    back = F.when(F.col("_gap") >= back_days, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return rows.select(key, ts, "cur_date", F.lit(1).cast("bigint").alias("uu"), back.alias("back"))


def order_firsts_stream(
    orders: DataFrame, key: str = "user_id", ts: str = "rt", day: str | None = None,
    tz: str | None = None,
) -> DataFrame:
    """Streaming form of ``order_first_flags``; who ordered before is kept for good."""
    columns = [key, ts] + ([day] if day else [])
    rows = _firsts(orders.select(*columns), [key], ts, True, day, tz)
    new = F.when(F.col("_gap").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return rows.select(key, ts, "cur_date", new.alias("is_new"))
