"""Date and time expressions.

``tz`` is a zone id such as ``UTC`` or ``+08:00``; left out, the session zone
(``spark.sql.session.timeZone``) is used, as Spark's own functions do.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE = "yyyy-MM-dd"
DATETIME = "yyyy-MM-dd HH:mm:ss"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_epoch(col: Column | str, unit: str = "ms") -> Column:
    """Epoch seconds (``s``) or milliseconds (``ms``) as a timestamp."""
    if unit not in ("s", "ms"):
        raise ValueError(f"unit must be 's' or 'ms', not {unit!r}")
    return F.timestamp_seconds(_col(col)) if unit == "s" else F.timestamp_millis(_col(col))


def epoch_ms(col: Column | str) -> Column:
    return F.unix_millis(_col(col))


def _wall(ts: Column, tz: str | None) -> Column:
    if tz is None:
        return ts
    return F.convert_timezone(None, F.lit(tz), ts.cast("timestamp_ntz"))


def day_of(ts: Column | str, tz: str | None = None) -> Column:
    """Calendar day of a timestamp, as a date (four bytes, so aggregates stay hashed)."""
    return F.to_date(_wall(_col(ts), tz))


def to_date_text(ms: Column | str, tz: str | None = None) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd``."""
    return F.date_format(_wall(from_epoch(ms), tz), DATE)


def to_datetime_text(ms: Column | str, tz: str | None = None) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(_wall(from_epoch(ms), tz), DATETIME)


def to_ts(text: Column | str, full: bool = True, tz: str | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` (or ``yyyy-MM-dd`` when not ``full``) as epoch milliseconds.

    Text that does not parse gives null.
    """
    text = _col(text)
    if not full:
        text = F.concat(text, F.lit(" 00:00:00"))
    if tz is None:
        return F.unix_millis(F.try_to_timestamp(text, F.lit(DATETIME)))
    zoned = F.concat(text, F.lit(f" {tz}"))
    return F.unix_millis(F.try_to_timestamp(zoned, F.lit(DATETIME + " VV")))


def event_time(text: Column | str) -> Column:
    """Event time out of a datetime text; null where it does not parse."""
    return F.try_to_timestamp(_col(text), F.lit(DATETIME))


def date_part(text: Column | str) -> Column:
    """The date part of a datetime text: what stands before the first blank."""
    return F.substring_index(_col(text), " ", 1)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))
