"""Numbers that travel as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.times import _col

MONEY = "decimal(18,2)"


def money(col: Column | str) -> Column:
    """A money amount; text that is no number gives null."""
    return _col(col).try_cast(MONEY)


def coalesce0(col: Column | str) -> Column:
    """A money amount with null replaced by zero."""
    return F.coalesce(money(col), F.lit(0).cast(MONEY))


def cast_delta(new: Column | str, old: Column | str) -> Column:
    """Difference of two integers held as text, again as text."""
    return (_col(new).try_cast("int") - _col(old).try_cast("int")).cast("string")
