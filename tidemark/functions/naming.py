"""Column naming conventions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame


def to_snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def to_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part[:1].upper() + part[1:] for part in rest)


def snake_case(df: DataFrame, drop: Iterable[str] = ()) -> DataFrame:
    """camelCase columns as snake_case, without the helper columns in ``drop``."""
    df = df.drop(*drop)
    return df.withColumnsRenamed({c: to_snake(c) for c in df.columns})


def camel_case(df: DataFrame) -> DataFrame:
    """snake_case columns as camelCase."""
    return df.withColumnsRenamed({c: to_camel(c) for c in df.columns})
