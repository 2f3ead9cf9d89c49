"""JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DataType, MapType, NumericType, StringType, StructField, StructType,
)

from tidemark.functions.times import _col

CORRUPT = "_corrupt_record"


def _struct(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _relaxed(kind: DataType) -> DataType:
    """``kind`` with texts in place of numbers: JSON numbers may come quoted."""
    if isinstance(kind, NumericType):
        return StringType()
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _relaxed(f.dataType), True) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(_relaxed(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(_relaxed(kind.keyType), _relaxed(kind.valueType))
    return kind


def parsed(df: DataFrame, schema: str | StructType, value: str = "value") -> DataFrame:
    """Parse ``value`` once; adds the schema's columns and ``_corrupt_record``.

    ``_corrupt_record`` holds the text of a record that is no JSON object of the
    given shape, else null.  Numbers may be quoted; a text that is no number gives
    null.  Rows with a null value are dropped: they are deletion markers, not records.
    """
    text, shape = F.col(value), _struct(schema)
    relaxed = _relaxed(shape).add(CORRUPT, StringType())
    body = F.from_json(text, relaxed, {"columnNameOfCorruptRecord": CORRUPT})
    fields = [
        (F.col(f"_body.`{f.name}`") if _relaxed(f.dataType) == f.dataType
         else F.col(f"_body.`{f.name}`").try_cast(f.dataType)).alias(f.name)
        for f in shape.fields
    ]
    keep = [F.col(c) for c in df.columns if c != value]
    # A one-element explode makes the parsed record a column of its own: filters
    # on its fields stay above it instead of each parsing the text again.
    rows = df.filter(text.isNotNull()).select(*keep, text, F.explode(F.array(body)).alias("_body"))
    broken = F.when(
        F.col("_body").isNull() | ~F.startswith(F.ltrim(text), F.lit("{")), text
    ).otherwise(F.col(f"_body.{CORRUPT}"))
    return rows.select(*keep, *fields, broken.alias(CORRUPT))


def count_records(df: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """``df``, counted as it passes: observed metrics ``name`` with ``records`` and one count per condition.

    No pass of its own.  Read them with an ``Observation`` of that name, or on streams with
    ``streaming.RecordCounts``.
    """
    return df.observe(name, F.count(F.lit(1)).alias("records"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def parse_json(
    df: DataFrame, schema: str | StructType, value: str = "value", count_as: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split raw records into parsed rows and the texts that could not be parsed.

    ``count_as`` names a ``count_records`` of both, ``records`` and ``bad``.
    """
    rows = parsed(df, schema, value)
    if count_as:
        rows = count_records(rows, count_as, bad=F.col(CORRUPT).isNotNull())
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias(value))
    return good, bad


def to_json_rows(df: DataFrame, value: str = "value") -> DataFrame:
    """Every row as one JSON text; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(value))


def set_field(struct: Column | str, name: str, value: Column) -> Column:
    """Set one field of a nested record."""
    return _col(struct).withField(name, value)
