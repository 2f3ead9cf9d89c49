"""Config-driven routing of change-log records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas as S
from tidemark.functions.jsons import parse_json
from tidemark.functions.maps import prune_columns
from tidemark.operators.firsts import last_per_key

DIM_KEY = ("source_table",)
FACT_KEY = ("source_table", "source_type")


def read_config_changes(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parse the routing table's change feed: one row per change.

    Gives ``op``, ``ts_ms``, the row image (the old one for deletes) and the old
    image's ``source_table``/``source_type``/``sink_type`` as ``old_*``; and the bad records.
    """
    good, bad = parse_json(raw, S.CONFIG_CHANGE, value)
    deleted = F.col("op") == "d"
    image = [
        F.when(deleted, F.col(f"before.{c}")).otherwise(F.col(f"after.{c}")).alias(c)
        for c in S.TABLE_PROCESS_COLUMNS
    ]
    carried = [c for c in good.columns if c not in ("op", "ts_ms", "before", "after")]
    return good.select(
        "op", "ts_ms", *carried, *image,
        F.col("before.source_table").alias("old_source_table"),
        F.col("before.source_type").alias("old_source_type"),
        F.col("before.sink_type").alias("old_sink_type"),
    ), bad


def apply_config(
    snapshot: DataFrame, changes: DataFrame, sink_type: str, keys: Sequence[str] | None = None,
    order: Sequence[str] = ("ts_ms",),
) -> DataFrame:
    """The routing table after ``changes``, for one ``sink_type``.

    ``keys`` are those of ``sink_type`` unless given.  The newest change of a key
    wins: a delete removes the row, anything else puts its image.  A change that
    moves a row to another key also removes the old key.  At equal times a put
    counts as later than a removal, and of two puts the larger image.
    """
    columns = S.TABLE_PROCESS_COLUMNS
    keys = list(keys or (DIM_KEY if sink_type == "dim" else FACT_KEY))
    mine = changes.filter(F.col("sink_type") == sink_type)
    moved = F.lit(False)
    for k in keys:
        moved = moved | ~F.col(f"old_{k}").eqNullSafe(F.col(k))
    left = mine.filter(F.col("old_source_table").isNotNull() & moved & (F.col("op") != "d"))
    gone = left.select(
        *[F.col(f"old_{k}").alias(k) for k in keys],
        *[F.lit(None).cast("string").alias(c) for c in columns if c not in keys],
        F.lit("d").alias("op"), *order,
    )
    events = mine.select(*columns, "op", *order).unionByName(gone.select(*columns, "op", *order))
    put_last = events.withColumn("_put", (F.col("op") != "d").cast("int"))
    newest = last_per_key(put_last, keys, [*order, "_put", *[c for c in columns if c not in keys]])
    untouched = snapshot.filter(F.col("sink_type") == sink_type).select(*columns).join(
        newest.select(*keys), keys, "left_anti"
    )
    put = newest.filter(F.col("op") != "d").select(*columns)
    return untouched.unionByName(put)


def one_rule(config: DataFrame, sink_type: str, keys: Sequence[str]) -> DataFrame:
    """The rules of ``sink_type``, one per key: of several the one that sorts last."""
    mine = config.filter(F.col("sink_type") == sink_type)
    others = [c for c in S.TABLE_PROCESS_COLUMNS if c not in keys and c in mine.columns]
    return last_per_key(mine, keys, others)


def dim_route(log: DataFrame, config: DataFrame, database: str | None = None) -> DataFrame:
    """Change-log records of configured dimension tables, cut to the configured columns.

    Adds ``sink_table``, ``sink_extend``, ``row_key_column`` and ``family``.
    Records that only mark start and end of a bulk load are dropped.
    """
    if database is not None:
        log = log.filter(F.col("database") == database)
    rules = one_rule(config, "dim", DIM_KEY).select(
        F.col("source_table").alias("table"), "sink_table", "sink_extend",
        F.col("sink_row_key").alias("row_key_column"), F.col("sink_family").alias("family"),
        "sink_columns",
    )
    rows = log.filter(~F.col("type").isin(*S.NOT_ROUTED_TYPES)).join(rules, "table")
    return rows.withColumn("data", prune_columns("data", "sink_columns")).drop("sink_columns")


def dwd_route(log: DataFrame, config: DataFrame, database: str | None = None) -> DataFrame:
    """Change-log records whose table and operation are configured as facts.

    Cuts ``data`` to the configured columns and adds ``sink_topic``.
    """
    if database is not None:
        log = log.filter(F.col("database") == database)
    rules = one_rule(config, "dwd", FACT_KEY).select(
        F.col("source_table").alias("table"), F.col("source_type").alias("type"),
        F.col("sink_table").alias("sink_topic"), "sink_columns",
    )
    rows = log.join(rules, ["table", "type"])
    return rows.withColumn("data", prune_columns("data", "sink_columns")).drop("sink_columns")


def route_by_topic(df: DataFrame, topic: str = "sink_topic", payload: str = "data") -> DataFrame:
    """``(topic, value)`` rows for a topic sink: the payload alone, as JSON."""
    return df.select(F.col(topic).alias("topic"), F.to_json(payload).alias("value"))
