"""Reading tables, writing intermediate tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage with files every executor can read: a lost executor costs
    only the tasks it was running, and nothing upstream is computed twice.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``rows`` rows, so that Python objects of few texts live at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns of these names, in any case: an operator's own columns take their place."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def release_memory(keep: str | None = None) -> None:
    """Give back what earlier tasks of this Python worker left behind: caches of other modules than ``keep``, free memory.

    Workers are used again by later stages; without this each would hold the most any stage needed.
    """
    for name in _CACHES.keys() - {keep}:
        _CACHES[name].clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


_CACHES: dict[str, dict] = {}


def cache_of(name: str) -> dict:
    """A dict that lives as long as tasks of the module ``name`` follow each other in a worker."""
    return _CACHES.setdefault(name, {})
