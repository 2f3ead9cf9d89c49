"""Maps with open key sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.times import _col


def prune_columns(data: Column | str, columns: Column | str) -> Column:
    """Keep the map entries whose key stands in the comma list ``columns``.

    The list is data (it comes from the routing table), so this is an
    expression over the map and not a projection.
    """
    wanted = F.transform(F.split(_col(columns), ","), lambda c: F.trim(c))
    return F.map_filter(_col(data), lambda key, _: F.array_contains(wanted, key))


def put_keys(data: Column | str, **entries: Column) -> Column:
    """Set map entries, replacing those already there."""
    names = list(entries)
    added = F.create_map(*[x for n in names for x in (F.lit(n), entries[n])])
    return F.map_concat(F.map_filter(_col(data), lambda key, _: ~key.isin(*names)), added)
