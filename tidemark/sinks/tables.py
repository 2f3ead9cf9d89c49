"""Keyed tables: a partitioned folded table and the changes beside it.

A micro-batch appends its changes, by the day it arrived.  ``rewrite`` is a plain batch job: it
folds changes into the partitions they touch and overwrites those.  Folding is a maximum per
key, deletes and order values included, so a change that is folded twice, late or in any
order changes nothing: readers fold the table and the changes together, and neither
needs to know how far the other has come.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.changes import cells_now, fold_cells, merge_cells

NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_there(spark: SparkSession, path: str, **options: str) -> DataFrame | None:
    """The Parquet table at ``path``; None while nothing was written.  Other errors are raised."""
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in NOTHING_THERE:
            return None
        raise


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df``; of the table at ``path`` only the partitions it has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class FoldedTable:
    """One row per ``key`` at ``path``, folded from changes.

    Subclasses say how changes fold, and what a reader sees.  The table is partitioned by
    ``partition``, a change column that depends on the key alone (such as the day an order was
    made), or by a hash of the key in ``parts`` parts.  ``changes`` takes the place of the
    table's own changes where several tables share them.

    ``since``, a day, leaves out changes that arrived before it.  That is right from the day of
    the last ``rewrite`` on; how long changes are kept is up to the owner of the folder.
    ``before``, a batch, leaves out that batch and later ones.  One rewrite at a time; a
    reader that a rewrite has overtaken reads again.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str, columns: Sequence[str], parts: int = 16, partition: str | None = None,
        changes: Callable[[str | None], DataFrame | None] | None = None,
    ) -> None:
        self.spark, self.path, self.key, self._written = spark, path.rstrip("/"), key, list(columns)
        self.partition, self.parts, self._shared = partition, parts, changes

    def _fold(self, changes: DataFrame) -> DataFrame:
        """One row per key of ``changes``, with ``_part``; columns that ``merge_cells`` may take the maximum of."""
        raise NotImplementedError

    def _shown(self, folded: DataFrame) -> DataFrame:
        raise NotImplementedError

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` writer: append the changes of one micro-batch.  A batch that comes again replaces itself."""
        named = dict.fromkeys([self.key, *self._written, *([self.partition] if self.partition else [])])
        rows = batch.select(*named).withColumn("_arrived", F.current_date()).withColumn("_batch", F.lit(batch_id))
        overwrite_partitions(rows, f"{self.path}/changes", "_arrived", "_batch")

    def _changes(self, since: str | None, before: int | None) -> DataFrame | None:
        rows = self._shared(since) if self._shared else read_if_there(self.spark, f"{self.path}/changes")
        if rows is None:
            return None
        if since is not None and not self._shared:
            rows = rows.filter(F.col("_arrived") >= F.lit(since).cast("date"))
        if before is not None:
            rows = rows.filter(F.col("_batch") < before)
        part = F.col(self.partition) if self.partition else F.pmod(F.xxhash64(self.key), F.lit(self.parts))
        return rows.withColumn("_part", F.concat(F.lit("p"), F.coalesce(part.cast("string"), F.lit(""))))  # text, whatever it looks like

    def _folded(self, since: str | None, parts: Sequence[str] | None, before: int | None) -> DataFrame | None:
        """Table and changes, of the given partitions, as one row per key that knows what later changes are compared with."""
        def pruned(rows: DataFrame | None) -> DataFrame | None:
            return rows if rows is None or parts is None else rows.filter(F.col("_part").isin(*[f"p{x}" for x in parts]))

        base = pruned(read_if_there(self.spark, f"{self.path}/table"))
        changes = pruned(self._changes(since, before))
        if base is None or changes is None:
            return base if changes is None else self._fold(changes)
        return merge_cells(base.unionByName(self._fold(changes), allowMissingColumns=True), self.key)

    def read(self, since: str | None = None, parts: Sequence[str] | None = None, before: int | None = None) -> DataFrame | None:
        """The table now, or None while nothing was written; ``parts`` are the partitions to read."""
        folded = self._folded(since, None if parts is None else list(parts), before)
        return None if folded is None else self._shown(folded)

    def rewrite(self, since: str | None = None, before: int | None = None) -> list[str]:
        """Fold the changes into the table; returns the partitions they touched, which are overwritten."""
        changes = self._changes(since, before)
        if changes is None:
            return []
        touched = sorted(r[0][1:] for r in changes.select("_part").distinct().collect())  # ``parts``, or days, at most
        if touched:
            overwrite_partitions(self._folded(since, touched, before), f"{self.path}/table", "_part")
        return touched


class KeyedTable(FoldedTable):
    """The newest state of each key.

    ``mode`` is ``"row"`` (a change replaces the whole row) or ``"cell"`` (null leaves the older
    value).  ``order`` are change columns that sort the changes of a key; where they are
    equal a put counts as later than a delete and the larger row (or value) as later than
    the smaller.  ``deleted`` is a boolean change column.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str, columns: Sequence[str], order: Sequence[str],
        deleted: str = "deleted", mode: str = "row", parts: int = 16, partition: str | None = None,
        changes: Callable[[str | None], DataFrame | None] | None = None,
    ) -> None:
        if mode not in ("row", "cell"):
            raise ValueError(f"mode must be 'row' or 'cell', not {mode!r}")
        self.columns, self.mode = [c for c in columns if c != key], mode
        self.order, self.deleted = list(order), deleted
        super().__init__(spark, path, key, [*self.columns, *self.order, deleted], parts, partition, changes)

    def _fold(self, changes: DataFrame) -> DataFrame:
        part = F.max("_part").alias("_part")
        if self.mode == "cell":
            return fold_cells(changes, self.key, self.columns, self.order, F.col(self.deleted), part)
        put = ~F.coalesce(F.col(self.deleted), F.lit(False))
        row = F.struct(F.struct(*self.order).alias("at"), put.alias("put"), F.struct(*self.columns).alias("row"))
        return changes.groupBy(self.key).agg(F.max(row).alias("_newest"), part)

    def _shown(self, folded: DataFrame) -> DataFrame:
        if self.mode == "cell":
            return cells_now(folded, self.key, self.columns).filter("_present").select(self.key, *self.columns)
        return folded.filter("_newest.put").select(self.key, *[F.col(f"_newest.row.`{c}`") for c in self.columns])


class FirstsTable(FoldedTable):
    """First and last of what was seen of each key: ``least`` and ``greatest`` columns, times or dates.

    A job over a new day (or micro-batch) needs no more of all the history before it.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str, least: Sequence[str] = (), greatest: Sequence[str] = (),
        parts: int = 16, partition: str | None = None,
    ) -> None:
        self.least, self.greatest = list(least), list(greatest)
        super().__init__(spark, path, key, [*least, *greatest], parts, partition)

    def _fold(self, changes: DataFrame) -> DataFrame:
        # Counted down, the least is a maximum, too.
        least = [(-F.unix_micros(F.col(c).cast("timestamp"))).alias(f"_least_{c}") for c in self.least]
        rows = changes.select(self.key, "_part", *least, *self.greatest)
        return rows.groupBy(self.key).agg(*[F.max(c).alias(c) for c in rows.columns if c != self.key])

    def _shown(self, folded: DataFrame) -> DataFrame:
        return folded.select(
            self.key, *[F.timestamp_micros(-F.col(f"_least_{c}")).alias(c) for c in self.least], *self.greatest)
