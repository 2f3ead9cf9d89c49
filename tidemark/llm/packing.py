"""Best-fit packing of token sequences with a fixed number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import table, text_batches
from tidemark.llm.registry import query
from tidemark.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
OPEN_BINS = 2048


class OpenBins:
    """At most ``limit`` open bins, found by their free space.

    Bit f of ``levels`` is set while a bin with free space f is open.  The best fit
    for a length is the lowest set bit from that length on; when a new bin is
    needed and all are open, the fullest (the lowest set bit) is closed.
    """

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.levels, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """(bin number, offset) for a piece of ``length`` up to ``size``."""
        fits = self.levels >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.levels & -self.levels).bit_length() - 1)
            number, free = self.made, self.size
            self.made += 1
        if free > length:  # a full bin is closed at once
            self.bins[free - length].append(number)
            self.levels |= 1 << (free - length)
            self.open += 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        self.open -= 1
        if not self.bins[free]:
            self.levels &= ~(1 << free)
        return number


def token_pieces(
    docs: DataFrame, size: int = 2048, tokenizer: str = "word_bpe_49k.json", spaced: bool = False, end_id: int = 0
) -> DataFrame:
    """Documents encoded, ended by ``end_id`` and cut into pieces of ``size`` ids; ids as a checksum.

    A null text is empty, its only id is the end mark.  The ids stay in the task.
    """
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer, spaced)
        for batch in text_batches(batches):
            rows: list[list] = [[], [], [], [], []]
            found = ids.batch(batch.column(1).to_pylist())
            for doc_id, body in zip(batch.column(0).to_pylist(), found):
                body += end
                for number, at in enumerate(range(0, len(body), 4 * size)):
                    part = body[at:at + 4 * size]
                    for column, value in zip(rows, (doc_id, number, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(rows)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def pack(pieces: DataFrame, size: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """Give each piece a sequence and a gapless place in it.

    Whole pieces of ``size`` fill a sequence each.  The others arrive in an order
    drawn from a hash of their values and go to the best fitting open bin of their
    task.  Only these narrow rows are shuffled, and Spark makes partitions of its
    advisory size, so few bins stay half full at the ends of tasks.  Repeated rows
    are packed each; which of two equal rows comes first makes no difference.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(size, open_bins)
        for batch in batches:
            places = [bins.put(length) for length in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([first + n for n, _ in places], pa.int64()),
                 pa.array([at for _, at in places], pa.int64())],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    return (
        pieces.hint("rebalance", "ids_crc32").withColumn("_order", order)
        .sortWithinPartitions("_order", "doc_id", "piece", "start", "length")
        .mapInArrow(packed, PACKED)
    )


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return pack(token_pieces(table(spark, sf_dir, "documents")))
