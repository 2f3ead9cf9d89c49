"""Benchmark passages in documents: a prefix-filtered join on word windows."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import stored, table, text_batches, without
from tidemark.llm.registry import query

WINDOW = 10
# Text bytes of the items that one pass over the documents looks for.
BLOCK_BYTES = 8 << 20

_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, a-z and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Every run of ``size`` words; a shorter text that has words is one window."""
    return [tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def _shingles(words: list[bytes] | tuple[bytes, ...]) -> list[bytes]:
    """Pairs of neighbouring words; a single word is its own shingle."""
    return [a + b" " + b for a, b in zip(words, words[1:])] or list(words)


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Items in blocks of about ``block_bytes`` of text.  Each block is what a task may hold."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    return [items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def shingle_counts(docs: DataFrame, wanted: set[bytes]) -> DataFrame:
    """(shingle, n): how often each wanted shingle occurs in the documents, summed per batch first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in text_batches(batches):
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                seen.update(filter(wanted.__contains__, words))
                seen.update(filter(wanted.__contains__, map(b" ".join, zip(words, words[1:]))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["shingle", "n"])

    return docs.select("text").mapInArrow(count, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


class PrefixIndex:
    """Windows by their rarest shingle.

    All shingles of a window have to be in the document, so the prefix a candidate
    must share is one shingle, the rarest.  An entry keeps its place in the window
    and the window's length: a document place gives the only start the window can
    have, and a window that would pass either end is no candidate.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], size: int, counts: dict[bytes, int]):
        self.owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            for window in windows_of(words_of(text), size):
                self.owners[window].update([] if item_id is None else [item_id])
        self.pairs: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        self.single: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for window in self.owners:
            prefix = min((counts.get(s, 0), s, k) for k, s in enumerate(_shingles(window)))
            (self.pairs if len(window) > 1 else self.single)[prefix[1]].add((prefix[2], len(window)))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, window) of each occurrence, each checked word by word."""
        n, owners = len(words), self.owners
        for known, shingles in ((self.pairs, map(b" ".join, zip(words, words[1:]))), (self.single, words)):
            if not known:
                continue
            for at, shingle in enumerate(shingles):
                if shingle in known:
                    for offset, length in known[shingle]:
                        start = at - offset
                        if start >= 0 and start + length <= n:
                            window = tuple(words[start:start + length])
                            if window in owners:
                                yield start, window


_FOUND = "n_words long, ranges array<struct<start:long,end:long>>, items array<string>"


def _hits(rows: DataFrame, items: list, size: int, counts: dict[bytes, int]) -> DataFrame:
    """``rows`` (text last) with each row's words, its merged hit ranges and the items found."""
    index = PrefixIndex(items, size, counts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            n_words, ranges, found = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = words_of(text)
                spans, owners = [], set()
                for start, window in sorted(index.find(words)):
                    owners |= index.owners[window]
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], start + len(window))
                    else:
                        spans.append([start, start + len(window)])
                n_words.append(len(words))
                ranges.append([{"start": a, "end": b} for a, b in spans])
                found.append(sorted(owners))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()),
                 pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "n_words", "ranges", "items"])

    return rows.mapInArrow(find, StructType([*rows.schema.fields, *StructType.fromDDL(_FOUND).fields]))


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` (any columns) with n_words, hit word ranges and the sorted ids of items with a window in it.

    Documents are scanned where they lie; what travels to them is a block of items
    of bounded size, so frequent words make no hot key.  More items than a block
    holds take more passes, whose hits are joined per row.  Null texts have no
    words; a null item_id hits words but is not listed; an item without words has
    no window; repeated rows are reported each.  Columns named like the new ones are
    replaced.
    """
    docs = without(docs, ["_row", "n_words", "ranges", "items"])
    others = [c for c in docs.columns if c != "text"]
    blocks = _blocks(items, block_bytes)
    rows = docs.select(*others, "text")
    several = len(blocks) > 1
    if several:  # row numbers that every pass agrees on
        rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), *others, "text"), "decontaminate")
    parts = []
    for block in blocks:
        own = [(r.item_id, r.text) for r in block.collect()]
        wanted = {s for _, text in own for w in windows_of(words_of(text), size) for s in _shingles(w)}
        counts = {bytes(r.shingle): r.n for r in shingle_counts(rows, wanted).collect()} if wanted else {}
        parts.append(_hits(rows.select("_row", "text") if several else rows, own, size, counts))
    if not several:
        return parts[0]
    whole = parts[0].drop("text")
    for part in parts[1:]:
        whole = whole.union(part.drop("text"))
    merged = whole.groupBy("_row", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = F.aggregate(
        "ranges", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (r["start"] <= F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"),
                F.greatest(F.element_at(done, -1)["end"], r["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(r))))
    merged = merged.withColumn("ranges", F.when(F.size("ranges") > 0, step).otherwise(F.col("ranges")))
    return rows.join(merged, "_row").drop("_row")


@query("op6_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
