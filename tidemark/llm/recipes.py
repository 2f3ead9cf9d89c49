"""Exact copies found by recipes of content-defined chunks.

A text is cut where a hash of the bytes before a place says so, so equal texts are
cut alike.  Each distinct chunk gets an identifier that is verified by its bytes:
chunks with equal keys are brought together, once per distinct content and task, and
where one key has several contents these are numbered.  A text's recipe is the list of
its chunks' identifiers; texts are equal exactly if their recipes are.  From then on
only recipes travel, about a hundredth of the text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import stored, table, text_batches
from tidemark.llm.registry import query

# A chunk holds 512 to 8,192 bytes, about 1,500 on average; a text's last one may be shorter.
LEAST_BYTES = 512
MOST_BYTES = 8192
CUT_BITS = 10
# Bytes of a chunk's key.
KEY_BYTES = 16
# A cut depends on so many bytes before it; a power of two below LEAST_BYTES.
WINDOW = 32
# Bytes hashed at a time, whatever the length of a text.
HASHED_BYTES = 1 << 18
# A group's copies are joined with its answer in so many parts.
SALTS = 16

_BASE = 0x9E3779B1
_BYTES = np.random.default_rng(13).integers(0, 2**32, 256, dtype=np.uint32)


def cut_places(data: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places behind which ``data`` may be cut: where the hash of the last WINDOW bytes ends in zeros."""
    found = []
    for at in range(0, len(data), HASHED_BYTES):
        start = max(0, at - WINDOW + 1)
        h = _BYTES[data[start:at + HASHED_BYTES]]
        n = 1
        while n < WINDOW and len(h) > n:
            h = h[:-n] * np.uint32(pow(_BASE, n, 2**32)) + h[n:]
            n *= 2
        if n == WINDOW:
            # The high bits depend on every byte of the window.
            found.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + (start + WINDOW))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(texts: list[bytes], bits: int = CUT_BITS) -> list[list[int]]:
    """Where the chunks of each text end.  An empty text has none."""
    places = cut_places(np.frombuffer(b"".join(texts), np.uint8), bits).tolist()
    found, base = [], 0
    for text in texts:
        end, at, ends = base + len(text), base, []
        while end - at > LEAST_BYTES:
            i = bisect_left(places, at + LEAST_BYTES)
            cut = places[i] if i < len(places) else end
            cut = min(cut, at + MOST_BYTES, end)
            ends.append(cut - base)
            at = cut
        if at < end:
            ends.append(len(text))
        found.append(ends)
        base = end
    return found


def _lowered(column: pa.Array) -> list[bytes]:
    """UTF-8 of the texts with A-Z lower-cased; null is empty."""
    return [t or b"" for t in pc.ascii_lower(column).cast(pa.binary()).to_pylist()]


def _chunks(texts: list[bytes], key_bytes: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """(key, bytes) of each text's chunks."""
    from xxhash import xxh3_128_digest

    for text, ends in zip(texts, chunk_ends(texts)):
        bodies = [text[a:b] for a, b in zip([0, *ends], ends)]
        yield [(xxh3_128_digest(body)[:key_bytes], body) for body in bodies]


def keyed_recipes(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, sha, n_bytes, n_chunks, recipe) per row: its chunks' keys in order, not verified yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = _lowered(batch.column(1))
            recipes = [b"".join(key for key, _ in chunks) for chunks in _chunks(texts, key_bytes)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(r) // key_bytes for r in recipes], pa.int64()), pa.array(recipes, pa.binary()),
            ], ["doc_id", "sha", "n_bytes", "n_chunks", "recipe"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, sha binary, n_bytes long, n_chunks long, recipe binary")


def chunk_bodies(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, sha, seq, key, body): every chunk of every row with its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 64):
            texts = _lowered(batch.column(1))
            rows = [
                (doc_id, sha, seq, key, body)
                for doc_id, text, chunks in zip(batch.column(0).to_pylist(), texts, _chunks(texts, key_bytes))
                for sha in [hashlib.sha256(text).digest()]
                for seq, (key, body) in enumerate(chunks)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32()),
                pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary()),
            ], ["doc_id", "sha", "seq", "key", "body"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, sha binary, seq int, key binary, body binary")


def distinct_chunks(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """The chunk store (key, body, n_places): each content once, folded per task before it moves."""
    return chunk_bodies(docs, key_bytes).groupBy("key", "body").agg(F.count(F.lit(1)).alias("n_places"))


def _numbers(docs: DataFrame, key_bytes: int) -> DataFrame | None:
    """(doc_id, sha, numbers): for rows with chunks whose key stands for several contents, (place, number of the content).

    None if every key stands for one content, which comparing the contents has shown.
    """
    several = stored(
        distinct_chunks(docs, key_bytes).groupBy("key").agg(F.count(F.lit(1)).alias("contents"))
        .filter("contents > 1").select("key"), "unclear-keys")
    if several.isEmpty():
        return None
    unclear = chunk_bodies(docs, key_bytes).join(several, "key")
    number = F.row_number().over(Window.partitionBy("key").orderBy("body"))
    contents = stored(unclear.select("key", "body").distinct().withColumn("number", number), "unclear-contents")
    return unclear.join(contents, ["key", "body"]).groupBy("doc_id", "sha").agg(
        F.sort_array(F.collect_set(F.struct("seq", "number"))).alias("numbers"))  # bounded by the text


def recipes(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, sha, n_bytes, n_chunks, recipe, numbers) per row of ``docs`` (doc_id, text).

    recipe and numbers together are the ordered list of verified identifiers: two rows
    have equal ones exactly if their texts, A-Z lower-cased, are equal byte by byte.
    """
    rows = stored(keyed_recipes(docs, key_bytes), "recipes")
    none = F.expr("cast(array() as array<struct<seq:int,number:int>>)")
    numbers = _numbers(docs, key_bytes)
    if numbers is None:
        return rows.withColumn("numbers", none)
    joined = rows.alias("r").join(
        numbers.alias("n"), F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.sha") == F.col("n.sha")), "left")
    return joined.select("r.*", F.coalesce("n.numbers", none).alias("numbers"))


def exact_copies(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks): one row per row of ``docs``.

    Rows are copies if their texts are equal once A-Z is lower-cased; null counts as
    empty.  Of a group the row with the largest doc_id stays; null ids come last, and of
    rows that also share the doc_id one stays.  Only doc_id and text are read; other
    columns may have any name.  An empty table gives no rows; the length of a text has
    no bound.  Copies are counted per task first, and a group's answer goes back to its
    rows in SALTS parts.
    """
    list_of_ids = ["recipe", "numbers"]
    members = recipes(docs, key_bytes).groupBy(*list_of_ids, "doc_id", "sha", "n_chunks").agg(
        F.count(F.lit(1)).alias("times")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    groups = members.groupBy(*list_of_ids).agg(
        F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")
    ).filter("group_size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keep_id = F.when(F.isnull("group_size"), F.col("doc_id")).otherwise(F.col("keep_id"))
    return members.join(groups, [*list_of_ids, "salt"], "left").select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"), "sha", "n_chunks",
    ).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "n_chunks")


@query("op13_chunk_recipes", """
    WITH t AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
        FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(low) AS text_sha256
    FROM t WINDOW same AS (PARTITION BY low)""")
def chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among all documents."""
    return exact_copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
