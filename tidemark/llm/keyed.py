"""Token ids on disk: shards of raw id payloads with a minimal perfect hash index.

A store is a folder with, per shard,

* ``shard-N.ids``: the ids of its documents one after the other, little-endian
  unsigned integers of ``width`` bytes, in ascending doc_id order;
* ``shard-N.idx``: an ``.npz`` of the index (see :class:`PerfectHash`), one slot per
  key (fingerprint, first record) and one row per record (first id, ids).

Shards hold neighbouring keys.  The manifest, one row per shard, tells which.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import table, text_batches
from tidemark.llm.registry import query
from tidemark.llm.tokens import encoder
from tidemark.session import shared_dir

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix, another one for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Keys to 0..n-1 without gaps, about 3.5 bits a key.

    Level k hashes the keys left to ``gamma`` times as many bits; a bit is set where
    exactly one key falls, the others go on to level k + 1.  A key's slot is the
    number of set bits before its own.  Keys that no level parts (never seen in
    practice) are listed behind the levels.
    """

    def __init__(self, bits: np.ndarray, starts: np.ndarray, rest: np.ndarray):
        self.bits, self.starts, self.rest = bits, starts, rest
        ones = np.cumsum(np.bitwise_count(bits).astype(np.int64))
        self.before = np.concatenate([[0], ones])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, levels: int = 40) -> "PerfectHash":
        """``keys``: distinct unsigned 64-bit values."""
        words, starts, left = [], [0], keys
        for level in range(levels):
            if not len(left):
                break
            size = max(1, int(len(left) * gamma + 63) // 64)
            at = (_mix(left, level) % np.uint64(size * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=size * 64) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            starts.append(starts[-1] + size)
            left = left[~alone[at]]
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        return cls(bits, np.array(starts, np.int64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in gets any slot, or -1."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level in range(len(self.starts) - 1):
            if not len(open_):
                break
            start, end = self.starts[level], self.starts[level + 1]
            at = (_mix(keys[open_], level) % np.uint64((end - start) * 64)).astype(np.int64)
            word, bit = start + at // 64, (at % 64).astype(np.uint64)
            value = self.bits[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            found[open_[hit]] = (self.before[word] + below)[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            found[open_[same]] = self.before[-1] + at[same]
        return found


def _key_hashes(keys: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, fingerprint) of each key; they are independent of each other."""
    import xxhash

    wide = [xxhash.xxh3_128_intdigest(b"" if k is None else int(k).to_bytes(8, "little", signed=True)) for k in keys]
    return (np.array([w & (2**64 - 1) for w in wide], "<u8"),
            np.array([w >> 96 for w in wide], "<u4"))


def _files(uri: str):
    """The folder's file system, as executors reach it, and its path there."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:"):])


@dataclass
class Store:
    """A folder of shards and its manifest (one row per shard, in key order)."""

    path: str
    width: int
    shards: list[dict]


def write_store(
    docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", spaced: bool = True, end_id: int = 2,
    width: int = 2, shards: int | None = None,
) -> Store:
    """Encode every document, write the shards in ascending doc_id order.

    Texts are range-partitioned by doc_id before they are encoded; Spark merges
    small ranges to its advisory size unless ``shards`` fixes their number.  A null
    or empty text has the end id only.  Null keys come first and are one key.
    Repeated keys keep all their rows, ordered by text.  ``width``: bytes an id (2
    for vocabularies of up to 65,536 ids).  Files are written under the attempt's
    own name and renamed, so a repeated task leaves the same files.
    """
    end = int(end_id).to_bytes(4, "little")
    kind = {2: "<u2", 4: "<u4"}[width]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        ids = encoder(tokenizer, spaced)
        files, folder = _files(path)
        name, keys, counts, sink = f"{folder}/shard-{shard:06d}", [], [], None
        for batch in text_batches(batches):
            if sink is None:
                files.create_dir(folder, recursive=True)
                sink = files.open_output_stream(f"{name}.ids.{attempt}")
            for doc_id, body in zip(batch.column(0).to_pylist(), ids.batch(batch.column(1).to_pylist())):
                own = np.frombuffer(body + end, "<u4")
                if width == 2 and int(own.max()) > 0xFFFF:
                    raise ValueError("ids need a width of 4")
                sink.write(own.astype(kind).tobytes())
                keys.append(doc_id)
                counts.append(len(own))
        if sink is None:
            return
        sink.close()
        records = np.array(counts, np.int64)
        first = np.concatenate([[0], np.cumsum(records)[:-1]])
        # The rows are sorted, so equal keys are neighbours.
        opens = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        hashes, prints = _key_hashes([keys[k] for k in opens])
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys of a shard share a 64-bit hash; write more shards")
        index = PerfectHash.build(hashes)
        slots = index.slots(hashes)
        slot_print, slot_record = np.zeros(len(opens), "<u4"), np.zeros((len(opens), 2), np.int64)
        slot_print[slots] = prints
        slot_record[slots, 0] = opens
        slot_record[slots, 1] = np.diff([*opens, len(keys)])
        body = io.BytesIO()
        np.savez(body, bits=index.bits, starts=index.starts, rest=index.rest, prints=slot_print,
                 slot_records=slot_record, first=first, counts=records)
        with files.open_output_stream(f"{name}.idx.{attempt}") as out:
            out.write(body.getvalue())
        for ending in ("ids", "idx"):
            files.move(f"{name}.{ending}.{attempt}", f"{name}.{ending}")
        known = [k for k in keys if k is not None]
        yield pa.RecordBatch.from_pylist([{
            "shard": shard, "low": known[0] if known else None, "has_null": len(known) < len(keys),
            "n_records": len(keys), "n_ids": int(records.sum())}], schema=_MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    manifest = ranged.sortWithinPartitions("doc_id", "text").mapInArrow(write, _MANIFEST_DDL)
    # One narrow row per shard.
    found = sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["shard"])
    before = 0
    for row in found:
        row["ids_before"], before = before, before + row["n_ids"]
    return Store(path, width, found)


_MANIFEST = pa.schema([
    ("shard", pa.int32()), ("low", pa.int64()), ("has_null", pa.bool_()), ("n_records", pa.int64()), ("n_ids", pa.int64())])
_MANIFEST_DDL = "shard int, low long, has_null boolean, n_records long, n_ids long"


class Shard:
    """One opened shard: constant-time look-ups of keys."""

    def __init__(self, path: str, shard: int, width: int):
        files, folder = _files(path)
        name = f"{folder}/shard-{shard:06d}"
        with files.open_input_stream(f"{name}.idx") as source:
            saved = np.load(io.BytesIO(source.read()))
            self.data = {k: saved[k] for k in saved.files}
        self.index = PerfectHash(self.data["bits"], self.data["starts"], self.data["rest"])
        self.body, self.width = files.open_input_file(f"{name}.ids"), width

    def get(self, keys: list[int | None]) -> list[list[tuple[int, np.ndarray]]]:
        """Per key its records as (first id of the shard, ids); none for a key that is not stored.

        A key that was never stored passes its fingerprint once in 2**32 times.
        """
        if not keys or not len(self.data["prints"]):
            return [[] for _ in keys]
        hashes, prints = _key_hashes(keys)
        slots = self.index.slots(hashes)
        known = (slots >= 0) & (self.data["prints"][slots] == prints)
        found = []
        for slot, ok in zip(slots.tolist(), known.tolist()):
            record, n = self.data["slot_records"][slot].tolist() if ok else (0, 0)
            found.append([self._record(k) for k in range(record, record + n)])
        return found

    def _record(self, k: int) -> tuple[int, np.ndarray]:
        first, count = int(self.data["first"][k]), int(self.data["counts"][k])
        body = self.body.read_at(count * self.width, first * self.width)
        return first, np.frombuffer(body, f"<u{self.width}").astype("<u4")


def lookup(store: Store, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored record of each distinct key.

    Keys are sent to their shard by the manifest's bounds (one row per shard); each
    task opens its shards' indexes and reads only the payload of its keys.  Keys
    that are not stored give no row.
    """
    path, width, shards = store.path, store.width, store.shards
    if not shards:
        return keys.sparkSession.createDataFrame([], _FOUND)
    bounded = [s for s in shards if s["low"] is not None]
    lows = np.array([s["low"] for s in bounded], np.int64)
    numbers = np.array([s["shard"] for s in bounded], np.int32)
    null_shard = next((s["shard"] for s in shards if s["has_null"]), None)
    before = {s["shard"]: s["ids_before"] for s in shards}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            at = np.searchsorted(lows, np.array([0 if k is None else k for k in own], np.int64), "right") - 1
            target = [null_shard if k is None else int(numbers[i]) if i >= 0 else None
                      for k, i in zip(own, at.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(target, pa.int32())], ["doc_id", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Shard] | None = None
        for batch in text_batches(batches, 4096):
            own, targets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for shard in sorted(set(targets)):
                if opened is None or opened[0] != shard:
                    opened = shard, Shard(path, shard, width)
                asked = [k for k, t in zip(own, targets) if t == shard]
                for key, records in zip(asked, opened[1].get(asked)):
                    rows += [(key, before[shard] + first, len(ids), zlib.crc32(ids.tobytes())) for first, ids in records]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    routed = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(
        route, "doc_id long, shard int").filter("shard is not null")
    return routed.repartition(len(shards), "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(read, _FOUND)


_FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"


@query("op10_keyed_token_store")
def keyed_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as id shards, then each looked up by its key."""
    docs = table(spark, sf_dir, "documents")
    store = write_store(docs, shared_dir(spark, "token-store"))
    return lookup(store, docs)
