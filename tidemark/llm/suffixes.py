"""Exact repeats of long byte strings, found by sorting suffixes in two stages.

A suffix array of all texts does not fit one machine, so suffixes that can share
``length`` bytes are first brought together.  Of the 48-byte strings inside a
window of ``length`` bytes the one with the least hash is its anchor: equal windows
have equal anchors at equal places.  Neighbouring windows with the same anchor form
a piece; only pieces with the same anchor can hold equal windows.  Anchors and
pieces are counted as hashes.  A piece that occurs again as a whole is repeated
without further work, so copies of any number are only counted; the others are
sorted, anchor by anchor, with one copy of each distinct piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import release_memory, stored, table, text_batches, without
from tidemark.llm.registry import query

LENGTH = 200
ANCHOR = 48
# Text bytes hashed, and sorted, at a time; a longer text is hashed in blocks.
HASHED_BYTES = 1 << 18
SORTED_BYTES = 1 << 18
# An anchor with more distinct pieces has its windows counted by fingerprint.
HOT_PIECES = 2048
SEPARATOR = 0xFF  # never in UTF-8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 2**64))


def _join(left: np.ndarray, right: np.ndarray, n: int, m: int) -> np.ndarray:
    """Hashes of n + m bytes from those of the first n and of the m behind them."""
    size = min(len(left), len(right) - n)
    return left[:size] * _power(m) + right[n:n + size]


def rolling_hashes(text: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """For each size the hash of every run of so many bytes, built from runs of powers of two, short ones first."""
    power, n = _BYTES[text], 1
    done, values = [0] * len(sizes), [None] * len(sizes)
    while True:
        for k, size in enumerate(sizes):
            if size & n:
                values[k] = power if values[k] is None else _join(values[k], power, done[k], n)
                done[k] += n
        if n * 2 > max(sizes):
            return [_mix(v) for v in values]
        power = _join(power, power, n, n)
        n *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: the ends of one block and the start of the next."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def pieces_of(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR):
    """Pieces of the texts: arrays (text, start, windows, times, anchor hash, piece hash).

    ``times`` equal pieces that follow each other, as in periodic text, are one row.
    """
    width = length - anchor + 1
    ends = np.cumsum([len(t) for t in texts])
    text = np.frombuffer(b"".join(texts), np.uint8)
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(text) < length:
        return none
    short, long = rolling_hashes(text, [anchor, length])
    least = sliding_min(short, width)
    n = len(least)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[:n]
    valid = np.arange(n) + length <= ends[owner]
    # A window hands over to the next where its anchor is left behind or beaten.
    opens = np.ones(n, bool)
    opens[1:] = (least[1:] != least[:-1]) | (short[:n - 1] == least[:-1]) | ~valid[:-1] | (owner[1:] != owner[:-1])
    opens &= valid
    start = np.flatnonzero(opens)
    if not len(start):
        return none
    closed = np.append(start[1:], n)
    # The last piece of a text ends where its last window starts.
    closed = np.minimum(closed, ends[owner[start]] - length + 1)
    size = closed - start
    weight = _mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    # Place of each window in its piece; what lies before the first piece is not valid.
    place = np.arange(n) - np.concatenate(
        [np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, n)))])
    value = np.where(valid, long * weight[np.minimum(place, width - 1)], np.uint64(0))
    piece = _mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _BASE)
    key, whose = least[start], owner[start]
    first = np.ones(len(start), bool)
    first[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1]) | (whose[1:] != whose[:-1]) | (start[1:] != closed[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(start)))
    offsets = np.concatenate([[0], ends[:-1]])
    return [whose[at], start[at] - offsets[whose[at]], size[at], times, key[at], piece[at]]


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in an order right for the first ``depth`` bytes at least.

    Only the suffixes smaller than their successors are compared directly.  The
    others follow from a scan of the buckets by first byte, from the least on: each
    suffix put in place places the one before it, if that is larger.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.sign(text[1:].astype(np.int16) - text[:-1]).astype(np.int8)
    step = np.append(step, np.int8(-1))  # the end is less than any byte
    # Among equal bytes the next change decides.
    change = np.where(step != 0, np.arange(n), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    smaller = step[change] > 0
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    keys = np.ascontiguousarray(windows[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    by_byte = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    order = []
    for byte in range(256):
        mine = [*waiting[byte]]
        last = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        while len(last):  # runs of this byte, one step longer each time
            last = last[last > 0] - 1
            last = last[(text[last] == byte) & ~smaller[last]]
            mine.append(last)
        mine.append(direct[by_byte[byte]:by_byte[byte + 1]])
        bucket = np.concatenate(mine)
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > byte]
        if len(before):
            lead = text[before]
            sort = np.argsort(lead, kind="stable")
            before, lead = before[sort], lead[sort]
            cuts = np.flatnonzero(np.diff(lead)) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    return np.concatenate(order)


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, ``depth`` at most (0 for the first)."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(words).view(">u8").ravel()
    shared = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = words[order[open_] + at] ^ words[order[open_ - 1] + at]
        same = differ == 0
        shared[open_[same]] = at + 8
        rest = open_[~same]
        bits = differ[~same].astype(np.uint64)
        lead = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            lead += bits < (np.uint64(1) << np.uint64(64 - 8 * k))
        shared[rest] = at + lead
        open_ = open_[same]
        if not len(open_):
            break
    return np.minimum(shared, depth)


def repeated_starts(bodies: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per body, which of its windows of ``length`` bytes also start elsewhere in the bodies."""
    text = np.frombuffer(b"".join(b + bytes([SEPARATOR]) for b in bodies), np.uint8)
    order = two_stage_order(text, length)
    full = adjacent_prefixes(text, order, length) >= length
    both = full | np.append(full[1:], False)
    flags = np.zeros(len(text), bool)
    flags[order] = both
    found, at = [], 0
    for body in bodies:
        found.append(flags[at:at + max(0, len(body) - length + 1)])
        at += len(body) + 1
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, count) of each run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]


_ROW = "doc_id long, h long"
_PIECES = f"{_ROW}, start long, n long, times long, anchor long, piece long"
_BODIES = "doc_id long, h long, start long, n long, anchor long, piece long, c long, body binary"
_HITS = f"{_ROW}, start long, n long"


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its id and the hash of its text; equal rows have equal repeats."""
    return docs.withColumn("h", F.xxhash64("text"))


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def find_pieces(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """All pieces of (doc_id, h, text), narrow rows of hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()

        def emit(rows, texts):
            whose, start, n, times, key, piece = pieces_of(texts, length, anchor)
            ids, hashes = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())
            start = start + np.array([r[2] for r in rows], np.int64)[whose]
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(whose)), hashes.take(pa.array(whose)), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(times, pa.int64()), pa.array(key.view(np.int64)), pa.array(piece.view(np.int64))],
                ["doc_id", "h", "start", "n", "times", "anchor", "piece"])

        rows, texts, held = [], [], 0
        for batch in text_batches(batches):
            for doc_id, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                body = _raw(text)
                # Every window starts in one block; a piece ends with its block.
                for at in range(0, len(body) - length + 1, HASHED_BYTES):
                    rows.append((doc_id, h, at))
                    texts.append(body[at:at + HASHED_BYTES + length - 1])
                    held += len(texts[-1])
                    if held >= HASHED_BYTES:
                        yield emit(rows, texts)
                        rows, texts, held = [], [], 0
        if rows:
            yield emit(rows, texts)

    return docs.select("doc_id", "h", "text").mapInArrow(run, _PIECES)


def _bodies(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted pieces, cut from the texts they were met in."""
    per_text = wanted.groupBy("doc_id", "h").agg(
        F.collect_list(F.struct("start", "n", "anchor", "piece", "c")).alias("cuts"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 64):
            out = []
            for doc_id, h, text, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                body = _raw(text)
                out += [(doc_id, h, x["start"], x["n"], x["anchor"], x["piece"], x["c"],
                         body[x["start"]:x["start"] + x["n"] + length - 1]) for x in cuts]
            columns = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())],
                ["doc_id", "h", "start", "n", "anchor", "piece", "c", "body"])

    texts = docs.select("doc_id", "h", "text").alias("d")
    joined = texts.join(per_text.alias("w"), _same_row("d", "w"))
    return joined.select("d.doc_id", "d.h", "d.text", "w.cuts").mapInArrow(run, _BODIES)


def _sorted_hits(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated windows of pieces met once, from sorting all pieces of their anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()

        def emit(group):
            out = []
            for row, flags in zip(group, repeated_starts([r[7] for r in group], length)):
                if row[6] == 1:
                    out += [(row[0], row[1], row[2] + a, n) for a, n in _runs(flags)]
            columns = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "h", "start", "n"])

        group, held, current = [], 0, None
        for batch in text_batches(batches, 1024):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= SORTED_BYTES and row[4] != current:
                    yield emit(group)
                    group, held = [], 0
                # Equal rows of the input bring a piece twice; it was counted before.
                if not group or group[-1][4:6] != row[4:6]:
                    group.append(row)
                    held += len(row[7])
                current = row[4]
        if group:
            yield emit(group)

    return bodies.repartition("anchor").sortWithinPartitions("anchor", "piece").mapInArrow(run, _HITS)


def _counted_hits(bodies: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many distinct pieces: windows counted by 128-bit fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_batches(batches, 64):
            out = []
            for doc_id, h, start, n, anchor, piece, c, body in zip(*(x.to_pylist() for x in batch.columns)):
                out += [(doc_id, h, start + k, c, xxhash.xxh3_128_digest(body[k:k + length])) for k in range(n)]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.binary())],
                ["doc_id", "h", "start", "c", "window"])

    windows = bodies.dropDuplicates(["anchor", "piece"]).mapInArrow(
        run, f"{_ROW}, start long, c long, window binary")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    return windows.filter("c = 1").join(again, "window").select("doc_id", "h", "start", F.lit(1).cast("long").alias("n"))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(doc_id, h, hits): per distinct row of (doc_id, h, text) the ranges (start, n) of its repeated windows.

    Rows without a repeat are left out.
    """
    pieces = stored(find_pieces(docs, length, anchor), "pieces")
    anchors = pieces.groupBy("anchor").agg(
        F.sum("times").alias("met"), F.min("piece").alias("p0"), F.max("piece").alias("p1")).filter("met > 1")
    shared = stored(
        pieces.join(anchors, "anchor").select(*pieces.columns, (F.col("p0") == F.col("p1")).alias("alike")), "shared-pieces")
    alike = shared.filter("alike")
    mixed = shared.filter("not alike")
    distinct = stored(mixed.groupBy("anchor", "piece").agg(
        F.sum("times").alias("c"), F.min(F.struct("doc_id", "h", "start", "n")).alias("at")), "distinct-pieces")
    # Anchors all of whose pieces are repeated need no sorting.
    sizes = distinct.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("c").alias("rarest")).filter("rarest = 1")
    wanted = distinct.join(sizes, "anchor").select("at.*", "anchor", "piece", "c", "kinds")
    bodies = stored(_bodies(docs, wanted.select("doc_id", "h", "start", "n", "anchor", "piece", "c"), length), "piece-bodies")
    hot = sizes.filter(F.col("kinds") > hot_pieces).select("anchor")
    whole = mixed.join(distinct.filter("c > 1").select("anchor", "piece"), ["anchor", "piece"])
    span = (F.col("n") * F.col("times")).alias("n")
    hits = (
        alike.select("doc_id", "h", "start", span)
        .union(whole.select("doc_id", "h", "start", span))
        .union(_sorted_hits(bodies.join(hot, "anchor", "left_anti").select(*bodies.columns), length))
        .union(_counted_hits(bodies.join(hot, "anchor", "left_semi").select(*bodies.columns), length))
    )
    return hits.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("hits"))


def removed_spans(hits: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows, from the ranges of their starts."""
    spans: list[list[int]] = []
    for start, end in sorted((x["start"], x["start"] + x["n"] - 1 + length) for x in hits or []):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans]


def _cut(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(body[at:a])
        at = b
    return b"".join([*kept, body[at:]])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (any columns, among them doc_id and text) with ``spans`` and ``kept``.

    spans: byte ranges of the UTF-8 text covered by a ``length``-byte string that also
    starts elsewhere, in this or another text; kept: the other bytes.  All copies are
    removed, judged on the input.  A null text is empty; shorter texts have no such
    string; equal rows are copies of each other.
    Columns named h, hits, spans or kept are replaced.
    """
    docs = without(docs, ["h", "spans", "kept", "hits"])
    keyed = _keyed(docs)
    found = repeats(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "h", "text"), length)
    joined = keyed.alias("d").join(found.alias("f"), _same_row("d", "f"), "left").select(
        *[F.col(f"d.{c}") for c in docs.columns], "f.hits")
    text_at, hits_at = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 256):
            spans = [removed_spans(x, length) for x in batch.column(hits_at).to_pylist()]
            kept = [_cut(_raw(t), s) for t, s in zip(batch.column(text_at).to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:hits_at],
                 pa.array([[{"start": a, "end": b} for a, b in s] for s in spans],
                          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], [*batch.schema.names[:hits_at], "spans", "kept"])

    from pyspark.sql.types import StructType

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(
        "spans array<struct<start:long,end:long>>, kept binary").fields])
    return joined.mapInArrow(run, schema)


@query("op9_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
