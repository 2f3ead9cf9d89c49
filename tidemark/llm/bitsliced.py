"""Ranked search by bit-sliced Bloom signatures.

Index: each document has a Bloom signature of its terms, and of its (term, level)
pairs: level i says that the term occurs LEVELS[i] times or more.  Signatures of
documents of similar size form a block and are stored by bit: one bitmap over the
block's documents for every bit.

Search: the bitmaps of a term's bits, ANDed, show every document that holds it, and
some that do not.  For every level the weights of an item's terms are summed over
their bitmaps; the sums, times what that level can add to a score at most, are an upper
bound of each document's score.  The documents with the highest bounds are scored
exactly, which gives a floor: the tenth best of them.  A document whose bound is below
it is provably not among the ten; all others are scored exactly on their whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import stored, table, text_batches
from tidemark.llm.registry import query

TOP = 10
# Of every item so many documents of highest bound are scored to find the floor.
SEEDS = 32
# Occurrences from which on a level counts.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128], np.int64)
HASHES = 5
# Bits per entry of a signature, at least; the width is rounded up to a step of half an octave.
BITS = 12
BLOCK_DOCS = 2048
BLOCK_BYTES = 1 << 20
# Terms counted by a task before they are handed on.
COUNTED_TERMS = 200_000
# Items whose bounds are worked out on a block together, about.
ITEMS_A_CHUNK = 256
# Each chunk of items meets the blocks in so many parts.
SPREAD = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEED = 42  # of Spark's xxhash64
# Bytes of terms stay, A-Z lower-cased; all others separate.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms of the whole text in order, repeats included."""
    return text.encode().translate(_BYTES).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _entries(hashes: np.ndarray, level: int) -> np.ndarray:
    return _mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))


def _bits(entries: np.ndarray, width: int) -> np.ndarray:
    """The HASHES bits of each entry in a signature of ``width`` bits."""
    low, high = entries & np.uint64(0xFFFFFFFF), entries >> np.uint64(32) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) & np.uint64(0xFFFFFFFFFFFF)) % np.uint64(width)


def signature_width(n_entries: int) -> int:
    """Bits of a signature of so many entries: steps of half an octave, so similar documents share a width."""
    step = int(np.ceil(2 * np.log2(max(n_entries, 4) * BITS)))
    return int(2 ** (step / 2))


class _Block:
    """Documents of one width, until they are stored by bit."""

    def __init__(self, width: int):
        self.width, self.rows, self.entries = width, [], []

    def add(self, doc_id, h, length, entries) -> bool:
        self.rows.append((doc_id, h, length))
        self.entries.append(entries)
        n = len(self.rows)
        return n >= BLOCK_DOCS or n % 8 == 0 and (n + 8) // 8 * self.width > BLOCK_BYTES

    def sliced(self) -> bytes:
        """The bitmaps, one after the other; a document is one bit of each."""
        packed = np.zeros((self.width, -(-len(self.rows) // 8)), np.uint8)
        for at in range(0, len(self.rows), 8):
            bits = np.zeros((self.width, 8), bool)
            for k, entries in enumerate(self.entries[at:at + 8]):
                bits[_bits(entries, self.width).ravel(), k] = True
            packed[:, at // 8] = np.packbits(bits, axis=1)[:, 0]
        return packed.tobytes()


_INDEX = ("term binary, df long, width int, doc_ids array<long>, hs array<long>, lengths array<long>, n_with_terms long, "
          "n_terms long, bits binary")
_INDEX_TYPES = [pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()),
                pa.int64(), pa.int64(), pa.binary()]
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)], _INDEX_NAMES)


def signature_index(docs: DataFrame) -> DataFrame:
    """The index of (doc_id, h, text): rows of blocks, and rows (term, df) to be summed per term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        open_, df = {}, Counter()

        def block_row(block):
            lengths = [r[2] for r in block.rows]
            return (None, None, block.width, [r[0] for r in block.rows], [r[1] for r in block.rows], lengths,
                    sum(n > 0 for n in lengths), sum(lengths), block.sliced())

        def df_rows():
            found = [(t, n, None, None, None, None, None, None, None) for t, n in df.items()]
            df.clear()
            return [_index_rows(found[at:at + 50_000]) for at in range(0, len(found), 50_000)]

        for batch in text_batches(batches):
            for doc_id, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = Counter(terms_of(text))
                df.update(counts.keys())
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                hashes = np.fromiter((xxh64_intdigest(t, _SEED) for t in counts), np.uint64, len(counts))
                entries = []
                for level, least in enumerate(LEVELS):
                    reached = hashes[tf >= least]
                    if not len(reached):
                        break
                    entries.append(_entries(reached, level))
                entries = np.concatenate(entries) if entries else hashes
                width = signature_width(len(entries))
                block = open_.setdefault(width, _Block(width))
                if block.add(doc_id, h, int(tf.sum()), entries):
                    yield _index_rows([block_row(open_.pop(width))])
            if len(df) > COUNTED_TERMS:
                yield from df_rows()
        for width in list(open_):
            yield _index_rows([block_row(open_.pop(width))])
        yield from df_rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "h", "text").mapInArrow(run, _INDEX)


def _norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document.  Python's integers: the product may pass 64 bits."""
    return np.array([10 + 90 * int(x) * n // total for x in lengths], np.int64)


def _gain(tf: int | np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds per weight; grows with tf, and stays below 1,000,000."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def upper_bounds(block: dict, offsets: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, total: int):
    """For each item, from ``offsets`` on in ``hashes`` and ``weights``: an upper bound of every document's score, or None if all are 0."""
    docs, width = len(block["lengths"]), block["width"]
    bits = np.frombuffer(block["bits"], np.uint8).reshape(width, -1)
    m = _norms(block["lengths"], n, total)
    terms, place = np.unique(hashes, return_inverse=True)
    levels, alive, before, shown = [], np.arange(len(terms)), None, np.zeros(docs, np.int64)
    for level in range(len(LEVELS)):
        # A document that shows a level shows all below; this takes chance hits out.
        met = np.bitwise_and.reduce(bits[_bits(_entries(terms[alive], level), width)], axis=1)
        if before is not None:
            met &= before
        any_ = met.any(axis=1)
        alive, before = alive[any_], met[any_]
        if not len(alive):
            break
        most = _gain(int(LEVELS[level + 1]) - 1, m) if level + 1 < len(LEVELS) else np.full(docs, 1_000_000, np.int64)
        row = np.full(len(terms), -1)
        row[alive] = np.arange(len(alive))
        levels.append((row, before, most - shown))
        shown = most
    for at, end in zip(offsets[:-1], offsets[1:]):
        bound = None
        for row, met, more in levels:
            rows = row[place[at:end]]
            here = rows >= 0
            if not here.any():
                break
            shows = np.unpackbits(met[rows[here]], axis=1, count=docs)
            # Whole numbers below 2^53: the sum is exact.
            slices = (weights[at:end][here].astype(np.float64) @ shows).astype(np.int64)
            bound = slices * more + (0 if bound is None else bound)
        yield bound


_CHUNK = ["item_ids", "item_hs", "floors", "offsets", "hashes", "weights"]


def _with_chunks(blocks: DataFrame, chunks: DataFrame, n_chunks: int) -> DataFrame:
    """Every block with every chunk of the stated items: an equality join in SPREAD parts."""
    spread = F.pmod(F.xxhash64("width", "hs"), F.lit(SPREAD)).cast("int")
    left = blocks.withColumn("part", spread).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    right = chunks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return left.join(right, ["chunk", "part"]).select("width", "doc_ids", "hs", "lengths", "bits", *_CHUNK)


def _chunks(items: DataFrame, floors: DataFrame | None, n_chunks: int) -> DataFrame:
    """Items (item_id, item_h, terms) in chunks, as flat arrays."""
    if floors is None:
        items = items.withColumn("floor", F.lit(1).cast("long"))
    else:
        items = items.alias("i").join(floors.alias("f"), _same("i", "f", "item_id", "item_h"), "left").select(
            "i.*", F.greatest(F.coalesce("f.floor", F.lit(1)), F.lit(1)).cast("long").alias("floor"))
    chunk = F.pmod(F.xxhash64("item_id", "item_h"), F.lit(n_chunks)).cast("int")
    rows = items.groupBy(chunk.alias("chunk")).agg(
        F.collect_list(F.struct("item_id", "item_h", "floor", "terms")).alias("x"))  # ITEMS_A_CHUNK, about
    every = F.flatten(F.transform("x", lambda i: i["terms"]))
    return rows.select(
        "chunk", F.transform("x", lambda i: i["item_id"]).alias("item_ids"), F.transform("x", lambda i: i["item_h"]).alias("item_hs"),
        F.transform("x", lambda i: i["floor"]).alias("floors"), F.transform("x", lambda i: F.size(i["terms"])).alias("offsets"),
        F.transform(every, lambda t: t["hash"]).alias("hashes"), F.transform(every, lambda t: t["w"]).alias("weights"))


def _bounded(pairs: DataFrame, n: int, total: int, best: int | None) -> DataFrame:
    """(item_id, item_h, doc_id, h, bound) of blocks with chunks: bounds at the floor or above; of each task only the ``best`` per item if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list] = {}

        def emit(rows):
            columns = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["item_id", "item_h", "doc_id", "h", "bound"])

        for batch in text_batches(batches, 1):
            row = {name: batch.column(k)[0].as_py() if name == "bits" else batch.column(k)[0]
                   for k, name in enumerate(batch.schema.names)}
            block = {"width": row["width"].as_py(), "bits": row["bits"], "lengths": row["lengths"].as_py()}
            ids, hs = row["doc_ids"].as_py(), row["hs"].as_py()
            offsets = np.cumsum([0, *row["offsets"].as_py()])
            hashes = np.array(row["hashes"].as_py(), np.int64).view(np.uint64)
            weights = np.array(row["weights"].as_py(), np.int64)
            items = list(zip(row["item_ids"].as_py(), row["item_hs"].as_py()))
            out = []
            for item, floor, bound in zip(items, row["floors"].as_py(), upper_bounds(block, offsets, hashes, weights, n, total)):
                if bound is None:
                    continue
                held = kept.setdefault(item, []) if best else None
                if best and len(held) == best:
                    floor = max(floor, held[-1][4] + 1)
                found = [(*item, ids[k], hs[k], int(bound[k])) for k in np.flatnonzero(bound >= floor)]
                if best and found:
                    held += found
                    held.sort(key=lambda x: -x[4])
                    del held[best:]
                elif found:
                    out += found
            if out:
                yield emit(out)
        if best:
            yield emit([x for held in kept.values() for x in held])

    return pairs.mapInArrow(run, "item_id long, item_h long, doc_id long, h long, bound long")


def _same(a: str, b: str, *names: str) -> Column:
    match = F.lit(True)
    for name in names:
        match = match & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return match


def _scores(docs: DataFrame, pairs: DataFrame, items: DataFrame, n: int, total: int) -> DataFrame:
    """(item_id, item_h, doc_id, score) of (item, document) pairs, on whole texts; a pair of repeated rows gives a row for each."""
    asked = pairs.alias("p").join(items.alias("i"), _same("p", "i", "item_id", "item_h")).groupBy("p.doc_id", "p.h", "i.chunk").agg(
        F.collect_list(F.struct("i.item_id", "i.item_h", "i.terms")).alias("items"))  # a chunk's items at most
    # Only texts that are asked for move on.
    texts = docs.alias("d").join(pairs.select("doc_id", "h").distinct().alias("k"), _same("d", "k", "doc_id", "h"), "left_semi")
    rows = texts.alias("d").join(asked.alias("a"), _same("d", "a", "doc_id", "h")).select("d.doc_id", "d.text", "a.items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 16):
            out = []
            for doc_id, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                tf = Counter(terms_of(text))
                m = 10 + 90 * tf.total() * n // total
                for item in asked:
                    score = sum(t["w"] * (1_000_000_000 * tf[t["term"]] // (1000 * tf[t["term"]] + 8 * m))
                                for t in item["terms"] if t["term"] in tf)
                    out.append((item["item_id"], item["item_h"], doc_id, score))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["item_id", "item_h", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id long, item_h long, doc_id long, score long").filter("score > 0")


def _best(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item_id", "item_h").orderBy(*order))
    return rows.withColumn("rank", place).filter(F.col("rank") <= n)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by exact score, above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns may have any
    name.  Null and empty texts have no terms.  Equal scores rank by doc_id, null ids
    first; repeated documents each take a rank.  Repeated items are answered once; items
    of one item_id with different texts are answered each.  An empty table on either
    side gives no rows.  The length of a text has no bound.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    index = stored(signature_index(docs), "signatures")
    blocks = index.filter("width IS NOT NULL")
    n, total = blocks.agg(F.coalesce(F.sum("n_with_terms"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    item_terms = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_h"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_TERM), F.lit(0)))).alias("term")
    ).withColumn("term", F.col("term").cast("binary")).distinct()
    asked = item_terms.select("term").distinct()
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = index.filter("width IS NULL").select("term", "df").join(asked, "term").groupBy("term").agg(
        F.sum("df").alias("df")).select("term", weight.alias("w")).filter("w > 0")
    weighted = stored(
        item_terms.join(weights, "term").groupBy("item_id", "item_h").agg(
            F.collect_list(F.struct("term", F.xxhash64("term").alias("hash"), "w")).alias("terms")), "items")
    n_chunks = max(1, -(-weighted.count() // ITEMS_A_CHUNK))
    queries = weighted.withColumn("chunk", F.pmod(F.xxhash64("item_id", "item_h"), F.lit(n_chunks)).cast("int"))

    first = _bounded(_with_chunks(blocks, _chunks(weighted, None, n_chunks), n_chunks), n, total, SEEDS)
    seeds = stored(_best(first, SEEDS, F.desc("bound"), "doc_id").select("item_id", "item_h", "doc_id", "h").distinct(), "seeds")
    floors = stored(
        _best(_scores(docs, seeds, queries, n, total), top, F.desc("score"), "doc_id").groupBy("item_id", "item_h").agg(
            F.min("score").alias("floor"), F.count(F.lit(1)).alias("found")).filter(F.col("found") >= top), "floors")
    left = stored(
        _bounded(_with_chunks(blocks, _chunks(weighted, floors, n_chunks), n_chunks), n, total, None)
        .select("item_id", "item_h", "doc_id", "h").distinct(), "not-excluded")
    ranked = _best(_scores(docs, left, queries, n, total), top, F.desc("score"), F.asc_nulls_first("doc_id"))
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_SQL = rf"""
    WITH doc_terms AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents),
    item_terms AS (
        SELECT DISTINCT item_id, term FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark)),
    sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
    totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
    norms AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM sizes, totals),
    tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms SEMI JOIN item_terms USING (term) GROUP BY doc_id, term),
    weights AS (
        SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
    scores AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM item_terms JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id)
    SELECT item_id, rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
    WHERE rank <= 10"""


@query("op12_bit_sliced_search", _SQL)
def bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
