"""Similar texts: a chosen-path join of word-shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import release_memory, stored, table, text_batches
from tidemark.llm.components import components
from tidemark.llm.decontaminate import _TO_WORDS
from tidemark.llm.registry import query

SHINGLE = 5
SIMILARITY = 0.8
# Minimum hashes that stand for a set; a path step picks one of them.
COORDINATES = 64
# Chance of a pair at the least similarity to be missed is at most 1 - RECALL.
RECALL = 0.999
# A bucket of up to so many sets is compared pair by pair; a larger one is split.
SMALL = 24
DEEPEST = 6
# Sets compared with each other in one group, of a bucket that cannot be split.
BLOCK = 2048
# Text bytes hashed at a time, and hashes mixed at a time; a longer text is hashed in blocks.
HASHED_BYTES = 1 << 18
MIXED = 1 << 16

_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _B, np.uint64))
_MULTIPLIERS = np.random.default_rng(7).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of ``text``, words being apart by blanks, and where it ends; in blocks cut at blanks."""
    hashes, ends, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        cut = text.rfind(b" ", at, at + HASHED_BYTES) if at + HASHED_BYTES < len(text) else len(text) - 1
        cut = text.find(b" ", at + HASHED_BYTES) if cut < at else cut  # one word fills the block
        block = np.frombuffer(text, np.uint8, (cut if cut >= 0 else len(text) - 1) + 1 - at, at)
        inside = block != 0x20
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            # Its bytes times powers by their place in the word.
            place = np.arange(len(block)) - np.repeat(
                np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(block)]])))
            value = np.where(inside, (block.astype(np.uint64) + np.uint64(1)) * _POWERS[place % 4096], np.uint64(0))
            hashes.append(_mix(np.add.reduceat(value, first) + (last - first).astype(np.uint64)))
            ends.append(last + at)
        at += len(block)
    return np.concatenate(hashes), np.concatenate(ends)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of each text, sorted, one text after the other.

    Words are lower-cased runs of digits, letters a-z and everything beyond ASCII; a
    text of fewer words than ``size`` is one shingle, a text without words has none.
    """
    parts = [(t.encode("utf-8", "surrogatepass").translate(_TO_WORDS) if t else b"") + b" " for t in texts]
    owner_end = np.cumsum([len(p) for p in parts])
    words, last = _word_hashes(b"".join(parts))
    counts = np.diff(np.concatenate([[0], np.searchsorted(last, owner_end)]))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    found, ends, total = [], [], 0
    whole = np.zeros(0, np.uint64)
    if len(words) >= size:
        n = len(words) - size + 1
        whole = np.zeros(n, np.uint64)
        for k in range(size):
            whole += words[k:k + n] * _POWERS[k + 8]
        whole = _mix(whole)
    for start, count in zip(starts.tolist(), counts.tolist()):
        if count >= size:
            own = np.unique(whole[start:start + count - size + 1])
        elif count:
            own = _mix(np.add.reduce(words[start:start + count] * _POWERS[np.arange(count) + 8], keepdims=True) + np.uint64(count))
        else:
            own = whole[:0]
        found.append(own)
        total += len(own)
        ends.append(total)
    return np.concatenate(found), np.array(ends, np.int64)


def min_hashes(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least value of each set under ``COORDINATES`` hash functions, 32 bits each; sets without shingles give zeros."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = np.flatnonzero(ends > starts)
    out = np.zeros((len(ends), COORDINATES), np.uint32)
    least = np.full((len(full), COORDINATES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), MIXED):
        block = hashes[at:at + MIXED]
        # The sets that lie in this block of hashes, the first one perhaps from before.
        here = np.arange(np.searchsorted(ends[full], at, "right"), np.searchsorted(starts[full], at + len(block)))
        first = np.maximum(starts[full[here]] - at, 0)
        for k, m in enumerate(_MULTIPLIERS):
            least[here, k] = np.minimum(least[here, k], np.minimum.reduceat(_mix(block * m), first))
    out[full] = _mix(least) >> np.uint64(32)
    return out


_SETS = "doc_id long, h long, node binary, n_shingles int, sketch binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Per row its set's 128-bit name, its size and its minimum hashes.

    Texts without words are named by their bytes: only equal ones are alike.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release_memory()

        def emit(rows):
            hashes, ends = shingle_sets([r[2] for r in rows])
            values = min_hashes(hashes, ends)
            names, start = [], 0
            for row, end in zip(rows, ends.tolist()):
                body = hashes[start:end].tobytes() or b"-" + (row[2] or "").encode("utf-8", "surrogatepass")
                names.append(xxhash.xxh3_128_digest(body))
                start = end
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array(names, pa.binary()), pa.array(np.diff(np.concatenate([[0], ends])), pa.int32()),
                 pa.array([v.tobytes() for v in values], pa.binary())],
                ["doc_id", "h", "node", "n_shingles", "sketch"])

        rows, held = [], 0
        for batch in text_batches(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                held += len(row[2] or "")
                if held >= HASHED_BYTES:
                    yield emit(rows)
                    rows, held = [], 0
        if rows:
            yield emit(rows)

    return docs.select("doc_id", "h", "text").mapInArrow(run, _SETS)


def miss_chance(runs: int, similarity: float, depth: int = DEEPEST, planned: float = SIMILARITY) -> float:
    """Chance of a pair at ``similarity`` to share no bucket of ``depth`` steps in any of ``runs``, or to agree too little.

    All runs draw from the same coordinates, so the chance is averaged over how many
    of them the pair agrees in.  The steps are those of a join at ``planned``.
    """
    extra = 1 / planned - 1  # chance of a second coordinate: 1 / similarity on average
    missed = 0.0
    for agreed in range(COORDINATES + 1):
        meet = 1.0 if agreed >= least_agreement(planned) else 0.0
        for _ in range(depth):
            one = agreed / COORDINATES * meet
            meet = (1 - extra) * one + extra * (1 - (1 - one) ** 2)
        missed += math.comb(COORDINATES, agreed) * similarity**agreed * (1 - similarity) ** (COORDINATES - agreed) * (1 - meet) ** runs
    return missed


def runs_needed(recall: float = RECALL, similarity: float = SIMILARITY, depth: int = DEEPEST) -> int:
    """Runs until a pair at ``similarity`` has met in a bucket of ``depth`` steps with chance ``recall``."""
    return next(runs for runs in range(1, 1000) if miss_chance(runs, similarity, depth, similarity) <= 1 - recall)


def _children(path: Column, sketch: Column, similarity: float) -> Column:
    """Paths one step on: by one coordinate, or two, that all sets on ``path`` share the choice of."""
    def step(salt: int) -> Column:
        at = F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(path, at, F.substring(sketch, at * 4 + 1, F.lit(4)))

    extra = int((1 / similarity - 1) * 1000)
    return F.when(F.pmod(F.xxhash64(path, F.lit(3)), F.lit(1000)) < extra, F.array(step(1), step(2))).otherwise(F.array(step(1)))


def buckets(
    sets: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL, deepest: int = DEEPEST
) -> DataFrame:
    """(path, node, size): the buckets of the last step of each path, of two sets or more.

    Every run starts with all sets in one bucket.  A bucket of more than ``small``
    sets is split on sampled coordinates of its sets' minimum hashes; sizes are
    counted per path and joined back, so a bucket of any size is only rows.
    """
    starts = F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(runs_needed(recall, similarity, deepest))), lambda r: F.xxhash64(r, F.lit("run"))))
    rows = sets.select("node", "sketch", starts.alias("path"))
    done = []
    for depth in range(deepest):
        rows = stored(rows.select("node", F.explode(F.array_distinct(
            _children(F.col("path"), F.col("sketch"), similarity))).alias("path")), "paths")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        met = stored(rows.join(sizes, "path"), "buckets")
        last = depth + 1 == deepest
        done.append(met if last else met.filter(F.col("size") <= small))
        large = met.filter(F.col("size") > small)
        if last or large.isEmpty():
            break
        rows = large.select("path", "node").join(sets.select("node", "sketch"), "node")
    found = done[0]
    for part in done[1:]:
        found = found.union(part)
    return found.select("path", "node", "size")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def least_agreement(similarity: float) -> int:
    """Coordinates that a pair at ``similarity`` shares, less five standard deviations."""
    mean, spread = similarity * COORDINATES, math.sqrt(similarity * (1 - similarity) * COORDINATES)
    return max(1, math.floor(mean - 5 * spread))


def texts_of(nodes: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of distinct nodes, each from one of its rows."""
    at = nodes.join(sets.select("node", "at"), "node").select("node", "at.doc_id", "at.h")
    return stored(
        docs.alias("d").join(at.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.h") == F.col("w.h")))
        .select("w.node", "d.text").dropDuplicates(["node"]), "compared-texts")


def _groups(members: DataFrame, block: int) -> DataFrame:
    """``members`` (path, node, size, ...) dealt out to groups (path, i, j).

    A bucket is cut into blocks, and every two blocks meet in one group of at most
    2 * ``block`` sets, on average.
    """
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    return (
        members.withColumn("n", F.ceil(F.col("size") / block).cast("int")).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
        .drop("n", "other", "size"))


class _Group:
    """Sets of one group: who may be compared with whom."""

    def __init__(self, group: pa.Table, need: int):
        self.nodes = group.column("node").to_pylist()
        self.sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u4").reshape(-1, COORDINATES)
        self.kind = np.unique(np.array([r.hex() for r in group.column("root").to_pylist()]), return_inverse=True)[1]
        self.side = group.column("mine").to_numpy()
        self.inner = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        self.need = need

    def partners(self, k: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets from ``start`` on of other classes that agree enough with set k, and how much."""
        rest = np.arange(start, len(self.nodes))
        rest = rest[(self.kind[rest] != self.kind[k]) & (True if self.inner else self.side[rest] != self.side[k])]
        same = _agree(self.sketch[rest], self.sketch[k])
        return rest[same >= self.need], same[same >= self.need]

    def table(self, pairs: list[tuple[int, int]]) -> pa.Table:
        ends = [sorted((self.nodes[a], self.nodes[b])) for a, b in pairs]
        return pa.table({"a": pa.array([x for x, _ in ends], pa.binary()), "b": pa.array([y for _, y in ends], pa.binary())})


def _best_across(members: DataFrame, sets: DataFrame, similarity: float, block: int, best: int) -> DataFrame:
    """Pairs of each set with the ``best`` ones of its groups that agree most with it, of other classes."""
    need = least_agreement(similarity)

    def compare(group: pa.Table) -> pa.Table:
        own, pairs = _Group(group, need), []
        for k in range(len(own.nodes)):
            rest, same = own.partners(k, 0)
            pairs += [(k, int(x)) for x in rest[np.argsort(-same, kind="stable")[:best]]]
        return own.table(pairs)

    rows = _groups(members, block).join(sets.select("node", "sketch"), "node")
    return rows.groupBy("path", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def _marks(sets: DataFrame) -> DataFrame:
    """(node, n_shingles, marks): a byte of each minimum hash; sets agree in at least as many bytes as hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                marks = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([m.tobytes() for m in marks], pa.binary())], ["node", "n_shingles", "marks"])

    return sets.select("node", "n_shingles", "sketch").mapInArrow(run, "node binary, n_shingles int, marks binary")


def _by_group(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on each group (path, i, j) of ``rows``, a table; gives the tables it returns.

    Most groups hold a few sets, so many of them come to the worker at once.
    """
    keys = ["path", "i", "j"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
            for a, b in zip(edges[:-1], edges[1:]):
                found = run(table.slice(a, b - a)) if b - a > 1 else None
                if found is not None and found.num_rows:
                    yield from found.combine_chunks().to_batches()

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            held = (pa.concat_tables([held, whole]) if held is not None else whole).combine_chunks()
            changes = np.zeros(held.num_rows - 1, bool)
            for key in keys:
                changes |= np.diff(held.column(key).to_numpy()) != 0
            edges = [0, *(np.flatnonzero(changes) + 1).tolist()]
            yield from done(held, edges)
            held = held.slice(edges[-1])
        if held is not None:
            yield from done(held, [0, held.num_rows])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(groups, schema)


def _shared(codes: list[np.ndarray], seen: np.ndarray, k: int, rest: np.ndarray) -> np.ndarray:
    """How many codes set k has in common with each set of ``rest``; ``seen`` is all False before and after."""
    seen[codes[k]] = True
    ends = np.cumsum([0, *(len(codes[x]) for x in rest)])
    hits = np.concatenate([[0], np.cumsum(seen[np.concatenate([codes[x] for x in rest])])])
    seen[codes[k]] = False
    return hits[ends[1:]] - hits[ends[:-1]]


def _coded(values: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(codes, seen) of sets of numbers, for ``_shared``."""
    names, codes = np.unique(np.concatenate(values), return_inverse=True)
    return np.split(codes, np.cumsum([len(v) for v in values])[:-1]), np.zeros(len(names), bool)


def _likely_in_group(group: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(k, rest): the later sets of a group whose marks and sizes allow the similarity to set k, if there are any."""
    n, need = group.num_rows, least_agreement(similarity)
    marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(n, COORDINATES)
    sizes, side = group.column("n_shingles").to_numpy(), group.column("mine").to_numpy()
    inner = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    step = max(1, (1 << 20) // (n * COORDINATES))
    for start in range(0, n, step):
        own = slice(start, start + step)
        close = _agree(marks[own, None], marks[None, start:]) >= need
        a, b = sizes[own, None], sizes[None, start:]
        close &= np.minimum(a, b) >= similarity * np.maximum(a, b)
        if not inner:
            close &= side[own, None] != side[None, start:]
        close = np.triu(close, 1)
        for k in np.flatnonzero(close.any(axis=1)).tolist():
            yield start + k, start + np.flatnonzero(close[k])


def _first_met(group: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """The likely pairs of a group that meet in no lesser path."""
    path = group.column("path")[0].as_py()
    own_paths = [np.array([p for p in paths if p < path], np.int64) for paths in group.column("paths").to_pylist()]
    codes, seen = _coded(own_paths)
    for k, rest in _likely_in_group(group, similarity):
        rest = rest[_shared(codes, seen, k, rest) == 0]
        if len(rest):
            yield k, rest


def _counted(members: DataFrame, sets: DataFrame, docs: DataFrame, similarity: float, block: int) -> DataFrame:
    """All links of the buckets, summed up: rows (a, b, null) connect what is linked, rows (a, null, n) count links of set a.

    Every likely pair of a bucket is checked on whole texts, once: two sets that
    share several buckets are compared in the least of them.  Marks of their sketches
    tell first which sets have anybody to be compared with; only those bring their
    paths, and of those only sets with a pair of their own to be checked their texts.
    A group gives a count for each set and fewer links than sets, never its pairs.
    """
    def some(pairs, group: pa.Table) -> pa.Table:
        wanted = np.zeros(group.num_rows, bool)
        for k, rest in pairs(group, similarity):
            wanted[k] = True
            wanted[rest] = True
        return group.filter(pa.array(wanted))

    def compare(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        hashes, ends = shingle_sets(group.column("text").to_pylist())
        codes, seen = _coded(np.split(hashes, ends[:-1]))
        sizes = np.array([len(c) for c in codes])
        kind, count, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), []
        for k, rest in _first_met(group, similarity):
            common = _shared(codes, seen, k, rest)
            rest = rest[common >= similarity * (sizes[k] + sizes[rest] - common)]
            count[k] += len(rest)
            count[rest] += 1
            for other in np.unique(kind[rest]).tolist():
                if other != kind[k]:
                    x = rest[kind[rest] == other][0]
                    links.append(sorted((nodes[k], nodes[x])))
                    kind[kind == other] = kind[k]
        counted = np.flatnonzero(count).tolist()
        return pa.table({
            "a": pa.array([x for x, _ in links] + [nodes[k] for k in counted], pa.binary()),
            "b": pa.array([y for _, y in links] + [None] * len(counted), pa.binary()),
            "n": pa.array([None] * len(links) + count[counted].tolist(), pa.int64())})

    dealt = _groups(members.select("path", "node", "size"), block).join(_marks(sets), "node").select(
        "path", "i", "j", "mine", "node", "n_shingles", "marks")
    fields = "path long, i int, j int, mine int, node binary, n_shingles int, marks binary"
    near = stored(_by_group(dealt, lambda group: some(_likely_in_group, group), fields), "near-sets")
    own_paths = near.groupBy("node").agg(F.collect_set("path").alias("paths"))  # a few for each run
    few = stored(_by_group(
        near.join(own_paths, "node").select(*dealt.columns, "paths"), lambda group: some(_first_met, group),
        fields + ", paths array<long>"), "to-compare")
    texts = texts_of(few.select("node").distinct(), sets, docs)
    return stored(_by_group(
        few.join(texts, "node").select(*dealt.columns, "paths", "text"), compare, "a binary, b binary, n long"), "counted-links")


def _links_across(members: DataFrame, sets: DataFrame, docs: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links that connect what the sets of the buckets are linked to over any path."""
    return _counted(members, sets, docs, similarity, block).filter("b is not null").select("a", "b").distinct()


def similarity_join(
    docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(members, links): the set ("node") and class of every row, and verified links that connect the classes.

    members: (doc_id, h, node, root, n_links), one row per row of ``docs`` (doc_id, h,
    text); root is the least node of the class, n_links the number of different sets
    that the row's set is linked to.  Rows with equal sets are one node and are not
    compared.  Two different sets are linked where their Jaccard similarity reaches
    ``similarity``.  Every likely pair of the buckets is compared once, exactly, on
    whole texts, and counted; of the links only as many are listed as connect the classes.
    """
    rows = stored(sketches(docs), "sketches")
    sets = stored(rows.groupBy("node").agg(
        F.min(F.struct("doc_id", "h")).alias("at"), F.max("n_shingles").alias("n_shingles"),
        F.max("sketch").alias("sketch")), "sets")
    met = buckets(sets.filter("n_shingles > 0"), similarity, recall)
    counted = _counted(met, sets, docs, similarity, block)
    links = counted.filter("b is not null").select("a", "b").distinct()
    roots = stored(components(links), "roots")
    degree = counted.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    members = rows.select("doc_id", "h", "node").join(roots.join(degree, "node"), "node", "left").select(
        "doc_id", "h", "node", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members, links


def keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its id and the hash of its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links) per row: class_id is the least doc_id of its class.

    Null ids do not name a class unless it has no others; texts without words are
    alike only if equal; an empty table gives no rows.
    """
    members = stored(similarity_join(keyed(docs), similarity)[0], "members")
    names = members.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return members.join(names, "root").select("doc_id", "class_id", "n_links")


@query("op7_chosen_path_join")
def chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of similar texts of every document."""
    return classes(table(spark, sf_dir, "documents"))
