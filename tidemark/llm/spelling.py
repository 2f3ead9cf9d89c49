"""Spelling variants: words one inserted, deleted or replaced character apart.

Of two such words one arises from the other by deleting a character or by replacing
one with a larger one; that is the direction searched in.  The error lies in the left or
in the right half of the word searched for, so the other half is matched exactly and
the search goes on from there across the first, allowing one error.

The vocabulary is cut into blocks by what an exact half leaves equal: a word's length
and its first half for one search, its length and its second half for the other.  Each
block has a bidirectional FM-index of its words between delimiters, and receives the
words that may have neighbours there; lists with too many words are cut into slices.
A block hands on one row per word, not pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import stored, table, text_batches
from tidemark.llm.registry import query

LEAST_LENGTH = 5
LEAST_COUNT = 3
# One run in so many loses a character.
DELETE_ONE_IN = 97
# A form is at least so many times as frequent.
FORM_FACTOR = 2
# Words indexed together, about; a list of words with an equal half is sliced beyond that.
BLOCK_WORDS = 1 << 15
# Words searched for together.
BATCH = 2048
# Runs counted by a task before they are handed on.
COUNTED_WORDS = 200_000

# In Latin-1 a letter is one byte; everything else separates.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters in Latin-1, only A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, delete_one_in: int | None = DELETE_ONE_IN) -> DataFrame:
    """(word, n): the runs of all texts of at least ``least_length`` letters, counted per task before the shuffle.

    With ``delete_one_in`` k a run loses the character crc32("<doc_id>:<run>") modulo its length if k divides that
    number; the same run in the same document always does or never does.  A null doc_id deletes nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows():
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            found = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return found

        for batch in text_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(runs_of(text))
                start = zlib.crc32(b"%d:" % doc_id) if doc_id is not None and delete_one_in else None
                for word, n in found.items():
                    if len(word) < least_length:
                        continue
                    if start is not None:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % delete_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_length:
                                continue
                    counts[word] += n
            if len(counts) > COUNTED_WORDS:
                yield rows()
        yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long").groupBy(
        "word").agg(F.sum("n").alias("n"))


# --- the index -----------------------------------------------------------------------------


class Wavelet:
    """Symbols by bits, high ones first: counts of a symbol, and of smaller ones, in any range."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            set_ = (symbols >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(set_)]).astype(np.int32))
            self.zeros.append(int(len(symbols) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[~set_], symbols[set_]])
        # Where each symbol's places start after the last bit.
        every = np.arange(1 << bits)
        self.start = np.zeros(1 << bits, np.int64)
        self.start = self.narrow(np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), every)[0]

    def narrow(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray):
        """Per range: occurrences of its symbol before lo and before hi, and of smaller symbols between."""
        smaller = np.zeros(len(lo), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            smaller += np.where(one, hi - lo - b + a, 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return lo - self.start[symbol], hi - self.start[symbol], smaller

    def larger(self, lo: np.ndarray, hi: np.ndarray, than: np.ndarray):
        """All symbols larger than ``than`` that a range holds: (range, symbol, before lo, before hi, smaller ones)."""
        whose, symbol, smaller = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            shift = self.bits - 1 - k
            a, b = ones[lo], ones[hi]
            whose, symbol = np.concatenate([whose, whose]), np.concatenate([2 * symbol, 2 * symbol + 1])
            smaller = np.concatenate([smaller, smaller + hi - lo - b + a])
            lo, hi = np.concatenate([lo - a, zeros + a]), np.concatenate([hi - b, zeros + b])
            keep = (hi > lo) & (symbol >= than[whose] >> shift)
            whose, symbol, smaller, lo, hi = whose[keep], symbol[keep], smaller[keep], lo[keep], hi[keep]
        keep = symbol > than[whose]
        whose, symbol, smaller, lo, hi = whose[keep], symbol[keep], smaller[keep], lo[keep], hi[keep]
        return whose, symbol, lo - self.start[symbol], hi - self.start[symbol], smaller


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of ``text`` in order, by doubling the length compared."""
    n = len(text)
    rank, k = text.astype(np.int64), 1
    while True:
        key = rank * (n + 256) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= 2 * n:
            return order


class WordIndex:
    """Bidirectional FM-index of distinct words between delimiters, as one round text "#w1#w2...".

    A range (lo, size, back) stands for a pattern: ranks lo to lo + size of the text's suffixes, and ranks from back
    on of the reversed text's.  The pattern "#word#" has the word's place in the sorted list as its rank.
    """

    def __init__(self, words: list[bytes]):
        self.words = sorted(words)
        raw = np.frombuffer(b"\0" + b"\0".join(self.words), np.uint8)
        present = np.unique(raw)
        # In the order of the bytes; what no word holds gets a code that never occurs.
        self.floor = np.searchsorted(present, np.arange(256), "right") - 1
        self.code = np.full(256, len(present), np.int64)
        self.code[present] = np.arange(len(present))
        bits = int(len(present)).bit_length()
        text = self.code[raw]
        self.first = np.searchsorted(np.sort(text), np.arange(1 << bits))
        self.before, self.behind = (
            Wavelet(t[rotations(t) - 1], bits) for t in (text, text[::-1].copy()))

    def start(self, n: int):
        """The delimiter, n times."""
        return np.zeros(n, np.int64), np.full(n, len(self.words)), np.zeros(n, np.int64)

    def extend(self, state, symbol: np.ndarray, left: bool):
        """The ranges with one more symbol in front, or behind; size 0 where it does not occur."""
        lo, size, back = state
        here, other = (lo, back) if left else (back, lo)
        a, b, smaller = (self.before if left else self.behind).narrow(here, here + size, symbol)
        here, other = self.first[symbol] + a, other + smaller
        return (here, b - a, other) if left else (other, b - a, here)

    def replace(self, state, symbol: np.ndarray, left: bool):
        """(whose, ranges): one more symbol, any that occurs and is larger than ``symbol``, a code of ``floor``."""
        lo, size, back = state
        here, other = (lo, back) if left else (back, lo)
        whose, found, a, b, smaller = (self.before if left else self.behind).larger(here, here + size, symbol)
        here, other = self.first[found] + a, other[whose] + smaller
        return whose, ((here, b - a, other) if left else (other, b - a, here))

    def neighbours(self, words: list[bytes], left: bool):
        """(word, place in the index) for words of one length: index words that arise by deleting a symbol, or replacing
        it by a larger one, in the left (or right) half, the other half being equal.

        Of a run of equal symbols the last one is deleted, so no pair comes twice.
        """
        m = len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), m)
        codes, floors = self.code[raw], self.floor[raw]
        middle = m // 2
        places = list(range(m - 1, -1, -1)) if left else list(range(m))
        exact = [j for j in places if (j >= middle) == left]
        whose, state = np.arange(len(words)), self.start(len(words))

        def step(whose, state, j):
            lo, size, back = self.extend(state, codes[whose, j], left)
            alive = size > 0
            return whose[alive], (lo[alive], size[alive], back[alive])

        for j in exact:
            whose, state = step(whose, state, j)
        off, off_state = np.zeros(0, np.int64), tuple(np.zeros(0, np.int64) for _ in range(3))
        for j in places[len(exact):]:
            if len(off):
                off, off_state = step(off, off_state, j)
            if len(whose):
                parts = [(off, off_state)]
                branch, replaced = self.replace(state, floors[whose, j], left)
                parts.append((whose[branch], replaced))
                last = raw[whose, j] != raw[whose, j + 1] if j + 1 < m else np.ones(len(whose), bool)
                parts.append((whose[last], tuple(x[last] for x in state)))
                off = np.concatenate([p[0] for p in parts])
                off_state = tuple(np.concatenate([p[1][k] for p in parts]) for k in range(3))
                whose, state = step(whose, state, j)
            elif not len(off):
                break
        if len(off):
            lo, size, _ = self.extend(off_state, np.zeros(len(off), np.int64), left)
            off, place = off[size > 0], lo[size > 0]
            return off, place
        return off, off


# --- the job -------------------------------------------------------------------------------


def _list_of(word: Column, length: Column, left: Column) -> Column:
    """Words of this length that share the half of ``word`` which the search takes as equal."""
    half = F.floor(length / 2).cast("int")
    return F.concat_ws(
        ":", F.when(left, "r").otherwise("l"), length,
        F.when(left, F.right(word, length - half)).otherwise(F.left(word, half)))


def _routed(words: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """(block, asks, word, n): every word once per search as part of an index, and wherever it has to search."""
    length, left = F.length("word"), F.col("left")
    sided = words.withColumn("left", F.explode(F.array(F.lit(True), F.lit(False))))
    indexed = sided.withColumn("list", _list_of(F.col("word"), length, left))
    # Searching for a replaced symbol in words as long, for a deleted one in words one shorter.
    asking = sided.withColumn("length", F.explode(F.array(length, length - 1))).withColumn(
        "list", _list_of(F.col("word"), F.col("length"), left)).drop("length")
    full = indexed.groupBy("list").count().filter(F.col("count") > block_words).select(
        "list", F.ceil(F.col("count") / block_words).cast("int").alias("slices"))
    full = stored(full, "full-lists")
    slices = F.coalesce("slices", F.lit(1))
    placed = indexed.join(full, "list", "left").withColumn("slice", F.pmod(F.xxhash64("word"), slices).cast("int"))
    asked = asking.join(full, "list", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    n_blocks = 2 * max(1, -(-words.count() // block_words))
    block = (2 * F.pmod(F.xxhash64("list", "slice"), F.lit(n_blocks // 2)) + F.col("left").cast("int")).cast("int")
    columns = [block.alias("block"), "asks", "word", "n"]
    return placed.withColumn("asks", F.lit(False)).select(*columns).union(
        asked.withColumn("asks", F.lit(True)).select(*columns)), n_blocks


_PART = "word string, n_near long, form_n long, form string"


def _summed(target: np.ndarray, words: list[bytes], near: np.ndarray, near_words: list[bytes], near_n: np.ndarray) -> pa.RecordBatch:
    """One row per target word: its near words counted, and of them the one of largest n, then least.  Both lists are sorted."""
    order = np.lexsort((near, -near_n[near], target))
    target, near = target[order], near[order]
    at = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array([words[k].decode("latin-1") for k in target[at]], pa.string()),
        pa.array(np.diff(np.append(at, len(target))), pa.int64()), pa.array(near_n[near[at]], pa.int64()),
        pa.array([near_words[k].decode("latin-1") for k in near[at]], pa.string())], ["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, batch_words: int = BATCH) -> DataFrame:
    """(word, n_near, form_n, form): of each word of (word, n) with near words how many, and the most frequent of them."""
    rows, n_blocks = _routed(words, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, n_indexed = None, None, None
        words: dict[bytes, int] = {}
        asked: dict[bytes, int] = {}

        def answer():
            nonlocal index, n_indexed
            if index is None and words:
                index = WordIndex(list(words))
                n_indexed = np.array([words[w] for w in index.words], np.int64)
            if index is not None and asked:
                queries = sorted(asked)
                n_asked = np.array([asked[w] for w in queries], np.int64)
                by_length: dict[int, list[int]] = {}
                for k, word in enumerate(queries):
                    by_length.setdefault(len(word), []).append(k)
                found = []
                for ks in by_length.values():
                    whose, place = index.neighbours([queries[k] for k in ks], bool(block % 2))
                    found.append((np.array(ks)[whose], place))
                whose, place = (np.concatenate(x) for x in zip(*found))
                if len(whose):
                    yield _summed(whose, queries, place, index.words, n_indexed)
                    yield _summed(place, index.words, whose, queries, n_asked)
            asked.clear()

        for batch in text_batches(batches, 8192):
            for b, asks, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    if block is not None:
                        yield from answer()
                    block, index = b, None
                    words.clear()
                (asked if asks else words)[word.encode("latin-1")] = n
                if len(asked) >= batch_words:
                    yield from answer()
        if block is not None:
            yield from answer()

    # Of a block its words come first, then those that search; a word that comes by two ways searches once.
    found = rows.distinct().repartition(n_blocks, "block").sortWithinPartitions("block", "asks", "word").mapInArrow(run, _PART)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends; every round halves the way left.  n grows on the way, so it ends."""
    ways = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "ways")
    while not ways.filter("moved").isEmpty():
        longer = ways.alias("a").join(ways.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        ways = stored(longer.select(
            "a.word", F.coalesce("b.root", "a.root").alias("root"), F.isnotnull("b.root").alias("moved")), "ways")
    return ways.select("word", "root")


def spelling_groups(
    docs: DataFrame, least_count: int = LEAST_COUNT, block_words: int = BLOCK_WORDS, batch_words: int = BATCH
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of ``docs`` (doc_id, text) with ``least_count`` occurrences.

    Near words differ by exactly one inserted, deleted or replaced character.  form: the
    near word of largest n, the least in code-point order among equals, if its n is at
    least FORM_FACTOR times the word's; root: the end of the chain of forms, the word
    itself if it has none.  Null and empty texts have no words; repeated rows count each;
    other columns may have any name; an empty table gives no rows.  The length of a text
    or a word has no bound.
    """
    words = stored(word_counts(docs).filter(F.col("n") >= least_count), "words")
    near = near_words(words, block_words, batch_words)
    has_form = F.col("form_n") >= FORM_FACTOR * F.col("n")
    rows = stored(words.join(near, "word", "left").select(
        "word", F.when(has_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("form_n")).alias("form_n")), "forms")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling_groups(table(spark, sf_dir, "documents"))
