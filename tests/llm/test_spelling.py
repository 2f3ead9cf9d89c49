"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling

DOCS = "doc_id long, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_apart(word, words):
    """All of ``words`` one edit from ``word``, by trying every edit."""
    letters = sorted(set("".join(words)))
    tried = {word[:k] + word[k + 1:] for k in range(len(word))}
    tried |= {word[:k] + c + word[k + 1:] for k in range(len(word)) for c in letters}
    tried |= {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}
    return (tried - {word}) & words.keys()


def expected(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: one_apart(w, words) for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 2 * words[w] else None
    found = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        found.append((w, forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(found, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdeéÿ÷") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    words = []
    for stem in stems:
        for _ in range(12):
            w = stem
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcdeé") + w[k + 1:], w[:k] + rng.choice("abz") + w[k:]])
            words.append(w)
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "aabbaa", "aabba", "aabaa", "abbaa", "ABBAA", "ÀBBAA", "àbbaa"]
    weights = [rng.choice([1, 1, 3, 9, 40]) for _ in words]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 30, 300])))) for k in range(120)]
    long = "x" * 3000 + "y" * 3000
    return docs + [
        (None, " ".join(words * 3)), (5, None), (6, ""), (7, "12 !? 日本"), (7, "aaaaa_aaaaa\0aaaaa"), (7, "aaaaa_aaaaa\0aaaaa"), (8, "KKKKK Kkkkk"),
        (9, f"{long} {long} {long} {long[1:]} {long[1:]} {long[1:]}-{long[1:]} " + f"{long}z " * 7), (10, "aaaaa " * 30_000), (11, "Āaaaaa Ŏaaaaa")]


def test_variants_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    for name in ("word", "n", "block", "list", "left", "root", "form", "slices"):
        docs = docs.withColumn(name, F.lit("extra"))
    assert found(spelling.spelling_groups(docs)) == expected(rows)


def test_small_blocks_and_sliced_lists(spark, rows):
    """Many blocks, lists cut into slices, words searched for in small batches: the same rows."""
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert found(spelling.spelling_groups(docs, block_words=40, batch_words=7)) == expected(rows)


def test_index_ranges_are_suffix_ranks():
    """Ranges of patterns, grown to either side, hold the ranks of the round text's suffixes that start with them."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))).encode() for _ in range(60)})
    index = spelling.WordIndex(words)
    text = b"\0" + b"\0".join(words)
    def ranks(t, pattern):
        turned = sorted(t[k:] + t[:k] for k in range(len(t)))
        return [k for k, x in enumerate(turned) if (x + x).startswith(pattern)]

    for _ in range(200):
        state, pattern = index.start(1), b"\0"
        for _ in range(rng.randint(1, 5)):
            c, left = rng.choice([0, 97, 98, 99]), rng.random() < 0.5
            state = index.extend(state, index.code[np.array([c])], left)
            pattern = bytes([c]) + pattern if left else pattern + bytes([c])
            lo, size, back = (int(x[0]) for x in state)
            assert size == len(ranks(text, pattern))
            if not size:
                break
            assert list(range(lo, lo + size)) == ranks(text, pattern)
            assert list(range(back, back + size)) == ranks(text[::-1], pattern[::-1])


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(spelling.spelling_groups(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, "ab cd")], [(1, "alone alone alone")]):
        assert found(spelling.spelling_groups(spark.createDataFrame(rows, DOCS))) == expected(rows)
