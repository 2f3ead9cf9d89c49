"""Copies by chunk recipes against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import recipes

DOCS = "doc_id long, text string"


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def expected(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    found, staid = [], set()
    for doc_id, text in rows:
        low = lowered(text)
        ids = [x for x in groups[low] if x is not None]
        keep = max(ids) if ids else None
        kept = doc_id == keep and low not in staid
        if kept:
            staid.add(low)
        found.append((doc_id, keep, len(groups[low]), kept, hashlib.sha256(low).hexdigest()))
    return sorted(found, key=str)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, other = prose(4000), prose(900)
    rows = [
        (1, base), (2, base.upper().replace("É", "é")), (3, base + "!"), (4, "!" + base), (5, None), (6, ""), (7, None),
        (None, base), (None, "null id"), (None, "null id"), (8, other), (8, other), (9, other), (9, other), (10, "Äb"), (11, "äb"),
        (12, "aaaa" * 20_000), (13, "AAAA" * 20_000), (14, "aaaa" * 20_001), (15, "x"),
        (16, base[:9000] + base[9001:]), (17, "é" * 300), (18, "é" * 300), (19, "K"), (20, "K"), (21, "k")]
    # A hot group: a third of all rows.
    return rows + [(100 + k, "the hot text " * 90) for k in range(30)] + [(200 + k, prose(5)) for k in range(40)]


def test_copies_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for name in ("recipe", "sha", "keep_id", "kept", "salt", "times", "Text2"):
        docs = docs.withColumn(name, F.lit("extra"))
    assert found(recipes.exact_copies(docs)) == expected(rows)


def test_equal_keys_of_different_chunks(spark, rows):
    """With one byte a key, nearly every key stands for several contents; only their bytes tell copies apart."""
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert recipes._numbers(docs, 1) is not None
    assert found(recipes.exact_copies(docs, 1)) == expected(rows)


def test_same_recipe_before_verification(spark):
    """Texts whose unverified recipes are equal are not taken for copies."""
    from xxhash import xxh3_128_digest

    by_key = collections.defaultdict(list)
    for k in range(600):
        text = f"text {k}"
        by_key[xxh3_128_digest(text.encode())[:1]].append(text)
    texts = next(v for v in by_key.values() if len(v) > 2)
    rows = list(enumerate(texts * 2))
    docs = spark.createDataFrame(rows, DOCS)
    assert recipes.keyed_recipes(docs, 1).select("recipe").distinct().count() == 1
    assert found(recipes.exact_copies(docs, 1)) == expected(rows)


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(recipes.exact_copies(docs)) == expected(rows)


def test_empty_table(spark):
    assert recipes.exact_copies(spark.createDataFrame([], DOCS)).collect() == []


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 110, 1_000_000, dtype=np.uint8).tobytes()
    ends = recipes.chunk_ends([b"abc", text, b"", text])
    assert ends[0] == [3] and ends[2] == [] and ends[1] == ends[3] and ends[1][-1] == len(text)
    sizes = np.diff([0, *ends[1]])
    assert sizes.max() <= recipes.MOST_BYTES and sizes[:-1].min() >= recipes.LEAST_BYTES and 1000 < sizes.mean() < 2500
    # A byte put in front moves the cuts, but for the first few.
    later = recipes.chunk_ends([b"x" + text])[0]
    assert len(set(ends[1]) - {e - 1 for e in later}) < 10


def test_cuts_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    text = np.random.default_rng(2).integers(97, 120, 300_000, dtype=np.uint8)
    whole = recipes.cut_places(text).tolist()
    monkeypatch.setattr(recipes, "HASHED_BYTES", 1000)
    assert recipes.cut_places(text).tolist() == whole
