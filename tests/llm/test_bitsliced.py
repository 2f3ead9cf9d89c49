"""Ranked search by bit-sliced signatures against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bitsliced

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def expected(docs, items, top=10):
    bags = [(doc_id, collections.Counter(plain_terms(text))) for doc_id, text in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    found = []
    for item_id, text in set(items):
        rows = []
        for doc_id, bag in bags:
            size, score = sum(bag.values()), 0
            for term in set(plain_terms(text)):
                if term in bag:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += w * (10**9 * bag[term] // (1000 * bag[term] + 8 * (10 + 90 * size * n // total)))
            if score > 0:
                rows.append((-score, doc_id is not None, doc_id or 0, doc_id))
        found += [(item_id, k + 1, doc_id, -score) for k, (score, _, _, doc_id) in enumerate(sorted(rows)[:top])]
    return sorted(found, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeéß1") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["日本", "😀x"]
    weights = [1 / (k + 1) for k in range(len(words))]

    def prose(n):
        return " ".join(rng.choices(words, weights, k=n))

    docs = [(k, prose(rng.choice([1, 5, 40, 200, 1500]))) for k in range(150)]
    docs += [(900, docs[3][1]), (3, docs[3][1]), (901, None), (902, ""), (None, docs[7][1]), (None, docs[7][1]), (903, "?!"), (904, "A_b-C" * 9),
             (905, "word " * 5000), (906, prose(60_000)), (907, "\0nul\x7fdel x"), (908, "ÀÉ Àé àé"), (7, "other text of a met id")]
    docs += [(1000 + k, "the same hot text " + words[3]) for k in range(70)]
    items = [(k, prose(rng.choice([2, 10, 40]))) for k in range(25)]
    items += [(1, "the same hot text"), (50, None), (51, ""), (52, "not-there-at-all zzzz"), (None, words[5]), (5, "ÀÉ"), (5, "ÀÉ"), (53, "?"),
              (54, " ".join(words)), (55, "WORD"), (56, "日本 😀X nul del")]
    return docs, items


def test_search_equals_brute_force(spark, rows):
    docs, items = spark.createDataFrame(rows[0], DOCS).repartition(4), spark.createDataFrame(rows[1], ITEMS)
    for name in ("h", "df", "term", "width", "bits", "score", "rank", "chunk", "w"):
        docs, items = docs.withColumn(name, F.lit("extra")), items.withColumn(name, F.lit("extra"))
    assert found(bitsliced.search(docs, items)) == expected(*rows)


def test_other_tops_and_chunks(spark, rows, monkeypatch):
    """Several chunks of items, few seeds: the same rows."""
    for name, value in {"ITEMS_A_CHUNK": 4, "SPREAD": 2, "SEEDS": 3}.items():
        monkeypatch.setattr(bitsliced, name, value)
    docs, items = spark.createDataFrame(rows[0], DOCS).repartition(3), spark.createDataFrame(rows[1], ITEMS)
    assert found(bitsliced.search(docs, items, 3)) == expected(*rows, top=3)


def test_bounds_are_never_below_the_score():
    rng = random.Random(4)
    bags = [collections.Counter(rng.choices(range(60), [1 / (k + 1) for k in range(60)], k=rng.choice([3, 50, 900]))) for _ in range(40)]
    hashes = {t: np.uint64(rng.getrandbits(64)) for t in range(80)}
    total = sum(b.total() for b in bags)
    n_entries = [sum(int((bitsliced.LEVELS <= tf).sum()) for tf in b.values()) for b in bags]
    block = bitsliced._Block(bitsliced.signature_width(max(n_entries)))
    for k, bag in enumerate(bags):
        entries = [bitsliced._entries(np.array([hashes[t] for t, tf in bag.items() if tf >= least], np.uint64), level)
                   for level, least in enumerate(bitsliced.LEVELS)]
        block.add(k, 0, bag.total(), np.concatenate(entries))
    stored = {"width": block.width, "lengths": [r[2] for r in block.rows], "bits": block.sliced()}
    asked = [list(range(60)), [0, 70], [75]]
    weights = [[rng.randint(1, 9000) for _ in terms] for terms in asked]
    offsets = np.cumsum([0, *map(len, asked)])
    bounds = list(bitsliced.upper_bounds(
        stored, offsets, np.array([hashes[t] for terms in asked for t in terms]), np.array(sum(weights, [])), len(bags), total))
    for terms, ws, bound in zip(asked, weights, bounds):
        for k, bag in enumerate(bags):
            m = 10 + 90 * bag.total() * len(bags) // total
            exact = sum(w * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, w in zip(terms, ws) if bag[t])
            assert exact <= (0 if bound is None else bound[k])
    # Tight as well: most documents without the terms show none.
    assert bounds[2] is None or (bounds[2] > 0).sum() < 5


def test_empty_tables(spark, rows):
    docs, items = spark.createDataFrame(rows[0][:5], DOCS), spark.createDataFrame(rows[1], ITEMS)
    assert bitsliced.search(docs.limit(0), items).collect() == []
    assert bitsliced.search(docs, items.limit(0)).collect() == []
    assert bitsliced.search(spark.createDataFrame([(1, None), (2, "")], DOCS), items).collect() == []
