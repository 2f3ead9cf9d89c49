"""Texts longer than the blocks they are hashed in, and what a worker keeps."""

import random
import tracemalloc

import numpy as np

from tidemark.llm import common, similar, suffixes, tokens


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_shingles_do_not_depend_on_blocks(monkeypatch):
    texts = [prose(3000, 1), "", None, "x" * 5000 + " one two", prose(4, 2), "   ", prose(700, 3)]
    hashes, ends = similar.shingle_sets(texts)
    sketch = similar.min_hashes(hashes, ends)
    for block, mixed in ((64, 7), (1000, 100), (4096, 1 << 20)):
        monkeypatch.setattr(similar, "HASHED_BYTES", block)
        monkeypatch.setattr(similar, "MIXED", mixed)
        again, again_ends = similar.shingle_sets(texts)
        assert (again == hashes).all() and (again_ends == ends).all()
        assert (similar.min_hashes(again, again_ends) == sketch).all()


def test_repeats_of_a_text_longer_than_a_block(spark):
    """A passage across the edge of two blocks is found, wherever it stands elsewhere."""
    long = prose(200_000, 4)
    edge = suffixes.HASHED_BYTES
    passage = long[edge - 300:edge + 400]
    rows = [(1, long), (2, "other text " + passage + " behind it"), (3, prose(100, 5)), (4, long[: 2 * edge + 77])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffixes.without_repeats(docs).collect()}
    assert found[3] == [] and found[1] == [(0, 2 * edge + 77)] and found[4] == [(0, 2 * edge + 77)]
    assert len(found[2]) == 1 and found[2][0][0] <= 11 and found[2][0][1] >= 11 + 700


def test_twenty_megabytes_stay_small():
    """The memory of hashing one long text is a small multiple of it for op7, and bounded for a block of op9."""
    text = prose(3_500_000, 6)[: 20 << 20]
    tracemalloc.start()
    hashes, ends = similar.shingle_sets([text])
    similar.min_hashes(hashes, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    del hashes
    before = tracemalloc.get_traced_memory()[0]
    suffixes.pieces_of([text.encode()[: suffixes.HASHED_BYTES + suffixes.LENGTH - 1]])
    block = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 14 * len(text), peak / len(text)
    assert block < 64 << 20, block


def test_caches_go_when_other_modules_work():
    encoder = tokens.encoder("word_bpe_49k.json", False)
    encoder.batch(["some words"])
    assert common.cache_of("tokens")
    common.release_memory("tokens")
    assert tokens.encoder("word_bpe_49k.json", False) is encoder
    common.release_memory()
    assert not common.cache_of("tokens")
    assert np.array_equal(tokens.encoder("word_bpe_49k.json", False).batch(["some words"]), encoder.batch(["some words"]))
