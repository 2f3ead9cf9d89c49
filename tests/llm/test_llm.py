"""The llm operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import html
import json
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, keyed, lengths, main_text, outliers, packing, revisits, similar, suffixes, tokens, toxicity
from tidemark.llm.components import components
from tidemark.llm.registry import QUERIES, SQL
from tidemark.session import shared_dir

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))


def plain_words(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return WORD.findall(low)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, odd characters, clashing extra columns."""
    rng = random.Random(5)
    base = prose(rng, 200)
    rows = [
        (1, base, "en", "a", 5), (1, base, "en", "a", 5), (2, base + " more", "en", "a", None), (3, None, "en", None, 0),
        (4, "", None, "a", 0), (None, "null id " + base, None, None, None), (5, LONG, "de", "b", 1), (6, LONG, "de", "b", 1),
        (7, "one", "en", "a", 1), (8, " \t\n  ", "en", "a", 1), (9, "à   x\ty  z\r\n\n<|endoftext|> it's", "fr", "a", 1),
        (10, "### $$$ " * 60, "en", "a", 1), (11, "the same words again " * 40, "en", "a", 1), (12, None, "en", None, 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("h", "node", "spans", "kept", "hits", "n_words", "items", "ranges", "_row", "d2", "g", "x1", "m0", "_s", "fold",
                 "Path", "sketch", "root", "a", "b", "at", "shard", "piece", "length", "start", "score", "anchor"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def empty_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, ""), (None, "null id item here"),
         (1, "one two three four five six seven eight nine ten eleven"), (5, "single"), (12, "two three four five six seven eight nine ten eleven")],
        "item_id long, text string").withColumn("n_words", F.lit("extra"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- tokens, lengths, packing, keyed store -------------------------------------------------


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, spaced, odd_docs, sf_dir, spark):
    texts = [r.text for r in odd_docs.collect()] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["x..", "a,b, c.", "It's we'll, don't.", "\x1c a\x1fb", "İstanbul ΣΣ.", " lead", "trail ", "\0 nul \0", "A.\nB", "12.5, 3"]
    encoder = tokens.Encoder(name, spaced)
    whole = [encoder.whole(t) if t else b"" for t in texts]
    assert encoder.batch(texts) == whole
    assert encoder.batch(texts) == whole  # from the cache


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_fresh_library(name, spaced, odd_docs):
    """Texts that hold added tokens get the ids of a tokenizer with nothing set."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [r.text for r in odd_docs.collect() if r.text]
    texts += [x for t in library.get_added_tokens_decoder().values() for x in (t.content, f"a {t.content} b", f"a{t.content}b. {t.content.upper()}")]
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.Encoder(name, spaced).batch(texts) == expected


def test_words_are_encoded_together_and_cut_right():
    encoder = tokens.Encoder("word_bpe_49k.json", False)
    asked = []

    class Library:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            return library.encode(text, **options)

    library, encoder._library = encoder._library, Library()
    letters = [f"{a}{b}{c}" for a in ("tho", "É", "ñosc", "İ", "ß", "ﬁ") for b in ("um", "ǅ", "世") for c in ("ble", "ê", "ΑΣ")]
    plain = [f"pre{a}{b}fix" for a in "abcdefghij" for b in "klmnopqrst"]
    marks = ["", ".", "***", "&&&", ".$$$", "'", "'s", "don't", "\u0301", "’", "9", "_x", "</w>", "\U00010d4a."]
    words = [w + m for w in letters for m in marks] + plain + ["\U00010d4a,", "***", "'s", "a\u0301", "\u0301a"]
    random.Random(3).shuffle(words)
    texts = [" ".join(words), *words, None, ""]
    wanted = [b"" if t is None else np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.batch(texts) == wanted
    asked.clear()
    fresh = [f"zq{w}" for w in plain]
    assert encoder.batch([" ".join(fresh)]) == [np.array(library.encode(" ".join(fresh), add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(asked) < len(fresh) / 10


def test_byte_level_words_are_encoded_together_and_cut_right(monkeypatch):
    encoder = tokens.Encoder("byte_bpe_50k.json", True)
    asked = []

    class Library:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.library.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            return self.library.encode(text, **options)

    library = encoder._library
    for name in ("_library", "_by_space"):
        if hasattr(encoder, name):
            setattr(encoder, name, Library(getattr(encoder, name)))
    letters = [f"{a}{b}{c}" for a in ("tho", "É", "ñosc", "İ", "ß", "ﬁ", "ɏ") for b in ("um", "ǅ", "世", "²", "×") for c in ("ble", "ê", "ΑΣ", "5")]
    plain = [f"pre{a}{b}fix" for a in "abcdefghij" for b in "klmnopqrst"]
    marks = ["", ".", ",", "..", ",.", ".,a", ",000.5", "_.", "***", "&&&", ".$$$", "!,", "'", "'s", "'s.", "'.s", "\u0301,", "’.", "½.", "\xad.", "\U00010d4a."]
    words = [w + m for w in letters for m in marks] + plain + ["\U00010d4a,", "***", "'s", "a\u0301", "\u0301a", ",", ".", "Ġ", "Ċ.", "\x7f", "\x01a"]
    random.Random(3).shuffle(words)
    texts = [" ".join(words), "\n".join(words), *words, *(f" {w}" for w in words), *(f"{w} " for w in words), *(f"a {w},\n{w}." for w in words), None, ""]
    wanted = [b"" if not t else np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.batch(texts) == wanted
    monkeypatch.setattr(tokens, "CHARS_AT_ONCE", 40, raising=False)
    assert tokens.Encoder("byte_bpe_50k.json", True).batch(texts) == wanted
    asked.clear()
    fresh = [f"zq{w}" for w in plain]
    assert encoder.batch([" ".join(fresh)]) == [np.array(library.encode(" ".join(fresh), add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(asked) < len(fresh) / 10


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_marks_behind_a_letter_that_ends_in_a_dot_when_lowered(name, spaced):
    encoder = tokens.Encoder(name, spaced)
    texts = [f"{w}{m}" for w in ("İ", "Tİ", "aİb", "É", "i\u0307") for m in ("", ".", "!,", "'s", ". x")]
    assert encoder.batch(texts) == [encoder.whole(t) for t in texts]


def test_encoder_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    encoder = tokens.Encoder("byte_bpe_50k.json", True)
    texts = [f"word{k} other{k}, again{k}." for k in range(300)]
    assert encoder.batch(texts) == [encoder.whole(t) for t in texts]


def test_length_histogram(spark, odd_docs, empty_docs, sf_dir):
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        encoder = tokens.Encoder("byte_bpe_50k.json", True)
        own = [1 + len(encoder.whole(r.text)) // 4 if r.text else 1 for r in docs.select("text").collect()]
        sums = lengths.suffix_sums(lengths.length_histogram(lengths.encoded_lengths(docs)), block=8)
        expected = [
            (n, own.count(n), sum(x > n for x in own), sum(x for x in own if x > n), sum(x <= n for x in own),
             sum(x for x in own if x <= n), sum(min(x, n) for x in own), sum(x <= n for x in own) / len(own))
            for n in set(own)]
        assert rows_of(sums) == sorted(expected, key=str)
        limits = [0, 1, 7, 100, 10**6]
        assert rows_of(lengths.answer_limits(sums, limits)) == sorted(
            ((n, sum(x <= n for x in own), sum(x > n for x in own), sum(min(x, n) for x in own)) for n in limits), key=str)
    none = lengths.suffix_sums(lengths.length_histogram(lengths.encoded_lengths(empty_docs)))
    assert none.count() == 0
    assert rows_of(lengths.answer_limits(none, [5])) == [(5, 0, 0, 0)]


def check_packed(packed, docs, size, end):
    encoder = tokens.Encoder("word_bpe_49k.json", False)
    expected = collections.Counter()
    for doc_id, text in docs:
        body = (encoder.whole(text) if text else b"") + end.to_bytes(4, "little")
        for k, at in enumerate(range(0, len(body), 4 * size)):
            part = body[at:at + 4 * size]
            expected[doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected
    by_sequence = collections.defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), sum(k[3] * n for k, n in expected.items())


def test_packing(spark, odd_docs, empty_docs, sf_dir):
    packed = packing.pack(packing.token_pieces(odd_docs)).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in odd_docs.collect()], 2048, 0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used, total = check_packed(packing.pack(packing.token_pieces(docs, size=512), 512).collect(),
                               [(r.doc_id, r.text) for r in docs.collect()], 512, 0)
    assert used <= 1.1 * total / 512 + 8
    assert packing.pack(packing.token_pieces(empty_docs)).count() == 0


def test_open_bins_are_best_fit_and_bounded():
    rng = random.Random(2)
    bins, free = packing.OpenBins(100, 5), {}
    for _ in range(3000):
        n = rng.randint(1, 100)
        before = dict(free)
        number, at = bins.put(n)
        fitting = [f for f in before.values() if f >= n]
        if fitting:
            assert before[number] == min(fitting) and at == 100 - before[number]
        else:
            assert number not in before and at == 0
        open_ = {x for own in bins.bins for x in own}
        closed = before.keys() - open_ - {number}
        assert len(closed) == int(not fitting and len(before) == 5) and len(open_) <= 5
        assert all(before[x] == min(before.values()) for x in closed)
        free = {x: f for x, f in before.items() if x in open_}
        if number in open_:
            free[number] = before.get(number, 100) - n
        assert all(x in bins.bins[f] for x, f in free.items())


def test_keyed_store(spark, odd_docs, empty_docs, sf_dir):
    encoder = tokens.Encoder("byte_bpe_50k.json", True)
    for docs, shards in ((odd_docs, 3), (spark.read.parquet(f"{sf_dir}/documents.parquet"), 4)):
        store = keyed.write_store(docs, shared_dir(spark, "store"), shards=shards)
        expected, start = [], 0
        every = sorted(((r.doc_id, r.text) for r in docs.collect()),
                       key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        for doc_id, text in every:
            body = (encoder.whole(text) if text else b"") + (2).to_bytes(4, "little")
            expected.append((doc_id, start, len(body) // 4, zlib.crc32(body)))
            start += len(body) // 4
        assert rows_of(keyed.lookup(store, docs)) == sorted(expected, key=str)
        unknown = spark.createDataFrame([(-5,), (10**12,), (123456789,)], "doc_id long")
        assert keyed.lookup(store, unknown).count() == 0
    none = keyed.write_store(empty_docs, shared_dir(spark, "store"))
    assert keyed.lookup(none, odd_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    index = keyed.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    stuck = keyed.PerfectHash.build(keys, levels=1)  # most keys behind the levels
    assert sorted(stuck.slots(keys).tolist()) == list(range(len(keys)))


# --- quality ------------------------------------------------------------------------------


def plain_stats(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))


def test_word_stats(odd_docs, sf_dir, spark):
    texts = [r.text for r in odd_docs.collect()] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["a b a b a b", "x\nx\n \nx", "\x0b\x0ca\x1cb c", "a b c a b c d"]
    for t in texts:
        assert outliers.word_stats(t)[:5] == plain_stats(t)


def test_mcd_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(401, 4)) * [0.2, 0.5, 0.3, 0.4] + [1, 2, 3, 4]
    x[:90] += [1.5, -3, 2, 2]
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, x1 double, x2 double, x3 double, x4 double")
    got = outliers.fit_mcd(rows).collect()[0]
    at_rank = lambda v, p: np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]
    floor = np.square(outliers.LEAST_SPREAD)
    center = np.array([at_rank(x[:, k], 0.5) for k in range(4)])
    mad = np.array([at_rank(abs(x[:, k] - center[k]), 0.5) for k in range(4)])
    inverse = np.diag(1 / ((1.4826 * mad) ** 2 + floor))
    factor = 0.5 / outliers.chi2_cdf(outliers.chi2_quantile(0.5, 4), 6)
    for _ in range(6):
        d = np.einsum("ij,jk,ik->i", x - center, inverse, x - center)
        near = x[d <= at_rank(d, 0.5)]
        moved = near.mean(axis=0)
        stop = (abs(moved - center) / outliers.LEAST_SPREAD).sum() < 1e-3
        center, inverse = moved, np.linalg.inv(np.cov(near.T, bias=True) * factor + np.diag(floor))
        if stop:
            break
    assert np.allclose([got[f"m{i}"] for i in range(4)], center)
    assert np.allclose([got[f"p{i}{j}"] for i, j in outliers._PAIRS], [inverse[i, j] for i, j in outliers._PAIRS], rtol=1e-5)
    far = x - center
    assert (np.einsum("ij,jk,ik->i", far, inverse, far)[:90] > outliers.chi2_quantile(1 - outliers.TAIL, 4)).mean() > 0.9


def test_quality_verdicts(spark, sf_dir, odd_docs, empty_docs):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged = outliers.judge(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept for r in judged if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in judged)
    assert sum(not r.kept for r in judged if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in judged)
    odd = outliers.judge(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    for r in odd:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept is not None and not (r.base_failed and r.kept)
    assert outliers.judge(empty_docs).count() == 0


def test_chi2():
    assert abs(outliers.chi2_quantile(0.95, 4) - 9.487729) < 1e-5 and abs(outliers.chi2_cdf(9.487729, 4) - 0.95) < 1e-6


# --- toxicity -----------------------------------------------------------------------------


def test_maximal_segments_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 14)
        scores = [rng.choice([-1.0, -1.0, 0.5, 1.5, 2.5]) for _ in range(n)]

        def split(a, b):  # the definition: the best segment, then what is left of it and right of it
            best = max(((sum(scores[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            return [*split(a, best[2]), (best[0], best[2], best[3]), *split(best[3], b)]

        places = [k for k, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(places, [scores[k] for k in places], 1.0)
        assert sum(s for s, _, _ in got) == pytest.approx(sum(s for s, _, _ in split(0, n)))
        assert max([s for s, _, _ in got], default=0) == max([s for s, _, _ in split(0, n)], default=0)


def test_toxic_held_out_accuracy(spark):
    sf = os.environ.get("TEST_TOXIC_DIR", "/root/testdata/sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = docs.filter(toxicity.fold_of() == 0).join(labels, "doc_id").select("doc_id", "text", "toxic")
    got = toxicity.score(held.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    worst = next(r for r in toxic if r.predicted)
    assert worst.passages and all(p.start < p.end for p in worst.passages)


def test_toxicity_odd_rows(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (5, 0), (5, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(empty_docs, toxicity.fit(empty_docs, labels.limit(0))).count() == 0


# --- decontamination ----------------------------------------------------------------------


def plain_contamination(docs, items):
    windows = collections.defaultdict(set)
    for item_id, text in items:
        words = plain_words(text)
        for k in range(max(1, len(words) - 9)) if words else []:
            windows[tuple(words[k:k + 10])].update([] if item_id is None else [str(item_id)])
    found = []
    for doc_id, text in docs:
        words, hit, owners = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                own = windows.get(tuple(words[k:k + n]))
                if own is not None:
                    hit |= set(range(k, k + n))
                    owners |= own
        found.append((doc_id, len(words), len(hit), ",".join(sorted(owners))))
    return sorted(found, key=str)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_contamination(spark, odd_docs, empty_docs, items, sf_dir, block):
    def run(docs, items):
        return rows_of(decontaminate.contamination(docs, items, block_bytes=block).select(
            "doc_id", "n_words", F.expr("aggregate(ranges, 0L, (n, r) -> n + r.end - r.start)"), F.concat_ws(",", "items")))

    extra = spark.createDataFrame(
        [(100, "x One, two three four five six seven eight nine TEN eleven y short  item. single"), (101, "short"), (102, "item short item short item"),
         (103, "null id item here " * 3), (104, "two three four five six seven eight nine ten")], "doc_id long, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    assert run(docs, items) == plain_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert run(empty_docs, items) == []
    assert all(r[2] == 0 for r in run(odd_docs, items.limit(0)))


def test_contamination_query(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    expected = [(d, n, h, len(o.split(",")) if o else 0, hashlib.sha256(o.encode()).hexdigest(), h > 0)
                for d, n, h, o in plain_contamination([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])]
    got = QUERIES["op6_benchmark_decontamination"](spark, sf_dir).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(got) == sorted(expected, key=str)


# --- similar texts ------------------------------------------------------------------------


def plain_classes(docs):
    sets = []
    for k, (_, text) in enumerate(docs):
        words = plain_words(text)
        sets.append({tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else {("-", text or "")})
    up = list(range(len(docs)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    holders = collections.defaultdict(list)
    for k, own in enumerate(sets):
        common = collections.Counter(j for s in own for j in holders[s])
        for j, n in common.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                up[max(find(k), find(j))] = min(find(k), find(j))
        for s in own:
            holders[s].append(k)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        least[find(k)] = min((x for x in (doc_id, least.get(find(k))) if x is not None), default=None)
    return sorted(((docs[k][0], least[find(k)]) for k in range(len(docs))), key=str)


def test_similar_texts(spark, odd_docs, empty_docs, sf_dir):
    rng = random.Random(8)
    made, next_id = [], 1000
    for group in (2, 3, 60):  # chains and a large group of near copies
        words = prose(rng, 150).split()
        for _ in range(group):
            words = list(words)
            words[rng.randrange(len(words))] = prose(rng, 1)
            made.append((next_id, " ".join(words)))
            next_id += 1
    words = prose(rng, 150).split()
    for _ in range(40):  # all near one text
        own = list(words)
        for _ in range(2):
            own[rng.randrange(len(own))] = prose(rng, 1)
        made.append((next_id, " ".join(own)))
        next_id += 1
    passage = prose(rng, 40)
    made += [(next_id + k, prose(rng, 60) + " " + passage + " " + prose(rng, 60)) for k in range(40)]
    docs = odd_docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"), allowMissingColumns=True)
    got = rows_of(similar.classes(docs).select("doc_id", "class_id"))
    assert got == plain_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert similar.classes(empty_docs).count() == 0


def test_similar_texts_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(QUERIES["op7_chosen_path_join"](spark, sf_dir).select("doc_id", "class_id")) == plain_classes(docs)


def test_blocks_of_a_dense_bucket(spark):
    rng = np.random.default_rng(6)
    sketch = rng.integers(0, 3, (30, similar.COORDINATES), dtype=np.uint32)
    sketch[10:20] = sketch[0]
    sketch[10:20, 0] = np.arange(10)
    sets = spark.createDataFrame([(bytes([k]), bytearray(s.tobytes())) for k, s in enumerate(sketch)], "node binary, sketch binary")
    members = sets.select(F.lit(1).cast("long").alias("path"), "node", F.col("node").alias("root"), F.lit(30).alias("size"))
    need = similar.least_agreement(0.8)
    expected = {(bytes([a]), bytes([b])) for a in range(30) for b in range(a + 1, 30) if (sketch[a] == sketch[b]).sum() >= need}
    for block in (1000, 7):
        got = {(bytes(r.a), bytes(r.b)) for r in similar._best_across(members, sets, 0.8, block, 30).collect()}
        assert got == expected
        first = {(bytes(r.a), bytes(r.b)) for r in similar._best_across(members, sets, 0.8, block, 1).collect()}
        assert first <= expected and {x for p in first for x in p} == {x for p in expected for x in p}


def test_recall_in_the_last_buckets(spark):
    """Pairs right at the least similarity meet as often as promised where every bucket is split to the last step."""
    assert similar.miss_chance(similar.runs_needed(), 0.8) <= 1 - similar.RECALL < similar.miss_chance(11, 0.8)
    rng = np.random.default_rng(3)
    n = 8000
    left = rng.integers(0, 2**32, (n, similar.COORDINATES), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.8, left, rng.integers(0, 2**32, left.shape, dtype=np.uint32))
    rows = [(k.to_bytes(3, "big") + side, bytearray(x.tobytes())) for side, part in ((b"a", left), (b"b", right)) for k, x in enumerate(part)]
    sets = shared_dir(spark, "sets")
    spark.createDataFrame(rows, "node binary, sketch binary").write.parquet(sets)
    met = similar.buckets(spark.read.parquet(sets), small=1)
    pairs = met.groupBy("path", F.substring("node", 1, 3).alias("pair")).count().filter("count = 2").select("pair").distinct().count()
    assert n - pairs <= n * (1 - similar.RECALL)


def test_links_are_counted_whole(spark):
    """n_links is the number of different sets within reach, for every document of a dense class and of a chain."""
    rng = random.Random(12)
    docs = []
    dense, chain = prose(rng, 300).split(), prose(rng, 150).split()
    for k in range(40):  # all near each other
        own = list(dense)
        own[7 * k + 3] = prose(rng, 1)
        docs.append((k, " ".join(own)))
    for k in range(40):
        chain = list(chain)
        chain[rng.randrange(150)] = prose(rng, 1)
        docs.append((100 + k, " ".join(chain)))
    docs += [(200, docs[0][1]), (201, None), (202, prose(rng, 30))]
    sets = {k: frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) for k, w in ((k, (t or "").split()) for k, t in docs)}
    expected = {k: sum(len(own & x) >= 0.8 * len(own | x) for x in set(sets.values()) - {own} if own and x) for k, own in sets.items()}
    assert all(expected[k] == 39 for k in [*range(40), 200]) and len({expected[100 + k] for k in range(40)}) > 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in similar.classes(df).collect()} == expected
    members = similar.similarity_join(similar.keyed(df), block=7)[0]  # blocks
    assert {r.doc_id: r.n_links for r in members.collect()} == expected


def test_links_across_blocks(spark):
    """Sets of one bucket in several paths and blocks: the links found connect what brute force connects."""
    rng = random.Random(11)
    words = prose(rng, 60).split()
    docs = []
    for k in range(40):
        own = list(words)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(60)] = prose(rng, 1)
        docs.append((k, " ".join(own)))
    df = similar.keyed(spark.createDataFrame(docs, "doc_id long, text string"))
    sets = similar.sketches(df).groupBy("node").agg(
        F.min(F.struct("doc_id", "h")).alias("at"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    names = {bytes(r.node): r.at.doc_id for r in sets.collect()}
    members = sets.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("path"), "node", F.col("node").alias("root"), F.lit(40).alias("size"))
    expected = plain_classes(docs)
    for block in (1000, 9):
        links = similar._links_across(members, sets, df, 0.8, block)
        roots = {bytes(r.node): bytes(r.root) for r in components(links).collect()}
        least = {}
        for node, doc in names.items():
            least.setdefault(roots.get(node, node), []).append(doc)
        text_class = {d: min(own) for own in least.values() for d in own}
        by_text = {}
        for d, t in docs:
            by_text.setdefault(t, d)
        assert sorted(((d, text_class[by_text[t]]) for d, t in docs), key=str) == expected


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 380)] + [(5, 5)]
    up = {x: x for p in links for x in p}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated strings ---------------------------------------------------------------------


def plain_repeats(docs, length=200):
    bodies = [(d, (t or "").encode()) for d, t in docs]
    count = collections.Counter(b[k:k + length] for _, b in bodies for k in range(len(b) - length + 1))
    found = []
    for doc_id, body in bodies:
        flags = bytearray(len(body))
        for k in range(len(body) - length + 1):
            if count[body[k:k + length]] > 1:
                flags[k:k + length] = b"\1" * length
        spans = sum(1 for k, f in enumerate(flags) if f and not (k and flags[k - 1]))
        found.append((doc_id, len(body), sum(flags), spans, hashlib.sha256(bytes(b for b, f in zip(body, flags) if not f)).hexdigest()))
    return sorted(found, key=str)


def repeats_of(docs):
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return rows_of(suffixes.without_repeats(docs).select(
        "doc_id", F.octet_length("kept") + removed, removed, F.size("spans"), F.sha2("kept", 256)))


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdef", bytes(range(256))])
def test_two_stage_order(alphabet):
    rng = random.Random(len(alphabet))
    for n in (0, 1, 2, 3, 50, 400):
        text = bytes(rng.choice(alphabet) for _ in range(n))
        order = suffixes.two_stage_order(np.frombuffer(text, np.uint8), 40)
        assert sorted(order.tolist()) == list(range(n))
        cut = [text[k:k + 40] for k in order]
        assert cut == sorted(cut)
        shared = suffixes.adjacent_prefixes(np.frombuffer(text, np.uint8), order, 40)
        for a, b, s in zip(cut, cut[1:], shared[1:].tolist()):
            # past the end zero bytes stand in, which only a text of zero bytes shares
            assert s >= len(os.path.commonprefix([a, b])) and (s == len(os.path.commonprefix([a, b])) or min(len(a), len(b)) < 40)


def test_repeats(spark, odd_docs, empty_docs, monkeypatch):
    rng = random.Random(1)
    base = "".join(rng.choice("abcde é") for _ in range(3000))
    noise = lambda: "".join(rng.choice("fghij") for _ in range(rng.randint(50, 300)))
    made = [(100, base), (101, base[100:900] + "X" + base[1000:1300]), (102, "a" * 300), (103, "b" * 199), (104, "b" * 200),
            (105, "cd" * 400 + base[500:699]), (106, base[2500:2700] + "Q" * 50 + base[2500:2710]), (107, "cd" * 100), (108, "x" * 200 + "y"),
            (109, "z" + "x" * 200)]
    made += [(200 + k, noise() + base[1500:1720] + noise()) for k in range(30)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    expected = plain_repeats(made)
    assert repeats_of(docs) == expected
    own = suffixes.repeats
    monkeypatch.setattr(suffixes, "repeats", lambda *a, **b: own(*a, **{**b, "hot_pieces": 2}))
    assert repeats_of(docs) == expected  # windows of hot anchors are counted
    monkeypatch.undo()
    short = odd_docs.withColumn("text", F.substring("text", 1, 4000))
    assert repeats_of(short) == plain_repeats([(r.doc_id, r.text) for r in short.collect()])
    assert suffixes.without_repeats(odd_docs).count() == odd_docs.count()
    assert suffixes.without_repeats(empty_docs).count() == 0


def test_repeats_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op9_suffix_array_dedup"](spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(got) == plain_repeats(docs)


# --- pages and captures -------------------------------------------------------------------


def test_main_text_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op8_text_density"](spark, sf_dir).collect()}
    block = re.compile(r"</?(p|h1|br|li|ul)\b")
    for page in pages:
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if block.match(m[0]) else "", inner)).split())
        assert got[page.page_id] == (text, len(text))


PARAGRAPHS = "<p>The first paragraph of the text, which is long enough to count.</p><p>A second one&nbsp;with <a href=x>a link</a> in it &amp; more.</p>"
TEXT = "The first paragraph of the text, which is long enough to count. A second one with a link in it & more."


@pytest.mark.parametrize("source,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<b>b</b>c", "abc"), ("<script>x<y</script>", ""), ("a < b", "a < b"),
    (f"<body><nav><a>x</a></nav>{PARAGRAPHS}<footer>f</footer>", TEXT),
    (f"<body class='has-sidebar'><div id=sidebar>{'side ' * 200}</div><div class=content><h1>T</h1>{PARAGRAPHS}</div></body>", f"T {TEXT}"),
    (f"<article><header><h1>T</h1></header>{PARAGRAPHS}<div class='comment-list'><p>{'talk ' * 300}</p></div></article>", f"T {TEXT}"),
    (f"<body><div class='cookie-notice'>ok</div><main>{PARAGRAPHS}<form><input>Mail</form><!-- {PARAGRAPHS} --></main>", TEXT),
    (f"<div><ul><li>one<li>two</ul><br>{PARAGRAPHS}<aside>x</aside></div>", f"one two {TEXT}"),
    ("<div>" * 2000 + "deep" + "</div>" * 2000, "deep"),
    (f"<body>{PARAGRAPHS}<p>cut <a hr", f"{TEXT} cut"),
    (f"<div role=navigation>x</div><div hidden>y</div><div style='display:none'>z</div>{PARAGRAPHS}", TEXT),
])
def test_main_text(source, text):
    assert main_text.main_text(source) == text


@pytest.mark.parametrize("source,text", [
    (f"<body><p>we </3 you</p>{PARAGRAPHS}", f"we {TEXT}"), (f"<body><p>one</>two</p>{PARAGRAPHS}", f"onetwo {TEXT}"),
    (f"<body><p>one</ p>two</p>{PARAGRAPHS}", f"onetwo {TEXT}"), (f"<body><p>see <имя> and <é</p>{PARAGRAPHS}", f"see <имя> and <é {TEXT}"),
    (f"<body>{PARAGRAPHS}<p>cut </", f"{TEXT} cut"), (f"<body>{PARAGRAPHS}<p>cut </3 off", f"{TEXT} cut"),
])
def test_text_behind_odd_angles(source, text):
    assert main_text.main_text(source) == text


MORE = f"<p>{'A part of the article with its own title. ' * 4}</p>"
MORE_TEXT = " ".join(["A part of the article with its own title."] * 4)


@pytest.mark.parametrize("source,text", [
    *((f"<body><article><h1>T</h1>{PARAGRAPHS}<h2 id='{slug}'>Title</h2>{MORE}</article>", f"T {TEXT} Title {MORE_TEXT}")
      for slug in ("search-algorithms", "advertising", "social")),
    *((f"<body><article><h1>T</h1>{PARAGRAPHS}<section id='{slug}'><h2>Title</h2>{MORE}</section></article>", f"T {TEXT} Title {MORE_TEXT}")
      for slug in ("social-history", "related-work", "notification-system", "legal-background", "navigation")),
    (f"<body><div><h1>T</h1>{PARAGRAPHS}<div id='social-history'>{MORE}</div></div>", f"T {TEXT} {MORE_TEXT}"),
    (f"<article>{PARAGRAPHS}<p class='foot-note'>A note.</p></article>", f"{TEXT} A note."),
    (f"<article>{PARAGRAPHS}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", f"{TEXT} so x=1 holds"),
    (f"<body><article>{PARAGRAPHS}</article><article>{MORE}</article></body>", f"{TEXT} {MORE_TEXT}"),
    (f"<body><article>{PARAGRAPHS * 3}</article><div>{MORE}</div></body>", f"{TEXT} {TEXT} {TEXT} {MORE_TEXT}"),
    *((f"<body><article>{PARAGRAPHS}<div class='{name}'><p>{'talk ' * 300}</p></div></article>", TEXT)
      for name in ("site-footer", "sidebar", "comments_section", "ad-300x250", "nav__list", "related-posts", "post-tags", "widget-3")),
    (f"<article>{PARAGRAPHS}<section id='comments'><p>{'talk ' * 300}</p></section></article>", TEXT),
])
def test_only_noise_is_dropped_by_name(source, text):
    assert main_text.main_text(source) == text


def test_pages_with_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>x"), (2, "u", "<p>x"), (3, "u", "<p>" + "long " * 200_000)],
                                  "page_id long, url string, html string").withColumn("text", F.lit("extra"))
    assert [(r.page_id, len(r.text), r.n_chars) for r in main_text.extract(pages).orderBy("page_id", "n_chars").collect()] == [
        (None, 0, 0), (1, 0, 0), (2, 1, 1), (2, 1, 1), (3, 999_999, 999_999)]
    assert main_text.extract(pages.limit(0)).count() == 0


def test_canonical_urls(spark):
    same = ["http://www.A.org/x/?b=2&utm_source=q&a=1#f", "https://a.org:443/x?a=1&b=2", "HTTP://a.org/x?ref=z&a=1&b=2"]
    got = spark.createDataFrame([(u,) for u in [*same, None, "", "https://a.org", "https://a.org/?utm_x=1"]], "u string").select(
        revisits.canonical_url(F.col("u"))).collect()
    assert [r[0] for r in got] == ["//a.org/x?a=1&b=2"] * 3 + [None, "//", "//a.org", "//a.org"]


def plain_resolution(captures):
    found = []
    for v in captures:
        if v["kind"] != "revisit":
            continue
        before = [r for r in captures if r["kind"] == "response" and r["status"] == 200 and r["url"] is not None and r["url"] == v["url"]
                  and None not in (r["captured_at"], v["captured_at"]) and r["captured_at"] < v["captured_at"]]
        r = max(before, key=lambda r: (r["captured_at"], r["record_id"]), default=None)
        bare = lambda t: t[2:] if t and t.startswith("W/") else t
        if r is None:
            found.append((v["record_id"], "no_response", None, None, None))
            continue
        outcome = "unchecked"
        for name, own in (("etag", bare), ("last_modified", str), ("digest", str)):
            if v[name] is not None:
                outcome = "resolved" if r[name] is not None and own(v[name]) == own(r[name]) else "mismatch"
                break
        ok = outcome != "mismatch"
        found.append((v["record_id"], outcome, r["record_id"], (v["date"] or r["date"]) if ok else None, r["content_type"] if ok else None))
    return sorted(found, key=str)


@pytest.mark.parametrize("seconds", [3, 1000])
def test_revisits(spark, seconds):
    rng = random.Random(seconds)
    names = ["record_id", "kind", "status", "url", "captured_at", "digest", *revisits.RENEWED, *revisits.STORED]
    rows = []
    for k in range(400):
        row = dict.fromkeys(names)
        row.update(record_id=k, kind=rng.choice(["response", "revisit"]), status=rng.choice([200, 200, 200, 404, None]),
                   url=rng.choice(["//hot", "//hot", "//b", None]), captured_at=rng.choice([None, *range(60)]), digest=rng.choice([None, "d1", "d2"]),
                   etag=rng.choice([None, None, '"a"', 'W/"a"', '"b"']), last_modified=rng.choice([None, "m1", "m2"]), date=rng.choice([None, f"t{k}"]),
                   content_type=rng.choice(["x", "y"]))
        row["url"] = None if row["url"] is None else "http:" + row["url"]
        rows.append(row)
    schema = ", ".join(f"{n} {'long' if n in ('record_id', 'captured_at') else 'int' if n == 'status' else 'string'}" for n in names)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema).withColumn("page", F.lit("extra")).withColumn("slice", F.lit("x"))
    got = revisits.resolve(df, seconds).select("record_id", "outcome", "refers_to", "date", "content_type")
    assert rows_of(got) == plain_resolution(rows)
    assert revisits.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    theirs = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(theirs.columns) == columns
    expected = theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows_of(df.select(*columns)) == sorted(map(tuple, expected), key=str)


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, "stage")
        stage(spark, seen[-1], sf_dir).write.parquet(path)
        seen.append(spark.read.parquet(path))
    raw, good, single, cut, clean, packed = seen
    assert all(x.columns == corpus_pipeline.COLUMNS for x in seen[1:5])
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    kept = {r.doc_id for r in outliers.judge(raw).filter("kept").collect()}
    assert sorted(pairs(good)) == sorted(p for p in pairs(raw) if p[0] in kept)
    own = pairs(good)
    first = {c for _, c in plain_classes(own)}
    assert sorted(pairs(single)) == sorted(p for p in own if p[0] in first)
    expected = {d: (n - removed, sha) for d, n, removed, _, sha in plain_repeats(pairs(single))}
    for doc_id, text in pairs(cut):
        if hashlib.sha256(text.encode()).hexdigest() != expected[doc_id][1]:
            assert expected[doc_id][0] - 6 <= len(text.encode()) < expected[doc_id][0]  # a character was cut in two
    hit = {d for d, _, n, _ in plain_contamination(pairs(cut), items) if n}
    assert sorted(pairs(clean)) == sorted(p for p in pairs(cut) if p[0] not in hit)
    check_packed(packed.collect(), pairs(clean), 2048, 0)


def test_pipeline_takes_odd_documents(spark, odd_docs, empty_docs, sf_dir):
    import corpus_pipeline

    for docs in (odd_docs, empty_docs):
        for _, stage in corpus_pipeline.STAGES:
            path = shared_dir(spark, "stage")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)


def test_rest_works_without_this_folder():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys, json; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; print(json.dumps([len(e.queries()), sorted(e.queries())[:1], len(e.oracle_sql())]))")
    out = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, check=True).stdout
    n, _, sql = json.loads(out.strip().splitlines()[-1])
    assert n == sql > 50
