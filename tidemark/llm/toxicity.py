"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import stored, table, text_batches
from tidemark.llm.decontaminate import words_of
from tidemark.llm.registry import query

# The model is fitted on at most so many labelled rows, and keeps so many features.
MAX_LABELLED = 20_000
MAX_FEATURES = 50_000
FOLDS = 5
_AFFIXES = range(3, 9)
_CACHED_WORDS = 300_000


def fold_of(doc_id="doc_id"):
    """crc32 of the id's text modulo 5; fold 0 is held out.  Null ids are in no fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def features_of(word: bytes) -> list[bytes]:
    """The word, its beginnings and its ends of 3 to 8 bytes: inflected forms share some."""
    n = len(word)
    return [b"=" + word, *(b"^" + word[:k] for k in _AFFIXES if k < n), *(b"$" + word[-k:] for k in _AFFIXES if k < n)]


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, end) of a token sequence in linear time.

    ``places`` hold the tokens with a positive score; each token between them costs
    ``drift``.  The scan keeps candidate segments with the running sum left of them
    and at their right end, and merges a new one into an earlier one as long as the
    earlier starts lower and ends lower (each candidate is merged away once).
    """
    found: list[list] = []  # [sum before, sum behind, first, end, nearest candidate that starts lower]
    total, last = 0.0, -1
    for place, score in zip(places, scores):
        total -= drift * (place - last - 1)
        last, before = place, total
        total += score
        segment = [before, total, place, place + 1, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= segment[0]:
                j = found[j][4]
            if j < 0 or found[j][1] >= segment[1]:
                segment[4] = j
                found.append(segment)
                break
            segment = [found[j][0], segment[1], found[j][2], segment[3], -1]
            del found[j:]
    return [(s[1] - s[0], s[2], s[3]) for s in found]


@dataclass
class ToxicModel:
    """Log-odds of features, drift of other tokens, extreme-value and logistic parameters."""

    odds: dict[bytes, float]
    drift: float = 1.0
    rate: float = 1.0       # lambda of the score's tail
    log_scale: float = 0.0  # ln K
    slope: float = 1.0
    offset: float = 0.0
    _scores: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_scores": {}}

    def _score(self, word: bytes) -> float:
        known = self._scores
        if len(known) > _CACHED_WORDS:
            known.clear()
        value = known[word] = max((self.odds.get(f, 0.0) for f in features_of(word)), default=0.0)
        return value

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """(words, every maximal segment of the whole text)."""
        words = words_of(text)
        known = self._scores
        places, scores = [], []
        for k, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = self._score(w)
            if s:
                places.append(k)
                scores.append(s)
        return len(words), maximal_segments(places, scores, self.drift)

    def evidence(self, n_words: int, segments: list[tuple[float, int, int]]) -> float:
        """Log of one over the expected number of segments as good in ``n_words`` clean tokens, summed."""
        base = self.log_scale + math.log(max(n_words, 1))
        return sum(max(0.0, self.rate * s - base) for s, _, _ in segments)

    def significant(self, n_words: int, segments, level: float = 0.05):
        """Segments of which fewer than ``level`` are expected by chance, best first."""
        base = self.log_scale + math.log(max(n_words, 1))
        return sorted((x for x in segments if self.rate * x[0] - base > -math.log(level)), reverse=True)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.offset))))


def _presence(rows: DataFrame, wanted: set[bytes] | None, name: str) -> DataFrame:
    """(feature, n): documents that hold the feature; summed per task before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in text_batches(batches):
            for text in batch.column(0).to_pylist():
                own = {f for w in set(words_of(text)) for f in features_of(w)}
                seen.update(own if wanted is None else own & wanted)
            if len(seen) > 500_000:
                yield _counted(seen, name)
                seen = Counter()
        yield _counted(seen, name)

    return rows.select("text").mapInArrow(count, f"feature binary, {name} long").groupBy("feature").agg(F.sum(name).alias(name))


def _counted(seen: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["feature", name])


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES,
    prior: float = 10.0, least_z: float = 2.5, least_odds: float = 2.0, least_docs: int = 4, drift: float = 1.0,
) -> ToxicModel:
    """Fit on labelled rows outside fold 0: at most ``max_labelled``, drawn by a hash of the id.

    Folds 1 to 3 give the features and their log-odds (documents that hold them, with
    a Dirichlet prior of weight ``prior`` shaped like both classes together); fold 4
    chooses how strong a feature has to be and gives the tail of clean scores and the
    final calibration.  Of equal texts the one with the least doc_id counts.  Rows without a label
    are left out; without any toxic row every score is that of an empty text.
    """
    own = fold_of()
    sample = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (own != 0))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # max_labelled narrow rows at most.
    least = F.min(F.struct("doc_id", "toxic")).alias("at")
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
                  .groupBy("text").agg(least).select("at.*", "text").withColumn("fold", own), "toxic-sample")
    wanted, scored = None, []
    # Folds 1 and 2 choose the features, fold 3 has to confirm them and gives the
    # log-odds kept: what only copies of a few texts share does not come through.
    for part, z_least in ((F.col("fold").isin(1, 2), least_z), (F.col("fold") == 3, least_z * 0.6)):
        learn = rows.filter(part)
        sizes = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        if not n1 or not n0:
            return ToxicModel({}, drift, offset=-2.0)
        # Both counts are bounded by the sample.
        y1 = {bytes(r.feature): r.y1 for r in _presence(learn.filter("toxic = 1"), wanted, "y1")
              .filter(F.col("y1") >= least_docs).collect()}
        y0 = {bytes(r.feature): r.y0 for r in _presence(learn.filter("toxic = 0"), set(y1), "y0").collect()}
        scored = []
        for feature, a in y1.items():
            b = y0.get(feature, 0)
            alpha = prior * (a + b) / (n1 + n0)
            pos, neg = a + alpha, b + alpha
            odds = math.log(pos / (n1 + prior)) - math.log(neg / (n0 + prior))
            z = odds / math.sqrt(1 / pos + 1 / neg)
            if z >= z_least and odds >= least_odds:
                scored.append((z, feature, odds))
        wanted = {f for _, f, _ in scored}
    scored.sort(reverse=True)
    # How strict the choice should be is told by fold 4 as well.
    models = [ToxicModel({f: odds for z, f, odds in scored if z >= z_min and odds >= odds_min}, drift)
              for z_min in (0.0, 3.0) for odds_min in (0.0, 2.5, 3.0, 4.0)]
    for model in models:
        model.odds = dict(list(model.odds.items())[:max_features])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.float64()))
        for batch in text_batches(batches):
            out = [[model.segments(t) for model in models] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0][0] for x in out], pa.int64()),
                 pa.array([[[s for s, _, _ in own] for _, own in x] for x in out], kind)], ["toxic", "n", "segments"])

    seen = rows.filter("fold = 4").select("toxic", "text").mapInArrow(
        measure, "toxic int, n long, segments array<array<double>>").collect()  # bounded by the sample
    losses = [_calibrate(model, [(r.toxic, r.n, [(s, 0, 0) for s in r.segments[k]]) for r in seen])
              for k, model in enumerate(models)]
    return models[int(np.argmin(losses))]


def _calibrate(model: ToxicModel, seen: list[tuple[int, int, list]]) -> float:
    """Set the model's last parameters; returns its mean log loss."""
    # Segments of clean texts: their scores above the least feature decay as
    # exp(-rate * s); one segment of mean score is added so that the rate is finite.
    floor = min(model.odds.values(), default=1.0)
    clean = [s for y, _, x in seen if not y for s, _, _ in x if s >= floor]
    mean = (sum(s - floor for s in clean) + 1.0) / (len(clean) + 1)
    model.rate = 1.0 / max(mean, 0.25)
    words = sum(n for y, n, _ in seen if not y)
    # K n exp(-rate * floor) segments are expected in n clean words.
    model.log_scale = math.log((len(clean) + 0.5) / max(words, 1)) + model.rate * floor
    x = np.array([model.evidence(n, s) for _, n, s in seen])
    y = np.array([t for t, _, _ in seen], float)
    if not len(x) or y.min() == y.max():
        model.offset = -2.0
        return 0.0
    a, b = 1.0, -2.0
    for _ in range(100):  # Newton steps with a weak prior on both
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        w = p * (1 - p)
        grad = np.array([((y - p) * x).sum() - 0.05 * (a - 1), (y - p).sum() - 0.05 * (b + 2)])
        hess = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + step[0], b + step[1]
    model.slope, model.offset = max(float(a), 1e-6), float(b)
    p = np.clip(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -60, 60))), 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Per document: score, predicted, and its significant passages as word ranges, best first.

    Scores whole texts; nothing is shuffled.  A null or empty text has no segment
    and the lowest score.  Repeated rows are scored each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                n, segments = model.segments(text)
                scores.append(model.probability(model.evidence(n, segments)))
                passages.append([{"score": s, "start": a, "end": b} for s, a, b in model.significant(n, segments)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                 pa.array(passages, pa.list_(pa.struct(
                     [("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int, passages array<struct<score:double,start:long,end:long>>")


@query("op4_toxic_segments")
def toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", "predicted",
        F.size("passages").cast("long").alias("n_passages"))
