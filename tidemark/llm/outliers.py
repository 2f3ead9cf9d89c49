"""Quality rules: word statistics, and robust outliers among them per language and source."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import stored, table, text_batches, without
from tidemark.llm.registry import query

_SPACES = re.compile("[\x20\x09-\x0d]+")
_LINE_SPACES = "\x20\x09\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMENSIONS = ["x1", "x2", "x3", "x4"]
# Spread a dimension has at least; a statistic that is zero in most texts has none of its own.
LEAST_SPREAD = [0.06, 0.25, 0.15, 0.10]
# A group smaller than this uses its language's estimate, and that one all rows'.
LEAST_ROWS = 200
# A text as odd as this is met once in a million among normal vectors.
TAIL = 1e-6
HALF = 0.5


def word_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = [w for w in _SPACES.split(text) if w]
    lines = [x for x in text.split("\n") if x.strip(_LINE_SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        covered = bytearray(len(words))
        for k, window in enumerate(windows):
            if seen[window] > 1:
                covered[k:k + 3] = b"\1\1\1"
        repeated = sum(covered)
    return (len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(lines))


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns) with the word statistics and the base rule's verdict.

    A null text has no words.  The texts pass through, nothing is shuffled.  Columns
    that have the names of the new ones are replaced.
    """
    names = [*STATS, "n_lines"]
    docs = without(docs, [*names, "base_failed"])
    out = StructType(list(docs.schema.fields))
    at = [f.name for f in out.fields].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [word_stats(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([r[k] for r in found], pa.int64()) for k in range(6))],
                [*batch.schema.names, *names])

    for name in names:
        out = out.add(name, "long")
    return docs.mapInArrow(run, out).withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vectors() -> list[Column]:
    """The transformed statistics: log word length, log symbol share, shares of repeated lines and words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(chars / words).alias("x1"),
        F.log1p(100.0 * F.col("n_symbols") / chars).alias("x2"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x3"),
        (F.col("n_repeat_words") / words).alias("x4"),
    ]


def chi2_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))
        low, high = (x, high) if tail > 1 - p else (low, x)
    return low


def chi2_cdf(x: float, dof: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_SHAPE = ", ".join([f"m{i} double" for i in range(4)] + [f"p{i}{j} double" for i, j in _PAIRS])


def _shapes(sums: DataFrame, factor: float) -> DataFrame:
    """Center m and inverse covariance p of each group, from its sums.  One narrow row per group."""
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(0), batch.to_pylist()
            out = []
            for r in rows:
                n = max(r["n"], 1)
                mean = np.array([r[f"s{i}"] / n for i in range(4)])
                cov = np.zeros((4, 4))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = r[f"s{i}{j}"] / n - mean[i] * mean[j]
                # The least spread is added, so an exact fit has an inverse too.
                inverse = np.linalg.inv(cov * factor + np.diag(np.square(LEAST_SPREAD)))
                out.append([*mean, *(inverse[i, j] for i, j in _PAIRS)])
            values = np.array(out, float).reshape(-1, 14)
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array(values[:, k]) for k in range(14))],
                ["g", *(f"m{i}" for i in range(4)), *(f"p{i}{j}" for i, j in _PAIRS)])

    return sums.mapInArrow(invert, f"g string, {_SHAPE}")


def _sums(weight: Column | None = None) -> list[Column]:
    keep = (lambda c: c) if weight is None else (lambda c: F.when(weight, c))
    x = [F.col(c) for c in DIMENSIONS]
    return [F.count(keep(F.lit(1))).alias("n"), *(F.coalesce(F.sum(keep(x[i])), F.lit(0.0)).alias(f"s{i}") for i in range(4)),
            *(F.coalesce(F.sum(keep(x[i] * x[j])), F.lit(0.0)).alias(f"s{i}{j}") for i, j in _PAIRS)]


def _distance() -> Column:
    d = [F.col(c) - F.col(f"m{i}") for i, c in enumerate(DIMENSIONS)]
    return sum(((1 if i == j else 2) * d[i] * d[j] * F.col(f"p{i}{j}") for i, j in _PAIRS), F.lit(0.0))


def fit_mcd(rows: DataFrame, half: float = HALF, steps: int = 6) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group ``g``: (g, m0..m3, p00..p33).

    Starts from medians and median deviations; each concentration step keeps the
    ``half`` of a group's rows nearest to the current center and estimates anew, until
    no group moves.  A step is two aggregates over all rows of narrow columns,
    combined per task, so a group of any size is only ever summed; the estimates
    stay a table, one row per group.
    """
    middle = rows.groupBy("g").agg(*[F.percentile_approx(c, 0.5, 2000).alias(f"c{i}") for i, c in enumerate(DIMENSIONS)])
    spread = rows.join(middle, "g").groupBy("g").agg(
        *[F.max(f"c{i}").alias(f"m{i}") for i in range(4)],
        *[F.percentile_approx(F.abs(F.col(c) - F.col(f"c{i}")), 0.5, 2000).alias(f"d{i}") for i, c in enumerate(DIMENSIONS)])
    shape = stored(spread.select(
        "g", *[f"m{i}" for i in range(4)],
        *[(F.lit(0.0) if i != j else 1 / (F.pow(1.4826 * F.col(f"d{i}"), 2) + LEAST_SPREAD[i] ** 2)).alias(f"p{i}{j}")
          for i, j in _PAIRS]), "mcd-start")
    cut = chi2_quantile(half, 4)
    factor = half / chi2_cdf(cut, 6)
    for _ in range(steps):
        near = rows.join(shape, "g").withColumn("d2", _distance())
        limits = near.groupBy("g").agg(F.percentile_approx("d2", half, 2000).alias("limit"))
        sums = near.join(limits, "g").groupBy("g").agg(*_sums(F.col("d2") <= F.col("limit")))
        after = stored(_shapes(sums, factor), "mcd-step")
        moved = after.alias("a").join(shape.alias("b"), "g").agg(F.max(sum(
            (F.abs(F.col(f"a.m{i}") - F.col(f"b.m{i}")) / LEAST_SPREAD[i] for i in range(4)), F.lit(0.0)))).first()[0]
        shape = after
        if not moved or moved < 1e-3:
            break
    return shape


def _group_keys() -> tuple[Column, Column]:
    """Null languages and sources are groups of their own."""
    lang = F.coalesce(F.concat(F.lit("l:"), F.col("lang").cast("string")), F.lit("l"))
    source = F.coalesce(F.concat(F.lit("|s:"), F.col("source").cast("string")), F.lit("|s"))
    return lang, F.concat(lang, source)


def fit_rules(stats: DataFrame, half: float = HALF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The estimate each language and source is judged by: (_s, m0..m3, p00..p33).

    Rows that fail the base rule do not count.  Groups of less than ``least_rows``
    are judged by their whole language, small languages by all rows.
    """
    lang, source = _group_keys()
    used = stats.filter(~F.col("base_failed")).select(*vectors(), lang.alias("_l"), source.alias("_s"))
    sizes = used.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.groupBy("_l").agg(F.sum("n").alias("n_l"))
    group = F.when(F.col("n") >= least_rows, F.col("_s")).when(F.col("n_l") >= least_rows, F.col("_l")).otherwise("all")
    named = stored(sizes.join(langs, "_l").select("_s", group.alias("g")), "mcd-groups")
    wide = used.select(F.explode(F.array_distinct(F.array("_s", "_l", F.lit("all")))).alias("g"), *DIMENSIONS)
    rows = stored(wide.join(named.select("g").distinct(), "g", "left_semi"), "mcd-rows")
    return stored(named.join(fit_mcd(rows, half), "g").drop("g"), "mcd-rules")


def apply_rules(stats: DataFrame, rules: DataFrame, tail: float = TAIL) -> DataFrame:
    """``stats`` (any further columns) with d2, the squared robust distance, and kept.

    A row that fails the base rule has no distance and is not kept.  Columns that
    have the names of the new ones, or of the estimates, are left out.
    """
    stats = without(stats, ["d2", "kept", "_s", *DIMENSIONS, *rules.columns])
    columns = [F.col(c) for c in stats.columns]
    far = chi2_quantile(1 - tail, 4)
    return (
        stats.withColumn("_s", _group_keys()[1]).join(rules, "_s", "left").select("*", *vectors())
        .select(*columns, F.when(~F.col("base_failed"), _distance()).alias("d2"))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= far))
    )


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """(doc_id, lang, source, the statistics, base_failed, d2, kept): the verdict on each document.

    The narrow statistics are written once and every later pass reads those.
    Repeated rows are judged each; an empty table gives no rows.
    """
    stats = stored(with_stats(docs.select("doc_id", "text", "lang", "source")).drop("text"), "word-stats")
    return apply_rules(stats, fit_rules(stats), tail)


@query("op1_robust_outliers")
def robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"), *STATS, "base_failed", "kept", F.col("d2").alias("distance2"))
