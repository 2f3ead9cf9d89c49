"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import stored, table, text_batches
from tidemark.llm.decontaminate import contamination
from tidemark.llm.outliers import apply_rules, fit_rules, with_stats
from tidemark.llm.packing import pack, token_pieces
from tidemark.llm.similar import keyed, similarity_join
from tidemark.llm.suffixes import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outlier of their language and source."""
    docs = docs.select(*COLUMNS)
    stats = stored(with_stats(docs.select("text", "lang", "source")).drop("text"), "word-stats")
    return apply_rules(with_stats(docs), fit_rules(stats)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: the one with the least doc_id."""
    members = similarity_join(keyed(docs))[0]
    first = members.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("at")).select("at.doc_id", "at.h")
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("h")).alias("d")
    kept = rows.join(first.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")))
    return kept.select("d.*").dropDuplicates(["doc_id", "h"]).select(*COLUMNS)


def exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings that other places hold too.

    A character that a removed string cuts in two goes as a whole; a document of
    which nothing is left stays, with an empty text.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = [None if missing else kept.decode("utf-8", "ignore")
                     for kept, missing in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            n_chars = [None if t is None else len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), batch.column(1), batch.column(2), pa.array(n_chars, pa.int64())],
                COLUMNS)

    left = without_repeats(docs.select("doc_id", "text", "lang", "source"))
    return left.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "kept", F.isnull("text").alias("missing"),
    ).mapInArrow(decode, "doc_id long, text string, lang string, source string, n_chars long")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("ranges") == 0).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as pieces in sequences of 2048 ids."""
    return pack(token_pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("exact repeats", exact_repeats),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

# SQL does not know the tokenizer, nor the iterated estimates and links.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
