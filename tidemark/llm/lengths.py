"""Token counts: the exact length histogram and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import stored, table, text_batches
from tidemark.llm.registry import query
from tidemark.llm.tokens import encoder

# Distinct lengths summed by one task before the blocks' sums are added up.
LENGTHS_A_BLOCK = 4096


def encoded_lengths(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", spaced: bool = True, end_ids: int = 1
) -> DataFrame:
    """One row (n_tokens) per document: ids of the whole text and ``end_ids`` end marks.

    A null or empty text has the end marks only.  Repeated rows count each.
    """
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer, spaced)
        for batch in text_batches(batches):
            found = ids.batch(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x) // 4 + end_ids for x in found], pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Documents per length: (n_tokens, n_docs).  Summed per task before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = LENGTHS_A_BLOCK) -> DataFrame:
    """The histogram with, for each length L that occurs, taken as a context limit:

    n_longer / tokens_longer: documents longer than L and their ids; n_up_to /
    tokens_up_to: the others; truncated_total: ids left when every document is cut
    to L; share_up_to: L is the quantile of this share.

    Lengths are summed in blocks of neighbouring lengths, then over the blocks, so
    no task sees more than ``block`` lengths or one row per block.  An empty input
    gives no rows.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_behind"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_behind"),
        F.sum("d").over(every).alias("n_all"), F.sum("t").over(every).alias("tokens_all"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        rows.withColumn("d", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
        .withColumn("t", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(blocks, "block")
        .select(
            "n_tokens", "n_docs",
            (F.col("d") + F.col("docs_behind")).alias("n_longer"),
            (F.col("t") + F.col("tokens_behind")).alias("tokens_longer"), "n_all", "tokens_all")
        .select(
            "n_tokens", "n_docs", "n_longer", "tokens_longer",
            (F.col("n_all") - F.col("n_longer")).alias("n_up_to"),
            (F.col("tokens_all") - F.col("tokens_longer")).alias("tokens_up_to"),
            (F.col("tokens_all") - F.col("tokens_longer") + F.col("n_longer") * F.col("n_tokens"))
            .alias("truncated_total"),
            ((F.col("n_all") - F.col("n_longer")) / F.col("n_all")).alias("share_up_to"))
    )


def answer_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_whole, n_cut, truncated_total) for any limits, also lengths that do not occur.

    Between two lengths that occur the total is linear, so the last length at or
    below a limit answers it.  ``limits`` are the caller's few numbers.
    """
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in dict.fromkeys(limits)], "context_limit long")
    each = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    found = sums.withColumn("context_limit", each).groupBy("context_limit").agg(
        F.sum("n_docs").alias("n_all"),
        F.max(F.when(
            F.col("n_tokens") <= F.col("context_limit"),
            F.struct("n_tokens", "n_longer", "n_up_to", "tokens_up_to"))).alias("x"))
    cut = F.coalesce("x.n_longer", "n_all", F.lit(0))
    return asked.join(found, "context_limit", "left").select(
        "context_limit", F.coalesce("x.n_up_to", F.lit(0)).alias("n_whole"), cut.alias("n_cut"),
        (F.coalesce("x.tokens_up_to", F.lit(0)) + cut * F.col("context_limit")).alias("truncated_total"))


@query("op3_length_histogram")
def length_histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram and suffix sums of all documents.  The histogram is stored: both sums read it, the texts are encoded once."""
    return suffix_sums(stored(length_histogram(encoded_lengths(table(spark, sf_dir, "documents"))), "lengths"))
