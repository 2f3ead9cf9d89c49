"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import stored


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) and the least node it is linked to over any path.

    Alternates two rewrites until nothing changes: each node hands its larger
    neighbours, then its smaller ones, to the least of them.  Links only ever
    become stars, so a few rounds do; a neighbourhood is aggregated and joined,
    never gathered.  Raises if ``most_rounds`` do not finish.
    """
    edges = stored(_directed(links), "links")
    seen = _state(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stored(_star(both, F.col("v") > F.col("u"), False), "large-star")
        edges = stored(_star(edges, F.lit(True), True), "small-star")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not finished after {most_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _directed(links: DataFrame) -> DataFrame:
    """From the larger node u to the smaller node v."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _star(edges: DataFrame, passed, own: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = edges.join(least, "u").filter(passed).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if own:  # the node itself goes along with its smaller neighbours
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return _directed(moved)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
