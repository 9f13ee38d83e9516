"""Connected components by alternating large-star and small-star steps, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import Scratch


def connected(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for each node of edges (a, b) that isn't its component's smallest node.

    The result reads a table of scratch. Every step works on aggregates that combine before the shuffle, so nodes with very many edges do no harm.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now, mark = _marked(scratch, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, seen = _marked(scratch, small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if seen == mark:
            break
        now, mark = after, seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _marked(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = scratch.cut(edges)
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("b", "a")), F.lit(0))).first()
    return edges, tuple(row)
