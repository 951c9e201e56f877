"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Joins each node's larger (large) or smaller-or-equal neighbours to the least node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = both if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written before the join, so that the neighbours of a hub can be split among tasks
    least = written(ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    joined = ways.join(least, "a")
    if large:
        new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs in any order, repeats and loops allowed, to (node, component): the least node that each can reach.

    Nodes without an edge to another are left out; the result is empty for no edges.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sums = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))]
    before = now.agg(*sums).first()
    while before[0]:
        now = written(_stars(_stars(now, True), False), "edges")
        after = now.agg(*sums).first()
        if after == before:
            break
        before = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
