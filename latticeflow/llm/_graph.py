"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import drop_table, materialize


def _star(spark: SparkSession, edges: DataFrame, large: bool) -> DataFrame:
    """One round.  ``edges``: distinct (u, v) with u > v, both long."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = materialize(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    # a hub's rows can be split by adaptive execution: both inputs are plain exchanges
    joined = both.join(low.hint("merge"), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node on an edge; root is the component's smallest node.

    ``edges`` has long columns u, v in any order.  Each round is written to the shared folder; rounds
    grow with the logarithm of the longest chain.
    """
    e = materialize(spark, edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        big = materialize(spark, _star(spark, e, large=True), "cc")
        nxt = materialize(spark, _star(spark, big, large=False), "cc")
        drop_table(spark, e)
        drop_table(spark, big)
        e = nxt
        # a fixed point is a set of stars: no node is both a child and a root
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
