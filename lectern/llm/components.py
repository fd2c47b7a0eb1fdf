"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.runtime import cut

STEPS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long); root is the component's least node.

    Each step links neighbours to the least node near them, by a join with an aggregated
    minimum, so no neighbourhood is ever gathered. It ends when a step changes nothing,
    after a number of steps that grows with the logarithm of the longest chain. Loops are
    left out; repeated edges count once; an empty table gives an empty result.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = _mark(now)
    for _ in range(STEPS):
        now = cut(_star(_star(now, large=True), large=False))
        was, mark = mark, _mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    # Under another expression the minima get an exchange of their own, and Spark can split a node of many edges.
    named = least.select(F.col("a").bitwiseXOR(F.lit(0)).alias("node"), "m")
    joined = both.join(named, F.col("a") == F.col("node")).drop("node")
    if large:  # neighbours above a hang on a's least neighbour
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # neighbours below a, and a itself, hang on the least of them
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
