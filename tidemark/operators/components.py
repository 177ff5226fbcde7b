"""Connected components of a graph given as edges, by alternating stars, with checkpoints between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b, of any orderable type) that has another neighbour than itself;
    component is the least node.

    Each round hangs the larger neighbours of a node on its least neighbour, then the smaller ones; edges never grow
    in number beyond the first round, a node with very many edges is reduced by a partial minimum, and the join back can
    be split. Rounds grow with the logarithm of the longest path.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # a > b from here on
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = state(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = materialize(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .union(low.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, state(after)
        now = after
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
