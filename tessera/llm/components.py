"""Connected components of a link table by alternating star contraction.

Every round replaces links by links to smaller neighbours (first to the
smallest of the larger ones, then of the smaller ones), until every node hangs
directly on the smallest node of its component. All of it is joins and partial
aggregates; links never leave the cluster. A hub is reduced by map-side
minima, and the join back to its many links can be split by AQE.

The first aggregate of a round, a row per node, also tells whether anything is left to
do, and is the result if not: no round is made only to see that nothing moves. What the
driver holds grows with stages and their partitions, not with links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import store


def _nodes(links: DataFrame) -> DataFrame:
    """``a, m, low, high`` of every node of distinct ``a > b`` links: the smallest of itself and its
    neighbours, the number of smaller ones, and whether there are larger ones."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"), F.count_if(F.col("b") < F.col("a")).alias("low"), F.max(F.col("b") > F.col("a")).alias("high"))


def _round(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """One large-star and one small-star step over ``a > b`` links."""
    large = links.join(nodes.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return large.join(low, "a").select(moved).where("a > b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in a link
    of ``links(a, b)``. Self-links and nulls say nothing; repeats change nothing."""
    now = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        nodes = store(_nodes(now), "nodes")
        if nodes.where("low > 1 OR (low = 1 AND high)").isEmpty():  # every node is a smallest one or hangs on one only
            return nodes.select(F.col("a").alias("node"), F.col("m").alias("component"))
        now = store(_round(now, nodes), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
