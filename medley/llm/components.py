"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medley.session import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.union(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("low"))
    return (
        both.filter("other > node")
        .join(least, "node")
        .select(F.col("other").alias("high"), "low")
        .filter("high <> low")
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.filter("high <> low").union(least.select("high", F.col("least").alias("low")))


def connected(links: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the smallest node it reaches.

    Alternates large-star and small-star steps, which keep all links in tables:
    each step is one minimum per node, combined before the shuffle, and one join,
    whose hot nodes adaptive execution splits.  The links are written to the
    shared folder after each round, so lineage stays short and a lost executor
    costs one round at most.  Links with a NULL end and loops are ignored.
    """
    current = cut(
        links.select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("high") > F.col("low")))
        .distinct()
    )
    mark = None
    while True:
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return current.select(F.col("high").alias("node"), F.col("low").alias("root"))
        mark = now
        current = cut(_small_star(_large_star(current).distinct()).distinct())
