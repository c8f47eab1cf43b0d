"""Connected components of a table of links, in the shared folder round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterroll.runtime import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; root is the smallest node reachable.

    Large-star and small-star in turns: every node links its larger
    neighbours, then its smaller ones, to the smallest node it knows, until a
    round changes nothing.  That takes about as many rounds as the logarithm
    of the longest path.  Smallest neighbours come from an aggregate, so no
    node's neighbours are gathered in one task; a node with many of them is a
    large key of a join between two written tables, which adaptive execution
    splits.
    """
    edges = written(_canonical(links), "links")
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "links")
        # Each edge leads to a smaller node; the sums settle only at stars.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def _canonical(links: DataFrame) -> DataFrame:
    """Distinct links, each from its larger node ``a`` to its smaller one ``b``."""
    pairs = links.filter(F.col("a") != F.col("b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every node's larger neighbours to the smallest node next to it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    # Larger neighbours of a node are the edges that lead down to it.
    down = edges.select(F.col("a").alias("larger"), F.col("b").alias("at"))
    return _canonical(down.join(least, F.col("at") == F.col("a")).select(F.col("larger").alias("a"), F.col("least").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    joined = edges.join(least, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return _canonical(moved.unionByName(own))
