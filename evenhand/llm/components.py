"""Connected components of a table of links, by large-star and small-star rounds.

Every round writes its links to the shared folder, so lineage stays short and a lost
executor costs one round at most. Nothing but two sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenhand.session import reliable_checkpoint


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. ``a`` is above ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of all nodes in links (a, b), root being the smallest node that can be reached.

    Repeated links, links in both directions and links of a node with itself are
    allowed; nodes in no link with another node have no row, so an empty table gives
    an empty table. Fails if ``most_rounds`` do not suffice, which needs chains of
    more than 2 ** 50 nodes.
    """
    up = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = reliable_checkpoint(up.distinct(), "links")
    before = None
    for _ in range(most_rounds):
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        current = reliable_checkpoint(small_star(large_star(current)), "links")
    raise RuntimeError("components did not settle")
