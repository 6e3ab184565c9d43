"""Connected components of a graph given as links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.llm.words import join_counted
from swayrank.session import freeze

MAX_ROUNDS = 60


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    moved = join_counted(both.filter("b > a"), least, "a", 2 * total)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_counted(links, least, "a", total).filter("b <> m")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    """Tells whether a round changed anything; one row whatever the size."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """One row (node, root) for each node of `links` (a, b longs) that is not itself the smallest of its component.

    The number of rounds grows with the logarithm of the longest path. Each round's links are written
    to the shared folder, so a lost executor repeats one round at most. Nodes with very many links are met by broadcast,
    so no task gets a whole star. Self-links and repeated links
    are ignored; no links give no rows.
    """
    current = freeze(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    before = _state(current)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        current = freeze(_small_star(_large_star(current, before[0]).distinct(), before[0]).distinct())
        now = _state(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
