"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablespan.llm.common import drop, stored

#: Rounds before giving up; the steps need about the logarithm of the longest chain.
ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's greater neighbours link to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself link to the least of them. Links go downwards."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    low = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node that links, a and b, reach. Rows with a = b are dropped."""
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    print_of = None
    for _ in range(ROUNDS):
        last, links = links, stored(_small_star(_large_star(links)), "links")
        drop(last)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == print_of or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        print_of = now
    raise RuntimeError(f"components not found in {ROUNDS} rounds")
