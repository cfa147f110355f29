"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """``links`` has ``a`` and ``b`` (longs). Returns ``node, root``, the smallest node of its component, for every node that
    isn't its own root. Each round is stored; minima are combined before the shuffle and no neighbourhood is ever
    collected, so a node with very many links costs no more than its links."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    before = _state(links)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that adaptive execution can split a node with very many links in the join
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        # large star: every larger neighbour of a node gets a link to the least node around it
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "links")
        # small star: the smaller neighbours of a node, and the node, get a link to the least of them
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _state(links)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    if before[0]:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
