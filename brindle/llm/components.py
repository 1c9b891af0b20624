"""Connected components of a table of links, by alternating large and small stars.

A star replaces a node's links by links to its smallest neighbour. Both steps are
an aggregation and a join, so a node with very many links is no group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
    larger = links.select(F.col("a").alias("u"), F.col("b").alias("v"))  # links have a < b
    return larger.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are linked to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    joined = links.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("v"))
    return joined.where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every linked node; the label is the smallest node it reaches.

    ``links`` has columns a and b in any order; nulls and self links are dropped.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = links.where("a is not null and b is not null and a <> b").select(low.alias("a"), high.alias("b")).distinct()
    now, before = materialize(now, "links"), None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = materialize(_small_star(_large_star(now)), "links")
    else:
        raise RuntimeError("the links did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(
        now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    )
