"""Connected components of a link table, as rounds of joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdspark.session import cut_lineage


def _both(links: DataFrame) -> DataFrame:
    return links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its least neighbour or itself."""
    both = _both(links)
    near = both.join(_least(both), "u").select("u", "v", F.least("u", "least").alias("m"))
    return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node and the node itself are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = down.join(_least(down), "u")
    moved = near.filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    own = near.select("u", F.col("least").alias("v"))
    return moved.unionAll(own).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the least node of the component, for every node that has a link.

    Rounds go on until the link table no longer changes; they grow with the
    logarithm of the longest path. Aggregates combine before the shuffle, so a
    node with very many links is no burden for one task.
    """
    now = cut_lineage(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(mark) == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        now = cut_lineage(_small_star(_large_star(now)))
