"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay in Spark tables; every round is written to the shared folder, so a
lost executor costs at most one round.  A hub of any degree is one aggregated
minimum; its neighbours are joined back, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked to the smallest node of its neighbourhood instead."""
    around = _both_ways(links) if large else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    lowest = around.groupBy("a").agg(F.min("b").alias("low"))
    moved = around.join(lowest, "a")
    low = F.least("low", "a")
    if large:
        return moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), low.alias("b")).distinct()
    return moved.select(F.col("b").alias("a"), low.alias("b")).union(
        moved.select("a", low.alias("b"))
    ).where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node of the component, for every node of a link ``a, b``."""
    now = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # Done when every node hangs on one node that hangs on nothing.
        several = now.groupBy("a").count().where("count > 1").select("a")
        hanging = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if several.unionByName(hanging).isEmpty():
            break
        larger = written(_star(now, True))
        nxt = written(_star(larger, False))
        dropped(larger)
        dropped(now)
        now = nxt
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
