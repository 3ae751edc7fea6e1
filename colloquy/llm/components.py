"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a long, b long)``; root is the least
    node of its component.  Nulls are ignored; a node linked only to itself is
    its own root.

    Alternates large-star and small-star steps: each keeps at most as many links
    as before and a node's links are never gathered (only their minimum), so a
    node with very many links is no hot group.  The table is cut after each round
    and the rounds end only when it no longer changes (after about log n of them, as
    the distance to a root shrinks by a constant factor each time).
    """
    links = links.where("a is not null and b is not null").select("a", "b")
    now = cut(links.distinct())
    sign, new = None, ()
    while new != sign:
        sign = new
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.unionByName(now.where("a = b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = cut(small.distinct())
        new = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    return now.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")).unionByName(
        now.where("a <> b").select("b").distinct().join(now.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
