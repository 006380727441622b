"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import stage


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of the edges (a, b).

    Alternating large and small stars: every round ties each node's neighbours to the smallest of
    them, until nothing changes. A round is a minimum per node, which combines before its shuffle,
    and a join that adaptive execution can split at a hub; the rounds grow as the logarithm of the
    nodes. Null ends and loops are left out.
    """
    links = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = marked(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links, mark = marked(small.filter("a <> b").distinct())
        if mark == seen:
            break
        seen = mark
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))


def marked(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a staged table, and their number and a sum of hashes, taken as they are written."""
    seen = Observation()
    hashes = F.xxhash64("a", "b").cast("decimal(38,0)")
    kept = stage(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(hashes).alias("hashes")), "links")
    return kept, (seen.get["n"], seen.get["hashes"])
