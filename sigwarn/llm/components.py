"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwarn.llm.store import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of links(a, b), as a table; the component is its smallest node.

    Every round is two joins on aggregated minima, so that a node with very many links stays spread over tasks, and
    is written to the shared folder. Ends when a round changes nothing; links to itself and repeats are ignored.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("n"), F.least("v", "m").alias("m"))
        # large star: larger neighbours of a node go to the node's smallest neighbour
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select("v", F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.where("v > u")
        low = down.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("n"), "m")
        small = down.join(low, F.col("v") == F.col("n")).select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select(F.col("n").alias("v"), F.col("m").alias("u")))
        fresh = materialize(small.where("v > u").distinct())
        seen = fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = fresh
        if seen == mark:
            break
        mark = seen
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    out = materialize(edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots))
    discard(edges)
    return out
