"""Connected components of a link table by alternating large-star and small-star steps.

Every step groups the links by node, takes the smallest neighbour (a partial
aggregate, so hubs are combined before the shuffle) and joins it back (the
adaptive skew join splits a hub's links). Each round's links are written to the
shared folder; nothing is collected but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtext.llm.common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (src, dst) that is not its component's smallest node.

    Links from a node to itself and repeated links do no harm; an empty table gives no rows.
    """
    edges = links.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    edges = materialise(edges, "links")
    before = None
    while True:
        # large star: larger neighbours of a node move to its smallest neighbour, or to itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
