"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum and an equi-join, so a node that holds most edges is
combined map-side and its join partition can be split.  Each round is written to the
shared folder: lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.session import materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the smallest neighbour of u, u itself included."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
    return edges.join(least, edges.u == least.lu).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _with_least(large)
    down = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); root is the component's least node.

    Nulls, loops and repeated edges are ignored; an empty table gives an empty result.
    """
    usable = edges.where("a is not null and b is not null and a <> b")
    stars = materialise(usable.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        digest = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if digest == before or digest["n"] == 0:
            break
        before = digest
        stars = materialise(_round(stars), "stars")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
