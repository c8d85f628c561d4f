"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import settled

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (u, v) with v < u.

    Large: of each node's neighbours, the larger ones link to its smallest neighbour
    or itself. Small: the node and its smaller neighbours link to the smallest. The
    minimum is a plain aggregate that is joined back, so a hub's neighbours are never
    gathered in a list and a hot join key can be split.
    """
    if large:
        near = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    else:
        near = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links(u, v)`; root is the smallest reachable node.

    Self links are ignored: a node that has no other link is not in the result. The
    rounds end when the edges no longer change, which a checksum of them shows.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, before = settled(edges), None
    for _ in range(MAX_ROUNDS):
        edges = settled(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")
