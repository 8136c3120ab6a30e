"""Connected components of a link table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.scratch import discard, settle


def _small_star(edges: DataFrame) -> DataFrame:
    """(v, m) with v > m: v and its smaller neighbours attach to the least of them."""
    low = edges.groupBy("v").agg(F.min("m").alias("least"))
    return (
        edges.join(low, "v")
        .select(F.col("m").alias("v"), F.col("least").alias("m"))
        .unionByName(low.select("v", F.col("least").alias("m")))
        .where("v <> m")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above u attach to the least of u's neighbourhood, u itself included."""
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("w")).alias("least"))
    return both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("least").alias("m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between longs -> (node, root): every node that has a link, with the smallest node it reaches.

    Each round writes its edges to the shared folder. A round never makes more edges than it had, and a hub's
    edges are reduced to a minimum by partial aggregation before they are joined back. A small star comes first: links
    of one node to several centres become links between the centres.
    Null ends and self-links are ignored; repeated links count once; no links give no rows.
    """
    ends = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
    edges = settle(_small_star(settle(ends.distinct(), "links")), "edges")
    before = None
    while True:
        after = settle(_small_star(_large_star(edges)), "edges")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)")).alias("h")).first()
        discard(edges)
        edges = after
        if state == before:
            break
        before = state
    roots = edges.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(roots)
