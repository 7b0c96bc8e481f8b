"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colwright.storage import cut_lineage


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root): for every node of (a, b) the smallest node reachable over links, itself included.

    Rounds of large-star and small-star: every node points its larger neighbours, then itself and its smaller neighbours, at
    the least node it sees. Both are an aggregation and a join on the links, and the number of rounds grows with the logarithm
    of the largest component. Rounds end when the links no longer change. Each round is written, so a lost executor repeats
    one round only.
    """
    both = links.select("a", "b").filter("a != b")
    edges = cut_lineage(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    state = _state(edges)
    while state[0]:
        # large star: of each node's neighbours the larger ones point at the least of all
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that a node with very many links is split over tasks in the join
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.filter("v > u").join(cut_lineage(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star: a node and its smaller neighbours point at the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.filter("u != v").distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """A set of links has changed if its count or its digest has."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
