"""Connected components of an edge table, by alternating large and small stars.

Each round links every node to the smallest node it knows of, first outwards, then inwards, until
the edges form one star per component. Rounds grow with the logarithm of the longest chain. Nothing but the
answer whether that is so reaches the driver; a round is written to the shared folder, so a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise

MAX_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b in, edges from nodes to the smallest node of a neighbourhood out."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    met = around.join(least, "a")
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a > b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two centres, and no centre has a centre of its own."""
    if not edges.groupBy("a").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    ``edges`` has columns ``a`` and ``b`` of one ordered type. Edges in either direction, repeated
    edges and loops are allowed; NULL ends are ignored; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise(edges.filter("a > b").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        edges = materialise(_star(_star(edges, large=True), large=False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
