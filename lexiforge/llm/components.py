"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_singles, released, scratch, written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation on edges (u, v).

    The least neighbour of each u is a table of its own; the join that brings it to
    all edges of u gathers no hub's edges in one task.
    """
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "star")
    joined = join_singles(both, least, ["u"], ["v"])
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(u, root) of every node of an edge (u, v); the root is the least node.

    Self-loops and repeated edges do no harm; no edges give no rows. Of a round's
    tables only its edges outlive it, and only until the next round.
    """
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", keep=True)
    before = None
    for _ in range(most_rounds):
        with scratch():
            following = written(_star(_star(edges, True), False), "edges", keep=True)
        released(edges)
        edges = following
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return edges.select("u", F.col("v").alias("root")).unionByName(roots)
