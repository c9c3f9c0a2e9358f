"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component``: the smallest id reachable, for every id that an edge names.

    In each round every vertex points to its smallest neighbour or itself, pointers are followed to
    their roots by doubling, and the graph shrinks to its roots; vertices at least halve where edges
    remain. Only aggregates and equi-joins are used, so a vertex with very many edges is combined before
    it is shuffled. Self-loops keep a vertex in the result; edges with a null end are left out.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "cc-edges")
    found: DataFrame | None = None
    while True:
        roots = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        roots = materialize(roots, "cc-roots")
        while True:
            up = roots.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = materialize(roots.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "cc-roots")
            discard(roots)
            roots = jumped.select("a", "p")
            if not jumped.where("moved").limit(1).count():
                break
        left = both.join(roots.select("a", F.col("p").alias("pa")), "a")
        left = left.join(roots.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        shrunk = materialize(left.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "cc-edges")
        discard(both)
        both = shrunk
        if found is None:
            found = roots
        else:
            # Only roots of earlier rounds that still have edges move on.
            moves = roots.select(F.col("a").alias("p"), F.col("p").alias("q"))
            moved = materialize(found.join(moves, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "cc-found")
            discard(found)
            discard(roots)
            found = moved
        if not both.limit(1).count():
            return found.select(F.col("a").alias("id"), F.col("p").alias("component"))
