"""Connected components of an edge table by hooking and pointer jumping.

Edges point from the larger end ``u`` to the smaller ``v``; the parent of ``u`` is its smallest ``v``. A round
joins every edge with the parents of both ends: an edge to the parent moves on to the parent's parent,
any other becomes an edge between the parent of ``u`` and the parent of ``v``. All ends stay connected, no round
makes more edges than it got, and it takes three shuffles: the parents (grouped minima, combined on the map
side) and the edges once by either end, in joins that adaptive execution may split for a node with very many
neighbours. Whether anything moved is observed while the round is written. This is the combined form of the
large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from covarium.llm.shared import cut


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to distinct ``(u, v)`` with v the smallest id reachable, for every u but those smallest ids."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    for _ in range(rounds):
        parent = now.groupBy("u").agg(F.min("v").alias("p"))
        above = parent.select(F.col("u").alias("v"), F.col("p").alias("q"))
        end = F.coalesce("q", "v")
        tree = F.col("v") == F.col("p")
        moved = F.sum((~tree | F.col("q").isNotNull()).cast("int")).alias("moved")
        seen = Observation()
        step = now.join(parent, "u").join(above, "v", "left").observe(seen, moved)
        step = step.select(F.when(tree, F.col("u")).otherwise(F.greatest("p", end)).alias("u"), F.when(tree, end).otherwise(F.least("p", end)).alias("v"))
        now = cut(step.where("u <> v"))
        if not seen.get["moved"]:
            return now.distinct()
    raise RuntimeError(f"the links did not settle in {rounds} rounds")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(id, component)``: the smallest id reachable, for every id on an edge to another one.

    Self-links and repeated links are allowed; without links the result is empty. The number of
    rounds grows with the logarithm of the longest chain; more than ``rounds`` raises.
    """
    found = stars(edges, rounds)
    roots = found.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return found.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
