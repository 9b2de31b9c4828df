"""Connected groups of positions under a distance threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.functions.settle import settle


def components(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None, rounds: int = 100) -> DataFrame:
    """(by..., node, component) of ``nodes(by..., node)`` and ``edges(by..., a, b)``: the smallest node reachable.

    Every round takes the smallest label around and then the label of that label, so that chains
    shrink by halves.
    """
    by = by or []
    both = edges.select(*by, "a", "b").union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = settle(both)
    labels = nodes.select(*by, "node", F.col("node").alias("component")).distinct()
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(around, [*by, "node"], "left").select(*by, "node", "component", F.least("component", "near").alias("low"))
        jump = hooked.select(*by, F.col("node").alias("low"), F.col("low").alias("further"))
        moved = settle(hooked.join(jump, [*by, "low"], "left").select(*by, "node", "component", F.least("low", "further").alias("new")))
        changed = moved.where("component <> new").limit(1).count()
        labels = moved.select(*by, "node", F.col("new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def largest_component(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., largest, total): size of the largest component, and number of nodes."""
    by = by or []
    sizes = components(nodes, edges, by).groupBy(*by, "component").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(F.max("n").alias("largest"), F.sum("n").alias("total"))


def contact_edges(distances: DataFrame, limit: float) -> DataFrame:
    return distances.where((F.col("d") < limit) & (F.col("i") <= F.col("j"))).select(F.col("i").alias("a"), F.col("j").alias("b"))


def connectivity(modes: DataFrame, k: int, distances: DataFrame, limits: list[float] | None = None, contact: float = 5.0) -> DataFrame:
    """(eps, largest, total): of the positions that mode k leads with a value above eps, those in the largest contact component; 0 for an empty group."""
    limits = limits or [round(0.5 - 0.01 * x, 2) for x in range(50)]
    others = modes.where(F.col("k") != k).groupBy("pos").agg(F.max("v").alias("other"))
    lead = modes.where(F.col("k") == k).join(others, "pos", "left").where((F.col("v") > F.coalesce(F.greatest("other", F.lit(0.0)), F.lit(0.0))) & (F.col("v") > min(limits)))
    spark = modes.sparkSession
    eps = spark.createDataFrame([(float(x),) for x in limits], "eps double")
    nodes = lead.select("pos", "v").crossJoin(F.broadcast(eps)).where("v > eps").select("eps", F.col("pos").alias("node"))
    edges = contact_edges(distances, contact)
    inside = edges.join(nodes.select("eps", F.col("node").alias("a")), "a").join(nodes.select("eps", F.col("node").alias("b")), ["eps", "b"]).select("eps", "a", "b")
    found = largest_component(nodes, inside, ["eps"])
    return eps.join(found, "eps", "left").select("eps", F.coalesce("largest", F.lit(0)).alias("largest"), F.coalesce("total", F.lit(0)).alias("total"))


def connected_groups(groups: DataFrame, distances: DataFrame, contact: float) -> DataFrame:
    """(k, connected): whether the positions of each of ``groups(k, node)`` are one component."""
    edges = contact_edges(distances, contact)
    inside = edges.join(groups.select("k", F.col("node").alias("a")), "a").join(groups.select("k", F.col("node").alias("b")), ["k", "b"]).select("k", "a", "b")
    return largest_component(groups.select("k", "node"), inside, ["k"]).select("k", (F.col("largest") == F.col("total")).alias("connected"))


def is_connected(nodes: DataFrame, distances: DataFrame, contact: float) -> bool:
    """Whether a group of positions (node) is one component."""
    own = nodes.select(F.col("node").alias("a"))
    edges = contact_edges(distances, contact).join(own, "a").join(own.withColumnRenamed("a", "b"), "b")
    row = largest_component(nodes, edges).first()
    return row is None or row["largest"] == row["total"]
