"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node that each linked node reaches.

    Each round takes the least label of a node and its neighbours, then the label of that label,
    and is written to the shared folder; rounds grow with the logarithm of a component's diameter.
    """
    one, other = links.select(F.col("a").alias("u"), F.col("b").alias("v")), links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    own = links.select(F.explode(F.array("a", "b")).alias("u")).select("u", F.col("u").alias("v"))
    edges = cut(one.unionByName(other).unionByName(own).distinct(), "edges")
    labels = cut(edges.groupBy("u").agg(F.min("v").alias("label")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("u").alias("v"), "label"), "v")
        least = seen.groupBy("u").agg(F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("old"), F.min("label").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        new = cut(least.join(jump, "label").select("u", "old", F.col("next").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("u", "label")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))


def join_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of `known` with further links (a, b), as a table.

    Only the graph of components is solved anew: its edges are the links between different ones.
    A node that `known` lacks is its own component.
    """
    for end in ("a", "b"):
        at = known.select(F.col("node").alias(end), "component")
        links = links.join(at, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    above = connected_components(cut(links.where("a <> b").distinct(), "component-links"))
    over = above.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = known.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return cut(moved.unionByName(above.join(known.select("node"), "node", "left_anti")), "labels")
