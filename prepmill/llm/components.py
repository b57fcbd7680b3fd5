"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); the label is the component's smallest node.

    Each round points every node at its smallest neighbour, follows the pointers to their
    ends by doubling, and contracts the links to the ends.  A star of any size is one
    node after two rounds; a component needs about log(its diameter) rounds.
    """
    small, large = F.least("a", "b"), F.greatest("a", "b")
    edges = materialise(links.filter("a <> b").select(small.alias("a"), large.alias("b")).distinct(), "links", True)
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        up = materialise(
            both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "up", True
        )
        while True:
            over = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
            jumped = materialise(up.join(over, "to").select("node", F.col("further").alias("to"), F.col("to").alias("was")), "up", True)
            done = jumped.filter("to <> was").isEmpty()
            up = jumped.select("node", "to")
            if done:
                break
        if labels is None:
            labels = up.select("node", F.col("to").alias("label"))
        else:
            moved = up.select(F.col("node").alias("label"), F.col("to").alias("moved"))
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label"))
        labels = materialise(labels, "labels", True)
        a, b = (up.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b"))
        edges = materialise(
            edges.join(a, "a").join(b, "b").filter("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links", True
        )
    if labels is None:
        kind = links.schema["a"].dataType.simpleString()
        labels = links.sparkSession.createDataFrame([], f"node {kind}, label {kind}")
    return labels


def extend(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links (a, b): only what these contract to is looked at."""
    ends = links.select("a", "b")
    for c in ("a", "b"):
        known = labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}2"))
        ends = ends.join(known, c, "left").withColumn(f"{c}2", F.coalesce(f"{c}2", c))
    new = materialise(ends.select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct(), "new", True)
    if new.isEmpty():
        return labels
    merged = components(new)
    moved = merged.select(F.col("node").alias("label"), F.col("label").alias("moved"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label"))
    fresh = merged.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return materialise(old.union(fresh), "labels", True)
