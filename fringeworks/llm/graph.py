"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, drop_scratch, materialize


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def relabelled(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``column`` replaced by its label where it has one.  Both sides grow with the
    data, so neither is broadcast."""
    to = labels.select(F.col("node").alias(column), F.col("label").alias("_label")).hint("merge")
    return df.join(to, column, "left").withColumn(column, F.coalesce("_label", column)).drop("_label")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of an edge, a stored table; label is the smallest
    node reachable.

    ``edges`` has columns a and b.  Each round hooks every node to its smallest
    smaller neighbour, follows these links to their ends, and replaces edges by
    the edges between ends, so a chain shrinks by a factor each round.  A node
    with very many neighbours is pre-aggregated before its rows are shuffled.
    """
    live, n = counted(_ends(edges), "cc-edges")
    spent, rounds = [live], []
    nodes = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct()
    while n:
        up, rising = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), 1
        while rising:
            above = up.select(F.col("node").alias("label"), F.col("label").alias("above")).hint("merge")
            jumped, rising = counted(up.join(above, "label", "left").select("node", "label", "above"), "cc-jump", F.col("above").isNotNull())
            spent.append(jumped)
            up = jumped.select("node", F.coalesce("above", "label").alias("label"))
        rounds.append(up)
        live, n = counted(_ends(relabelled(relabelled(live, "a", up), "b", up)), "cc-edges")
        spent.append(live)
    labels = nodes.withColumn("label", F.col("node"))
    for up in rounds:
        labels = relabelled(labels, "label", up)
    labels = materialize(labels.select("node", "label"), "cc-labels")
    drop_scratch(*spent)
    return labels
