"""Connected components by contraction, all of it in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.llm.shared import dropped, kept


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a`` and ``b``); ``root`` is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, doubles the hooks until they end at a
    root (a chain of n nodes takes log n steps) and contracts the edges to what still joins
    different roots. Null ends, loops and repeated edges are left out; a node that has only those
    is not returned.
    """
    live = kept(_distinct(edges.select("a", "b")), "edges")
    labels = None
    while not live.isEmpty():
        hook = _flat(_smallest_neighbours(live))
        if labels is None:
            labels = hook
        else:
            nodes = kept(_renamed(labels, "root", hook), "labels")
            dropped(labels)
            labels = nodes
        contracted = kept(_distinct(_renamed(_renamed(live, "a", hook), "b", hook)), "edges")
        dropped(live)
        live = contracted
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _smallest_neighbours(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "hooks")


def _flat(hook: DataFrame) -> DataFrame:
    """``hook`` followed to its ends, twice as far in every step."""
    while True:
        further = kept(_renamed(hook.withColumn("was", F.col("root")), "root", hook), "hooks")
        dropped(hook)
        hook = further.drop("was")
        if further.filter("root != was").isEmpty():
            return hook


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _renamed(df: DataFrame, column: str, hook: DataFrame) -> DataFrame:
    """``df`` with the values of ``column`` replaced by what they are hooked to."""
    to = hook.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(to, df[column] == F.col("_node"), "left").withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")
