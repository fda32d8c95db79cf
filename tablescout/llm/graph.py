"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import merged, settle


def relabelled(links: DataFrame, parents: DataFrame) -> DataFrame:
    """The links between different parents of their ends; an end without parent stays."""
    for end in ("u", "v"):
        named = parents.select(F.col("node").alias(end), F.col("parent").alias("_to"))
        links = (merged(links, named, [end], "left")
                 .withColumn(end, F.coalesce("_to", end)).drop("_to"))
    return links.where("u <> v").distinct()


def _climbed(parents: DataFrame) -> DataFrame:
    """Every node with its parent's parent."""
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
    return merged(parents, above, ["parent"], "left").select(
        "node", F.coalesce("_next", "parent").alias("parent"))


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """(node, parent): the parents of ``first``, moved on to their own in ``then``."""
    above = then.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
    return merged(first, above, ["parent"], "left").select(
        "node", F.coalesce("_next", "parent").alias("parent"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges (u, v)``; one root per component.

    Each round hooks every node to its smallest neighbour (a combinable minimum, so a
    hub costs no task more than others), climbs four hooks at once, and goes on with the
    links between different nodes reached. As hooks run along links, what they join stays
    joined, so paths need not be followed to their ends within a round: a round is three
    tables, whatever their length. No links, no rows.
    """
    edges = settle(edges.where("u <> v").distinct())
    total = None
    while not edges.isEmpty():
        both = edges.select("u", "v").unionByName(
            edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = settle(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_least"))
                       .select("node", F.least("node", "_least").alias("parent")))
        parents = settle(_climbed(_climbed(hooks)))
        total = parents if total is None else settle(composed(total, parents))
        edges = settle(relabelled(edges, parents))
    if total is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return total.select("node", F.col("parent").alias("root"))
