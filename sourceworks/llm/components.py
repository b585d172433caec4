"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.session import cut_lineage


def _mapped(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by what ``to`` (node, parent) says of it, if anything."""
    joined = df.join(to.select(F.col("node").alias("_node"), F.col("parent").alias("_parent")), F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the component's name is its smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks
    once, and contracts the links to what they join then, until none is left. A
    round is a few joins and aggregates on the links that remain, whose number
    falls quickly; nothing is gathered on the driver but their count.
    """
    links = cut_lineage(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    found = None
    while found is None or links.limit(1).count():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = ends.groupBy("a").agg(F.min("b").alias("_least"))
        hooks = cut_lineage(hooks.select(F.col("a").alias("node"), F.least("a", "_least").alias("parent")))
        parents = cut_lineage(_mapped(hooks, "parent", hooks))
        named = parents.withColumnRenamed("parent", "component")
        found = named if found is None else cut_lineage(_mapped(found, "component", parents))
        joined = _mapped(_mapped(links, "a", parents), "b", parents).where("a <> b")
        links = cut_lineage(joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found
