"""Connected components as joins: hook every node to its smallest neighbour, flatten, contract.

In each round a node takes the smallest of itself and its neighbours as parent,
the forest of parents is flattened by pointer jumping, and the links are redrawn
between the roots. Links inside a tree vanish, so the links shrink quickly; the
rounds end when none is left. Every intermediate frame is a written table in the
shared folder. Joins go from hot labels to one row per node, in a form that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators.scratch import materialize


def _flattened(parent: DataFrame) -> DataFrame:
    """Every node points to its root."""
    while True:
        above = parent.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        jumped = parent.join(above, F.col("root") == F.col("_node")).select(
            "node", F.col("_root").alias("root"), (F.col("_root") != F.col("root")).alias("moved")
        )
        jumped = materialize(jumped, "roots")
        if jumped.filter("moved").isEmpty():
            return jumped.drop("moved")
        parent = jumped.drop("moved")


def _renamed(links: DataFrame, parent: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        links = links.join(parent, F.col(side) == F.col("node")).withColumn(side, F.col("root")).select("a", "b")
    return links.filter(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the links; the component is its smallest node.

    Links are undirected. Repeated links, loops and links with a null end are
    ignored; a node that has no other link does not appear. No links, no rows.
    Runs jobs while the frame is built.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = ends.select(F.inline(ways))
    edges = materialize(both.distinct(), "links")
    found = None
    while not edges.isEmpty():
        hooked = edges.groupBy("a").agg(F.min("b").alias("least"))
        parent = materialize(hooked.select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "parents")
        parent = _flattened(parent)
        if found is None:
            found = parent.withColumnRenamed("root", "component")
        else:
            stepped = found.join(parent.withColumnRenamed("node", "_node"), F.col("component") == F.col("_node"), "left")
            found = stepped.select("node", F.coalesce("root", "component").alias("component"))
            found = materialize(found, "components")
        edges = materialize(_renamed(edges, parent), "links")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
