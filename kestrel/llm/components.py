"""Connected components of a link table by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.staging import stage


def _mapped(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by its parent in ``to`` (node, parent), if it has one."""
    t = to.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    return df.join(t, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_p", column)).drop("_n", "_p")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): component is a node of it.

    Each round hooks every node to its smallest neighbour, jumps over parents until all point
    to a root, and goes on with the links between roots; a root that still has links at
    least pairs up, so rounds are logarithmic. Written tables end the lineage of a round.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .filter("a <> b").distinct(), "links")
    out: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        tree = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("parent"))
        tree = stage(tree, "tree")
        while True:
            jumped = stage(_mapped(tree.withColumn("old", F.col("parent")), "parent", tree), "tree")
            moved = not jumped.filter("old <> parent").isEmpty()
            tree = jumped.select("node", "parent")
            if not moved:
                break
        out = tree if out is None else stage(
            _mapped(out, "parent", tree).unionByName(tree.join(out.select("node"), "node", "left_anti")), "tree")
        left = _mapped(_mapped(edges, "a", tree), "b", tree).filter("a <> b")
        edges = stage(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if out is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return out.select("node", F.col("parent").alias("component"))
