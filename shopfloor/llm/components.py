"""Connected components of a table of links, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows these
    pointers to their ends and replaces the links by links between the
    ends; at least half of the nodes that still have links go each round.
    """
    edges = written(links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
                    .where("a < b").distinct(), "links")
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    roots = written(roots, "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
                        .select("node", F.least("node", "to").alias("to")), "hooks")
        while True:
            further = written(hooks.alias("x").join(hooks.select(F.col("node").alias("to"), F.col("to").alias("end")), "to")
                              .select("node", F.col("end").alias("to"), (F.col("to") != F.col("end")).alias("moved")), "hooks")
            hooks = further.select("node", "to")
            if further.where("moved").isEmpty():
                break
        roots = written(roots.join(hooks.select(F.col("node").alias("root"), "to"), "root", "left")
                        .select("node", F.coalesce("to", "root").alias("root")), "roots")
        ends = lambda c: hooks.select(F.col("node").alias(c), F.col("to").alias(c + "2"))
        edges = written(edges.join(ends("a"), "a").join(ends("b"), "b")
                        .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
                        .where("a < b").distinct(), "links")
    return roots
