"""Connected components of an edge table, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.session import persisted, release


def components(edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Nodes are longs without nulls; loops and repeated edges don't matter; no edges give no rows. In each round every node
    takes the smallest root among its own and its neighbours', then the root of that root, so the rounds grow with the
    logarithm of a component's diameter. Each round is written to the shared folder, which cuts the lineage. A node with
    very many edges only ever appears as the unique side of a join or under a minimum with partial aggregates.
    ``most_edges``, if known, bounds the number of edges.
    """
    both = persisted(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges", most_edges and 2 * most_edges)
    most = both.count()
    alone = edges.where("a = b").select("a").distinct()
    roots = persisted(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots", most)
    last = roots
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        new = persisted(step.join(jump, "root").select("node", "was", F.least("root", "upper").alias("root")), "roots", most)
        release(last)
        roots, last = new.select("node", "root"), new
        if new.where("was <> root").isEmpty():
            break
    release(both)
    return roots.union(alone.join(roots, alone["a"] == roots["node"], "left_anti").select("a", F.col("a").alias("root")))
