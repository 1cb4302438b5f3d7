"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.session import persisted, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component that each node of an edge (a, b) belongs to.

    Edges are replaced round by round by shorter ways to the smallest neighbour, for larger neighbours and smaller
    ones in turn, which keeps components as they are. The number of rounds goes with the logarithm of a component's length. A
    node's smallest neighbour comes from an aggregate with partial results, so no list of neighbours is ever gathered.
    """
    now = persisted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    state = _state(now)
    while True:
        # Every node ties its larger neighbours to the smallest of its neighbours and itself.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Every node ties its smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        near = large.join(low, "b")
        small = near.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        new = persisted(small, "edges")
        release(now)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    tops = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    alone = loops.join(roots.unionByName(tops), "node", "left_anti").distinct()
    return roots.unionByName(tops).unionByName(alone)


def _state(edges: DataFrame) -> tuple:
    """A number of edges and a checksum, by which two tables of them are told apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
