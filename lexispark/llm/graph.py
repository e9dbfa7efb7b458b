"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _least(pairs: DataFrame) -> DataFrame:
    """(v, m) for (u, v): m the least of u and its v's. Aggregated before the join, which may split a hot u."""
    m = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(m, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the least node reachable.

    Alternating large and small stars until nothing changes; each round is a
    written table. Self-loops and repeated edges do no harm; no edges, no rows.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    size = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = size(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        near = _least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = written(small, "edges")
        forget(e)
        e, old, state = new, state, size(new)
        if state == old:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
