"""Connected components of an edge table, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool, unspool


def connected_components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of the edges (u long, v long): root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each is a
    minimum by node, combined before the shuffle, and an equi-join, so that no
    task holds a component.  Each round is written to the shared folder.
    Self-loops and repeated edges are allowed; an empty table gives none.
    """
    pair = lambda u, v: (F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    now = spool(edges.select(*pair(F.col("u"), F.col("v"))).where("u <> v").distinct(), name)
    loops = edges.where("u = v").select(F.col("u").alias("node"))

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        return r[0], r[1]

    start, old = now, mark(now)
    while old[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(*pair(F.col("v"), F.col("m")))
        last, now = now, spool(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        if last is not start and last.inputFiles():
            unspool(last)
        new = mark(now)
        if new == old:
            break
        old = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    nodes = start.select(F.col("u").alias("node")).union(start.select("v")).union(loops).distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
