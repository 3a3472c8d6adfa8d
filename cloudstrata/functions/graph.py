"""Connected components of an edge table, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.functions import joins
from cloudstrata.functions.joins import join_hot
from cloudstrata.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the least node of each node's component, for every node that has an edge.

    Loops and repeated edges don't matter, nor does direction. Every round is
    written to the shared folder; the number of rounds grows with the logarithm
    of the nodes. A node with very many edges is aggregated before the shuffle.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    loops = cut(e.filter("u is not null and v is not null").distinct(), "components")
    e, state, edges = loops.filter("u <> v"), None, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = e.count() if edges is None else edges
        bigger = join_hot(both.filter("v > u"), least, ["u"], total=edges)
        e = bigger.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut(e, "components") if edges > joins.FEW_ROWS else e
        near = join_hot(e, e.groupBy("u").agg(F.min("v").alias("m")), ["u"], total=edges)
        e = near.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(e, "components")
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, edges = now, now[0]
    # at rest every node but a root has one edge, to its root
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
