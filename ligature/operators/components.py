"""Connected components of an edge table by alternating star contraction.

Each round joins every edge with the smallest neighbour of an end, first for neighbours above a
node (large star), then for those below (small star). Edges become stars around the smallest node
of their component in a number of rounds that grows with the logarithm of the path length
(Kiveris et al., 2014). Minima are partial aggregations and a hot node's edges are the probe side
of a join that Spark may split, so no task gathers a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every end of an edge.

    Self loops put their node in a component of its own; edges with a null end are left out.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = ends.where("u = v").select(F.col("u").alias("node"))
    # (u, v) with u above v from here on
    now = materialize(ends.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark = _checksum(now)
    while mark[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(below, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, materialize(linked.select("e.u", "e.v").where("u != v").distinct(), "stars")
        release(last)
        before, mark = mark, _checksum(now)
        if before == mark:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return nodes.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
