"""Connected components of a graph of long ids, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoup.session import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; component is its smallest node.

    Each round first links every larger neighbour to the smallest one, then every node to the
    smallest of its smaller neighbours, until nothing changes: the number of rounds is about the
    logarithm of the longest path. Every round is written to the shared folder, so neither the
    lineage nor the driver holds the graph. Hubs only ever meet in joins that can be split.
    """
    edge = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = _state(edge)
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edge = stored(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct(), name)
        now = _state(edge)
        if now == state:
            break
        state = now
    # at the fixed point every edge leads from a node to the smallest of its component
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edge: DataFrame) -> tuple:
    r = edge.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]
