"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (`a`, `b`, both whole numbers).

    In each round a node joins the first, in a pseudorandom order, of itself and its neighbours, and edges become edges
    between what their ends have joined; those within one node go. A part of all nodes goes each round, whatever the
    shape of the graph, so rounds grow with the logarithm of its size and edges shrink with them. A node with very many
    edges is aggregated before it moves and split by the joins. Rounds are written to the shared folder; the driver only
    learns whether edges are left.
    """
    place = lambda node: F.struct(F.xxhash64(node).alias("turn"), node.alias("node"))
    pairs = stage(_pairs(edges, F.col("a"), F.col("b")), "edges")
    joined = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(place(F.col("b"))).alias("best"))
        nearest = stage(nearest.select(F.col("a").alias("node"), F.least(place(F.col("a")), "best").getField("node").alias("to")), "nearest")
        if joined is None:
            joined = nearest
        else:
            next_to = nearest.select(F.col("node").alias("to"), F.col("to").alias("next"))
            joined = stage(joined.join(next_to, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "joined")
        left, right = nearest.toDF("a", "x"), nearest.toDF("b", "y")
        pairs = stage(_pairs(pairs.join(left, "a").join(right, "b"), F.col("x"), F.col("y")), "edges")
        if pairs.isEmpty():
            least = stage(joined.groupBy("to").agg(F.min("node").alias("component")), "least")
            return joined.join(least, "to").select("node", "component")


def _pairs(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
