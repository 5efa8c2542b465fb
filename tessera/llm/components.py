"""Connected components of a graph given by its edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for all nodes of the edges (a, b).

    In each round every node takes as its parent the least of its neighbours and itself, in an order that a hash draws
    anew for the round, and edges are drawn between parents instead. In a random order only a share of the nodes of a
    component are anybody's parents, whatever its shape, so the rounds grow with the logarithm of its size. Both ends of
    an edge are reduced before shuffling."""
    spark = edges.sparkSession
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    kind = edges.schema["a"].dataType.simpleString()
    levels: list[DataFrame] = []
    while not left.isEmpty():
        ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("parent")) for x in "ab" for y in "ab"))
        both = left.select(F.explode(ends).alias("e")).select("e.*")
        drawn = F.struct(F.xxhash64("parent", F.lit(len(levels))), "parent")
        parent = stored(both.groupBy("node").agg(F.min(drawn).alias("p")).select("node", "p.parent"), "cc-parents")
        levels.append(parent)
        pa, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        up = left.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        done, left = left, stored(up.filter("a <> b").distinct(), "cc-edges")
        discard(done)
    discard(left)
    if not levels:
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    out = levels[0].toDF("node", "root")
    for level in levels[1:]:
        out = out.join(level.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    # a component is named by its smallest node
    least = out.groupBy("root").agg(F.least(F.min("node"), F.min("root")).alias("least"))
    out = stored(out.join(least, "root").select("node", F.col("least").alias("root")), "cc-roots")
    discard(*levels)
    return out
