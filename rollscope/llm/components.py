"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge of `edges(a, b)`; nodes of one component share a root, itself a node.

    Each round maps every node to the lowest of itself and its neighbours in hashed order, and renames the edges by it.
    The hashed order shrinks the graph by a constant factor on average whatever its shape, so the rounds are
    logarithmic and their tables fall off. Names per node are partial minima: no neighbour list is ever built.
    """
    def clean(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left = stored(clean(edges), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")).toDF("a", "b"))
        best = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m")
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
        step = stored(both.groupBy("a").agg(best).select(
            F.col("a").alias("node"), F.least(F.col("m"), own)["v"].alias("to")), "names")
        maps.append(step)
        renamed = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(
            step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        left = stored(clean(renamed.select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("to").alias("next"))
        out = out.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
