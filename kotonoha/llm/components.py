"""Connected components of a graph of doc_ids, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of longs -> (id, root): each vertex with an edge, and the smallest vertex it is connected with.

    Alternates large-star and small-star steps: in the first each vertex links its larger
    neighbours to its smallest neighbour, in the second its smaller ones and itself. Both keep
    the components; they end with a star around each component's smallest vertex, after a
    number of rounds that grows with the logarithm of the number of vertices, and a graph that
    is such a star already takes none. Minima are pre-aggregated, and no neighbourhood is
    gathered in one place.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if is_star(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = cut(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def is_star(pairs: DataFrame) -> bool:
    """Whether each vertex with a smaller neighbour has only that one, and is no one's smaller neighbour."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counted = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return counted.where("up > 1 or (up > 0 and down > 0)").isEmpty()
