"""Weighted graphs as edge tables: how well a division into communities fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Newman's modularity of communities (node, community) over undirected edges (a, b, weight), each given once; a loop
    adds twice its weight to its node's degree. Edges with an end in no community are left out; no weight gives null.

    Edges become sums by community before anything meets, so what is left after the joins is a row for each community.
    """
    a, b = communities.toDF("a", "ca"), communities.toDF("b", "cb")
    inner = F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)
    ends = F.array(F.struct(F.col("ca").alias("c"), inner.alias("inner")), F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inner")))
    found = edges.join(a, "a").join(b, "b").select("weight", F.explode(ends).alias("e"))
    sums = found.groupBy("e.c").agg(F.sum("weight").alias("degree"), F.sum("e.inner").alias("inner"))
    total = sums.agg(F.sum("degree").alias("m2"), F.sum("inner").alias("inner"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    return total.select((F.try_divide(2 * F.col("inner"), F.col("m2")) - F.try_divide(F.col("squares"), F.col("m2") * F.col("m2"))).alias("modularity"))


def relation_shares(edges: DataFrame) -> DataFrame:
    """Each edge's share of the weight that leaves its first end."""
    total = edges.groupBy("a").agg(F.sum("weight").alias("__total"))
    return edges.join(total, "a").withColumn("share", F.try_divide("weight", "__total")).drop("__total")
