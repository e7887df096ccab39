"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node of the edges; nodes are longs.

    Each step tells every neighbour of a node the smallest id around it, by a count of one row per node and
    a join that Spark may split where a node has very many neighbours. Every step is a written table, so
    lineage stays short and a lost executor repeats one step. Self-loops give a node its own component;
    edges with a null end are left out; repeated edges count once.
    """
    given = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    alone = given.where("a = b").select(F.col("a").alias("node"))
    now = stored(_ordered(given), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")), "low")
        large = (both.where("b > a").join(low.select("a", F.least("a", "m").alias("m")), "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = stored(large, "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).unionByName(alone).distinct().join(
        nodes.select("node"), "node", "left_anti")
    return stored(nodes.unionByName(roots.withColumn("component", F.col("node"))), "components")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them; equal only when a step changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
