"""Connected components by alternating large-star and small-star steps, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import staged


def _least(df: DataFrame) -> DataFrame:
    return df.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """id, root: the least id of its component, for every id that has an edge.

    Each half step joins every node's neighbours to the least of them; the edges
    stay at most as many as they were.  Ends when no edge changes any more.
    """
    edges = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node's smaller neighbours, and the node itself, to the least of them
        small = large.join(large.groupBy("a").agg(F.min("b").alias("least")), "a")
        edges = staged(small.select("b", "least").unionAll(small.select(F.col("a").alias("b"), "least")).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
