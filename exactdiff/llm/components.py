"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exactdiff.llm.common import BROADCAST_ROWS, FEW, counted, cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). Returns node, component: one row for each node of an edge between two different
    nodes, and the smallest node that it reaches. Repeated edges and an empty table are fine; loops and rows with a null
    end are dropped. edges is evaluated once. Each round moves edges towards the smallest neighbour. No round has more
    edges than the first, so where these are few, all rounds run in few partitions.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct())
    small = counted(e) <= BROADCAST_ROWS
    few = (lambda df: df.coalesce(FEW)) if small else (lambda df: df)
    beside = F.broadcast if small else (lambda df: df)
    e = few(e)
    while not _settled(e, few):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: each larger neighbour is tied to the smallest of the neighbourhood
        large = both.where("v > u").join(beside(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = few(large)
        # small star: each smaller neighbour, and the node itself, is tied to the smallest one
        low = few(large.groupBy("u").agg(F.min("v").alias("m")))
        lower = large.join(beside(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = few(cut(few(lower.union(low.select("u", F.col("m").alias("v"))).distinct())))
    tied = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = few(e.select(F.col("v").alias("node")).distinct()).select("node", F.col("node").alias("component"))
    return tied.union(roots)


def _settled(e: DataFrame, few: Callable[[DataFrame], DataFrame]) -> bool:
    """Whether every node has one smaller neighbour only, or none and is nobody's larger one: edges form stars."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(True).alias("larger")), F.struct(F.col("v").alias("node"), F.lit(False).alias("larger")))).alias("x")).select("x.*")
    return few(ends.groupBy("node").agg(F.count_if("larger").alias("up"), F.bool_or(~F.col("larger")).alias("down"))).where("up > 1 or (up = 1 and down)").isEmpty()
