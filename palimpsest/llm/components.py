"""Connected components of a graph of links, by alternating large and small stars. All steps are DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stage, unstage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """edges(a long, b long), any orientation, repeats and loops allowed -> (node, root), staged: one row for each node that isn't the smallest of its component.

    A node without links has no row. The aggregation before each join leaves one row a node, and the join's other side is a scan,
    so that adaptive execution can split a hub's partition.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least_small = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = large.join(least_small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage(hung.unionByName(least_small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        unstage(now, least, large, least_small)
        now, before, seen = after, seen, _signature(after)
        if seen == before:
            break
    out = now.toDF("node", "root")
    out._palimpsest_path = now._palimpsest_path
    return out
