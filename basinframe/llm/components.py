"""Connected components over a table of edges, by alternating large-star and small-star steps.

Every step is a partial aggregation and an equi-join, so a hub is summed on the map side and a hot key of
the join is split by adaptive execution. Each round ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF))
    ).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long; any order, loops and repeats allowed) to (node, root), root being the
    smallest node that is reachable. Nodes without an edge to another node are not listed."""
    now = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(small.union(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        was, mark = mark, _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
