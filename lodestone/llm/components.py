"""Connected components by alternating large-star and small-star rounds.

The edges stay distributed; each half round writes to the shared checkpoint
folder. Rows are joined only to freshly read tables on both sides, so adaptive
execution can split a hub's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("sum(a % 1000003)").alias("s"), F.expr("sum(b % 1000003)").alias("t")).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for each node of an edge; component is the smallest node reachable.

    Nodes are longs. Nodes without an edge to another are not returned. Nulls
    in either end drop the edge. Raises if ``rounds`` do not suffice (each
    round shrinks distances by a constant factor, so they do).
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    before = _signature(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(large.where("a <> b").distinct())
        least = cut(now.groupBy("a").agg(F.min("b").alias("m")))
        small = now.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = _signature(now)
        if after == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = after
    raise RuntimeError("components did not settle")
