"""Connected components of an edge table, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import dropped, stored


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round sends every node's
    larger neighbours to its smallest one, so that a star remains for each component after
    O(log^2 n) rounds. Nothing but a count and a checksum reaches the driver. Every round's edges are a
    table in the shared folder. No edges: no rows. A loop edge gives a node with itself as root only if it
    has other edges; loops alone are dropped.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    before = _sign(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(last)
        now = _sign(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
