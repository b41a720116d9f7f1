"""Connected components of a graph given as pairs (a, b) of longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import dropped, join_salted, written

#: Edges up to which a join needs no care for hubs: what one task holds with ease.
FEW = 100_000


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (a, b) plus `m`, the least b of each a. The pairs of a hub, where there may be many, spread over partitions."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
    if total <= FEW:
        return pairs.join(least.drop("_n"), "a")
    return join_salted(pairs, written(least), ["a"], "_n", total).drop("_n")


def _stars(edges: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al., 2014) on pairs with a > b."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_e")).select("_e.a", "_e.b")
    large = _with_least(both, 2 * total).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
    small = _with_least(large, total).select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("_e"))
    return small.select(F.col("_e.x").alias("a"), F.col("_e.y").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the least node of its component.

    Each round writes the new edges to the shared folder and drops those of the round before, so no lineage grows and
    a lost executor costs one round at most. It ends when a round changes nothing: every node points at its root.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        is_now = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if is_now == mark or is_now[0] == 0:
            break
        mark, before = is_now, now
        now = written(_stars(now, is_now[0]))
        dropped(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
