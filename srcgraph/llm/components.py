"""Connected components by alternating large-star and small-star over an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.session import materialize

SALTS = 8


def _with_least(e: DataFrame) -> DataFrame:
    """(u, v, m): each directed edge with the least of u's neighbours.

    The least is found with partial aggregation and met again on (u, salt), so that the edges of a hub,
    which may be a third of all, spread over tasks.
    """
    m = e.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("mu"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("ms"))
    s = e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return s.join(m, (F.col("u") == F.col("mu")) & (F.col("s") == F.col("ms"))).select("u", "v", "m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    x = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return x.distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """e: edges with u > v."""
    x = _with_least(e)
    return x.select("u", F.col("m").alias("v")).unionByName(
        x.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node with an edge to another; label is the least node of its component.

    edges: (u, v) longs, in any direction; loops, repeated edges and rows with a null are no harm. Each round
    is written to the shared folder, which cuts the lineage. Rounds end when the edges no longer change; they
    then point from every node straight to its least.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, mark = materialize(e, "cc"), None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = now
        e = materialize(_small_star(_large_star(e)), "cc")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
