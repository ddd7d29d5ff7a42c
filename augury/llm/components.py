"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(low, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def smallest_reachable(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(rep, label) for every node of ``edges`` (a, b): the smallest node it can reach.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour; it ends when the
    edges are stars. Rounds grow with the logarithm of the number of nodes. Nothing is gathered on the driver but counts.
    """
    current = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    fact = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
    for _ in range(most_rounds):
        if not fact[0]:
            break
        current = saved(_star(_star(current, True), False), "edges")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if tuple(now) == tuple(fact):
            break
        fact = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("rep"), F.col("b").alias("label")).unionByName(
        current.select(F.col("b").alias("rep"), F.col("b").alias("label"))).distinct()
