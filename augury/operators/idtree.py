"""Digest trees over id sets: leaves of bounded size, stored levels, differences found by walking down two trees.

An id belongs to the leaf named by the first hex digits of its MD5 digest, so leaves fill evenly whatever the ids look
like. The number of digits follows the number of ids, which keeps the expected leaf at ``leaf_size`` ids or fewer at
every scale; an inner node has sixteen children at most. No row ever holds a large set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stable

LEAF_SIZE = 4096


def tree_depth(count: int, leaf_size: int = LEAF_SIZE) -> int:
    """Smallest number of hex digits at which an average leaf holds ``leaf_size`` ids or fewer."""
    depth = 0
    while leaf_size * 16 ** depth < count:
        depth += 1
    return depth


def _placed(ids: DataFrame, key: str, depth: int) -> DataFrame:
    text = F.col(key).cast("string")
    return ids.where(F.col(key).isNotNull()).select(text.alias("id"), F.substring(F.md5(text), 1, depth).alias("prefix"))


def _digest(value: str):
    return F.sha2(F.array_join(F.array_sort(F.collect_list(value)), ","), 256).alias("digest")


def hash_tree(ids: DataFrame, key: str, leaf_size: int = LEAF_SIZE, depth: int | None = None) -> DataFrame:
    """(level, prefix, digest, n) for every node; the root has level 0. Repeated ids count as often as they occur, null
    ids are left out, and an empty set has no node. Trees to be compared need the same ``depth``."""
    if depth is None:
        depth = tree_depth(ids.select(F.count(key)).first()[0], leaf_size)
    leaves = stable(_placed(ids, key, depth).groupBy("prefix").agg(_digest("id"), F.count(F.lit(1)).alias("n")))
    level, out = leaves, leaves.withColumn("level", F.lit(depth))
    for up in range(depth - 1, -1, -1):
        level = level.select(F.substring("prefix", 1, up).alias("above"), F.concat("prefix", "digest").alias("child"), "n").groupBy(
            F.col("above").alias("prefix")).agg(_digest("child"), F.sum("n").alias("n"))
        out = out.unionByName(level.withColumn("level", F.lit(up)))
    return out.select("level", "prefix", "digest", "n")


def changed_leaves(left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """Prefixes of the leaves that differ. Every step reads only children of nodes that differ one level above."""
    def nodes(tree: DataFrame, level: int, name: str, above: DataFrame | None) -> DataFrame:
        rows = tree.where(F.col("level") == level).select("prefix", F.col("digest").alias(name))
        if above is None:
            return rows
        return rows.withColumn("above", F.substring("prefix", 1, level - 1)).join(above, "above", "left_semi").drop("above")

    above = None
    for level in range(depth + 1):
        both = nodes(left, level, "l", above).join(nodes(right, level, "r", above), "prefix", "full_outer")
        changed = both.where(~F.col("l").eqNullSafe(F.col("r"))).select("prefix")
        above = changed.withColumnRenamed("prefix", "above")
    return changed


def tree_difference(left: DataFrame, right: DataFrame, key: str, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(id, side, copies): ids that one side holds more often than the other, with the surplus.

    Both trees are stored, then only the ids of differing leaves are compared. Equal sets compare no id at all.
    """
    depth = tree_depth(max(df.select(F.count(key)).first()[0] for df in (left, right)), leaf_size)
    trees = [stable(hash_tree(df, key, depth=depth)) for df in (left, right)]
    leaves = stable(changed_leaves(*trees, depth))
    signed = [_placed(df, key, depth).join(leaves, "prefix", "left_semi").select("id", F.lit(sign).alias("sign"))
              for df, sign in ((left, 1), (right, -1))]
    surplus = signed[0].unionByName(signed[1]).groupBy("id").agg(F.sum("sign").alias("s")).where("s <> 0")
    return surplus.select("id", F.when(F.col("s") > 0, "left").otherwise("right").alias("side"), F.abs("s").alias("copies"))
