"""Equi-joins whose keys are heavy on both sides, such as the hubs of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stable

#: Row pairs that one cell of a heavy key may make.
CELL_PAIRS = 10_000_000
#: Largest table of heavy keys that is broadcast (about 32 bytes a row); a larger one is joined.
BROADCAST_ROWS = 1_000_000


def hub_join(left: DataFrame, right: DataFrame, key: str, left_spread: list[str], right_spread: list[str],
             cell_pairs: int = CELL_PAIRS, broadcast_rows: int = BROADCAST_ROWS, cell: str | None = None) -> DataFrame:
    """Inner join on ``key`` that never puts all pairs of a heavy key into one task.

    Both sides are counted by key first. A key with more than ``cell_pairs`` pairs becomes a grid: left rows are dealt to
    its rows and right rows to its columns by a hash of the spread columns, and each row is copied to the cells of its
    line only. Other keys are one cell and are not copied. Rows that agree in all spread columns stay together. Null keys
    match nothing. ``cell`` names a column for the number of the cell in the result (for tests and plans).
    """
    side = max(1, int(cell_pairs ** 0.5))
    counts = [df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_nl"), (right, "_nr"))]
    lines = F.ceil(F.col("_nl") / side).cast("int")
    hubs = counts[0].join(counts[1], key).where(F.col("_nl") * F.col("_nr") > cell_pairs).withColumn("_rows", lines)
    hubs = stable(hubs.select(key, "_rows", F.ceil(F.col("_nr") * F.ceil(F.col("_nl") / F.col("_rows")) / cell_pairs)
                              .cast("int").alias("_columns")))
    heavy = hubs.count()
    if heavy == 0 and cell is None:
        return left.join(right, key)
    if heavy <= broadcast_rows:
        hubs = F.broadcast(hubs)

    def dealt(df: DataFrame, spread: list[str], own: str, other: str) -> DataFrame:
        placed = df.join(hubs, key, "left")
        line = F.when(F.col(own).isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col(own)).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return placed.withColumn("_own", line).withColumn("_other", copies).drop("_rows", "_columns")

    a = dealt(left, left_spread, "_rows", "_columns").withColumnsRenamed({"_own": "_i", "_other": "_j"})
    b = dealt(right, right_spread, "_columns", "_rows").withColumnsRenamed({"_own": "_j", "_other": "_i"})
    out = a.join(b, [key, "_i", "_j"])
    if cell is not None:
        out = out.withColumn(cell, F.struct("_i", "_j"))
    return out.drop("_i", "_j")
