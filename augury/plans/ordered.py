"""Exact ranks, running totals and quantiles that never place one whole group in one task.

A plain ``row_number() over (partition by k)`` sends every row of ``k`` to one task. Here rows are range
partitioned on (group, order), each slice is ranked on its own, and the per-slice sizes (one row per group and
slice) supply the offsets. The slice number is checkpointed, because range bounds are sampled and a recomputed
slice must not move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import stable


def _same(left: str, right: str, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def _with_offsets(rows: DataFrame, group: list[str], bucket: str, order: list[Column], sums: dict[str, str],
                  rank: str, following: Column | None = None) -> DataFrame:
    keys = [*group, bucket]
    # one struct as key: nulls are equal in it, and the join finds the rows dealt and sorted by the window
    local = Window.partitionBy("_key").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_key", F.struct(*keys)).withColumn("_local", F.row_number().over(local))
    added = []
    if following is not None:
        added = ["_next", "_opens"]
        placed = placed.withColumn("_next", F.lead(following).over(local)).withColumn("_opens", F.col("_local") == 1)
    for name, source in sums.items():
        placed = placed.withColumn(f"_local_{name}", F.sum(source).over(running))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"),
                                    *[F.sum(s).alias(f"_size_{n}") for n, s in sums.items()])
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.struct(*keys).alias("_key"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_size_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    out = placed.alias("p").join(offsets.alias("o"), F.col("p._key") == F.col("o._key"))
    return out.select(
        *[F.col(f"p.`{c}`") for c in rows.columns if c != bucket], *added,
        (F.col("p._local") + F.col("o._before")).alias(rank),
        *[(F.coalesce(F.col(f"p._local_{n}"), F.lit(0)) + F.col(f"o._before_{n}")).alias(n) for n in sums])


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank",
           sums: dict[str, str] | None = None) -> DataFrame:
    """1-based rank within ``group`` by a unique ``order``, plus running sums ``{output: input column}``."""
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    rows = stable(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()))
    return _with_offsets(rows, group, "_slice", order, sums or {}, rank)


def hash_ranked(df: DataFrame, group: list[str], digest: str, tie: list[str], rank: str = "rank",
                width: int = 3, following: Column | None = None, packed: bool = False) -> DataFrame:
    """Rank by a hex digest. The first ``width`` digits split a group evenly, so no sampling is needed.

    A ``packed`` digest travels as half as many bytes, which sort alike, and stays so in the result. With ``following``, ``_next`` is that value of the next row of the slice (null at its end) and ``_opens`` marks the
    first row of a slice."""
    rows = df.withColumn("_slice", F.substring(digest, 1, width))
    if packed:
        rows = rows.withColumn(digest, F.unhex(digest))
    return _with_offsets(rows, group, "_slice", [F.col(digest), *[F.col(t) for t in tie]], {}, rank, following)


def first_rows(df: DataFrame, group: list[str], order: list[Column], n: int, spread_by: str, rank: str = "rank",
               parts: int = 64) -> DataFrame:
    """The first ``n`` rows per group with their rank. Parts of a group are cut to ``n`` rows first, so the task that ends
    a group reads ``parts * n`` rows at most, however large the group and however many map tasks there are."""
    part = F.pmod(F.xxhash64(spread_by), F.lit(parts))
    near = df.withColumn("_part", part).withColumn(rank, F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    near = near.where(F.col(rank) <= n).drop("_part", rank)
    return near.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def exact_quantiles(df: DataFrame, group: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Linearly interpolated quantiles per group; one row per (group, q).

    Equal values are counted first, then ranked in slices; only the order statistics next to each wanted position
    survive the filter.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col(value)]
    cumulative = ranked(counted, group, order, rank="_pos", sums={"_upto": "_n"})
    totals = counted.groupBy(*group).agg(F.sum("_n").alias("_total"))
    joined = (cumulative.alias("c").join(totals.alias("t"), _same("c", "t", group)) if group
              else cumulative.alias("c").withColumn("_total", totals.select("_total").scalar()))
    spread = joined.select(*[F.col(f"c.{g}") for g in group], F.col(f"c.{value}").alias("_v"), "_n", "_upto", "_total",
                           F.explode(F.array(*[F.lit(float(q)) for q in probabilities])).alias("q"))
    position = F.col("q") * (F.col("_total") - 1)
    low, high = F.floor(position), F.ceil(position)
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    picked = spread.select(
        *group, "q", (position - low).alias("_w"),
        F.when((low >= first) & (low <= last), F.col("_v")).alias("_lo"),
        F.when((high >= first) & (high <= last), F.col("_v")).alias("_hi"),
    ).where("_lo is not null or _hi is not null")
    return picked.groupBy(*group, "q").agg(
        (F.max("_lo") + (F.max("_hi") - F.max("_lo")) * F.max("_w")).alias("quantile"))
