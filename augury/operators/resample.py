"""Block-bootstrap intervals, embargoed folds, chronological splits and keyed shuffles.

Rows are reduced to one total per block (calendar week) first, so replicates never touch event rows. A group's
blocks are bounded by the calendar, and travel as one small array; replicates are spread over the cluster and each
draws its own blocks with a counter hash, so results are the same on every run and in other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixtures import week_start
from ..plans.ordered import hash_ranked


def draw(seed: Column, replicate: Column, position: Column, size: Column) -> Column:
    """Uniform index in [0, size) from md5(seed:replicate:position)."""
    text = F.concat_ws(":", seed, replicate, position)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size


def _field(name: str):
    return lambda row: row[name]


def week_blocks(df: DataFrame, by: list[str], day: str, totals: list[str], keep_empty: bool) -> DataFrame:
    """One row per group with aligned arrays of block counts and totals, in week order.

    ``keep_empty`` inserts zero weeks between the first and the last observed one.
    """
    weekly = df.groupBy(*by, week_start(F.col(day)).alias("week")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).cast("double").alias(c) for c in totals])
    names = ["n", *totals]
    packed = weekly.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("week", *names))).alias("w"), F.min("week").alias("first"),
        F.max("week").alias("last"), F.sum("n").cast("long").alias("rows"),
        *[F.sum(c).alias(f"sum_{c}") for c in totals])
    if not keep_empty:
        columns = {n: F.transform("w", _field(n)) for n in names}
    else:
        index = F.map_from_entries(F.transform("w", lambda x: F.struct(x["week"], x)))
        weeks = F.sequence("first", "last", F.expr("INTERVAL 7 DAY"))
        filled = F.transform(weeks, lambda d: F.try_element_at(index, d))
        columns = {n: F.transform(F.transform(filled, _field(n)), lambda v: F.coalesce(v, F.lit(0.0))) for n in names}
    return packed.select(*by, "rows", *[f"sum_{c}" for c in totals], *[v.alias(f"_{n}") for n, v in columns.items()])


def bootstrap(blocks: DataFrame, by: list[str], totals: list[str], replicates: int, seed: int,
              alpha: float = 0.025) -> DataFrame:
    """Percentile interval of sum(total) / sum(count) over resampled blocks, for every total."""
    size = F.size("_n")
    rows = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
    rows = rows.repartition(*by, "_rep")
    drawn = F.transform(F.sequence(F.lit(0), size - 1),
                        lambda j: draw(F.lit(seed), F.col("_rep"), j, size).cast("int"))
    rows = rows.withColumn("_ix", drawn)

    def total(name: str) -> Column:
        return F.aggregate("_ix", F.lit(0.0), lambda a, i: a + F.get(F.col(f"_{name}"), i))

    count = total("n")
    samples = rows.select(*by, *[F.when(count > 0, total(c) / count).alias(c) for c in totals])
    bounds = [F.percentile(c, F.lit(q)).alias(f"{c}_{side}") for c in totals
              for q, side in ((alpha, "low"), (1 - alpha, "high"))]
    intervals = samples.groupBy(*by).agg(*bounds)
    facts = blocks.select(*by, "rows", size.alias("weeks"), F.size(F.filter("_n", lambda x: x == 0)).alias("empty_weeks"),
                          *[(F.col(f"sum_{c}") / F.col("rows")).alias(f"{c}_mean") for c in totals])
    return facts.join(intervals, by) if by else facts.select(
        "*", *[intervals.select(f"{c}_{s}").scalar().alias(f"{c}_{s}") for c in totals for s in ("low", "high")])


def decision(low: str, high: str) -> Column:
    return F.when(F.col(high) < 0, "better").when(F.col(low) > 0, "worse").otherwise("uncertain")


def chronological_split(start: Column, bounds: list[tuple[str, str]]) -> Column:
    """Name of the first split whose (exclusive) end is after ``start``; null beyond the last one."""
    head, *tail = bounds
    out = F.when(start < F.lit(head[1]).cast("timestamp_ntz"), head[0])
    for name, end in tail:
        out = out.when(start < F.lit(end).cast("timestamp_ntz"), name)
    return out


def rolling_folds(rows: DataFrame, folds: list[tuple[str, str, str]], delay_hours: int = 48) -> DataFrame:
    """(fold, row, role) with role fit, embargoed or evaluation.

    The fold list is a literal parameter, so rows fan out by an array in the same stage instead of a join.
    """
    specs = F.array(*[F.struct(F.lit(n).alias("fold"), F.lit(a).cast("timestamp_ntz").alias("_from"),
                               F.lit(b).cast("timestamp_ntz").alias("_to")) for n, a, b in folds])
    ready = F.col("start_time") + F.expr(f"INTERVAL '{delay_hours}' HOUR")
    role = (F.when(F.col("start_time") >= F.col("_to"), None)
            .when(F.col("start_time") >= F.col("_from"), "evaluation")
            .when(ready <= F.col("_from"), "fit").otherwise("embargoed"))
    return rows.select("*", F.inline(specs)).withColumn("role", role).where("role is not null").drop("_from", "_to")


def block_shuffle(rows: DataFrame, block: list[str], key: str, seed: str, values: list[str]) -> DataFrame:
    """Permute ``values`` among the rows of each block: the k-th row by one hash gets the k-th row's by another."""

    def order(tag: str) -> DataFrame:
        return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.lit(tag), F.col(key).cast("string"))))

    places = hash_ranked(order("place"), block, "_h", [key], "_k").select(*block, "_k", key)
    sources = hash_ranked(order("source"), block, "_h", [key], "_k").select(
        *block, "_k", F.col(key).alias("from_key"), *[F.col(v).alias(f"shuffled_{v}") for v in values])
    return places.join(sources, [*block, "_k"]).drop("_k")
