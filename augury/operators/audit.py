"""Table audits: differences, reconciliation with recorded sums, tolerance gates, set checks, series prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ranked


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], ignore: list[str]) -> DataFrame:
    """Column-level differences of two tables with unique keys, leaving out named columns."""
    names = [c for c in left.columns if c not in (*keys, *ignore)]

    def text(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in names]).alias(side))

    both = text(left, "l").join(text(right, "r"), keys, "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"l.{c}").alias("left_value"),
                               F.col(f"r.{c}").alias("right_value")) for c in names])
    changed = F.filter(cells, lambda x: ~x["left_value"].eqNullSafe(x["right_value"]))
    return both.select(*keys, F.inline(changed))


def reconcile_sums(rows: DataFrame, recorded: DataFrame, by: list[str], value: Column, tolerance: float) -> DataFrame:
    """Recomputed group sums against recorded ones."""
    sums = rows.groupBy(*by).agg(F.sum(value).alias("recomputed"), F.count(F.lit(1)).alias("n"))
    both = sums.join(recorded, by, "full_outer")
    close = F.abs(F.col("recomputed") - F.col("recorded")) <= tolerance
    return both.select(*by, "n", "recomputed", "recorded", F.coalesce(close, F.lit(False)).alias("agrees"))


def edge_reconcile(derived: DataFrame, raw: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two edge tables that do not agree."""
    both = derived.select(*keys, F.col(value).alias("derived")).join(
        raw.select(*keys, F.col(value).alias("raw")), keys, "full_outer")
    return both.where(~F.col("derived").eqNullSafe(F.col("raw")))


def within_tolerance(actual: DataFrame, expected: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """Reproduction gate: every expected group must exist and be close."""
    both = expected.select(*by, F.col(value).alias("expected")).join(
        actual.select(*by, F.col(value).alias("actual")), by, "left")
    error = F.abs(F.col("actual") - F.col("expected"))
    return both.select(*by, "expected", "actual", error.alias("error"),
                       F.coalesce(error <= tolerance, F.lit(False)).alias("passed"))


def pair_verdicts(rows: DataFrame, identity: list[str], role: str, passed: str, roles: tuple[str, str]) -> DataFrame:
    """Pair rows by a canonical identity digest and combine verdicts; a pair needs exactly one row per role."""
    digest = F.sha2(F.concat_ws("|", *identity), 256)
    out = rows.groupBy(digest.alias("pair")).agg(
        *[F.count_if(F.col(role) == r).alias(r) for r in roles],
        *[F.bool_and(F.when(F.col(role) == r, F.col(passed))).alias(f"{r}_passed") for r in roles])
    one_each = reduce(lambda a, b: a & b, [F.col(r) == 1 for r in roles])
    return out.select("pair", *roles, one_each.alias("paired"),
                      (one_each & F.coalesce(F.col(f"{roles[0]}_passed") & F.col(f"{roles[1]}_passed"), F.lit(False))
                       ).alias("qualified"))


def id_difference(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Distinct keys on one side only, in one pass over both sides."""
    keys = [key] if isinstance(key, str) else key
    flags = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = flags.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r")
    return seen.select(*keys, F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))


def running_sum_check(rows: DataFrame, group: list[str], order: list[str], value: str, recorded: str,
                      tolerance: float = 1e-6) -> DataFrame:
    """Recorded cumulative value against the running sum, ranked in slices."""
    out = ranked(rows, group, [F.col(c) for c in order], "position", {"running": value})
    return out.select(*group, *order, "position", "running", recorded,
                      (F.abs(F.col("running") - F.col(recorded)) <= tolerance).alias("consistent"))


def first_divergence(left: DataFrame, right: DataFrame, group: list[str], step: str, value: str) -> DataFrame:
    """First step at which two series differ (or one has no row) and the length of the equal prefix."""
    both = left.select(*group, step, F.col(value).alias("l"), F.lit(True).alias("in_l")).join(
        right.select(*group, step, F.col(value).alias("r"), F.lit(True).alias("in_r")), [*group, step], "full_outer")
    differs = ~(F.col("l").eqNullSafe(F.col("r")) & F.col("in_l").eqNullSafe(F.col("in_r")))
    return both.groupBy(*group).agg(F.min(F.when(differs, F.col(step))).alias("first_step"),
                                    F.count(F.lit(1)).alias("steps"), F.count_if(differs).alias("different"))


def mask_invariants(before: DataFrame, after: DataFrame, keys: list[str], value: str, mask: str) -> DataFrame:
    """Violations of 'rows outside the mask stay as they were', per key."""
    both = before.select(*keys, mask, F.col(value).alias("old")).join(
        after.select(*keys, F.col(value).alias("new")), keys, "full_outer")
    return both.where(~F.coalesce(F.col(mask), F.lit(False)) & ~F.col("old").eqNullSafe(F.col("new"))).select(
        *keys, "old", "new")
