"""Forecast scoring: metrics, calibration, common samples, paired differences, model choice.

Everything is a two-step aggregation: rows collapse to (group, bin) or (event, source) partial sums inside the map
tasks, and only those partial sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import argmax, bin_of, binary_loss, brier, label_probability, log_loss, vector, wilson


def first_forecasts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest saved row per key (ties by id), as a map-side combinable minimum."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("saved_at", "forecast_id")).alias("_f")
    return df.groupBy(*keys).agg(first).select(*keys, "_f.*")


def _bin_sums(df: DataFrame, by: list[str], p: Column, label: Column) -> DataFrame:
    hit = (argmax(p) == label).cast("int")
    return df.groupBy(*by, bin_of(F.array_max(p)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.sum(F.array_max(p)).alias("confidence"),
        F.sum(log_loss(label_probability(p, label))).alias("loss"), F.sum(brier(p, label)).alias("squared"))


def outcome_metrics(df: DataFrame, by: list[str], p: Column | None = None, label: Column | None = None) -> DataFrame:
    """n, accuracy, log loss, Brier sum and expected calibration error per group."""
    sums = _bin_sums(df, by, vector() if p is None else p, F.col("outcome") if label is None else label)
    n = F.sum("n")
    return sums.groupBy(*by).agg(
        n.alias("n"), (F.sum("hits") / n).alias("accuracy"), (F.sum("loss") / n).alias("log_loss"),
        (F.sum("squared") / n).alias("brier"), (F.sum(F.abs(F.col("hits") - F.col("confidence"))) / n).alias("ece"))


def reliability(df: DataFrame, by: list[str]) -> DataFrame:
    """Reliability table: one row per non-empty confidence bin."""
    sums = _bin_sums(df, by, vector(), F.col("outcome"))
    return sums.select(*by, "bin", "n", (F.col("confidence") / F.col("n")).alias("confidence"),
                       (F.col("hits") / F.col("n")).alias("accuracy"))


def binary_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Two-way metrics; p >= 0.5 counts as positive. An empty set gives n = 0 and nulls."""
    hit = ((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("int")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"),
        F.avg(binary_loss(F.col(y), F.col(p))).alias("log_loss"),
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


METRICS = ["accuracy", "log_loss", "brier", "ece"]


def metrics_by_seed(df: DataFrame, by: list[str]) -> DataFrame:
    """Seed-level metrics reduced to mean and min-max spread."""
    seeds = outcome_metrics(df, [*by, "seed"])
    return seeds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seeds"), *[F.avg(m).alias(f"{m}_mean") for m in METRICS],
        *[F.min(m).alias(f"{m}_min") for m in METRICS], *[F.max(m).alias(f"{m}_max") for m in METRICS])


def rate_bins(df: DataFrame, p: str, hit: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins of a predicted rate with the observed rate and its Wilson interval; empty bins are kept."""
    filled = df.groupBy(bin_of(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.avg(p).alias("mean_predicted"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    rows = every.join(filled, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"), "mean_predicted")
    low, high = wilson(F.col("hits"), F.col("n"))
    rate = F.when(F.col("n") > 0, F.col("hits") / F.col("n"))
    return rows.select("*", rate.alias("observed"), low.alias("low"), high.alias("high"))


def frequency_prior(df: DataFrame, by: list[str]) -> DataFrame:
    """Add-one outcome frequencies per group; baseball has no draw."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col("outcome") == i).alias(f"c{i}") for i in range(3)])
    weight = [F.col("c0") + 1, F.when(F.col("sport") == "baseball", 0).otherwise(F.col("c1") + 1), F.col("c2") + 1]
    total = weight[0] + weight[1] + weight[2]
    return counts.select(*by, *[(w / total).alias(n) for w, n in zip(weight, ("p_home", "p_draw", "p_away"))])


def ensemble(df: DataFrame, keys: list[str], members: int) -> DataFrame:
    """Mean probability of every outcome over exactly ``members`` seeds; other groups are left out."""
    rows = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("seed").alias("seeds"),
        *[F.avg(c).alias(c) for c in ("p_home", "p_draw", "p_away")])
    return rows.where((F.col("rows") == members) & (F.col("seeds") == members)).drop("rows", "seeds")


def common_sample(coverage: DataFrame, key: str, source: str) -> DataFrame:
    """Keys every source covers. ``coverage`` holds (key, source) pairs, repeats allowed."""
    pairs = coverage.select(key, source).distinct()
    sources = coverage.agg(F.count_distinct(source)).scalar()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == sources).select(key)


def fingerprint(ids: DataFrame, key: str) -> DataFrame:
    """Order-free digest of a unique id set, folded up a tree so that no row ever holds the whole set."""
    text = F.col(key).cast("string")
    leaves = ids.select(text.alias("id"), F.substring(F.md5(text), 1, 4).alias("b4"))

    def fold(df: DataFrame, by: list[str], value: str) -> DataFrame:
        digest = F.sha2(F.array_join(F.array_sort(F.collect_list(value)), ","), 256)
        return df.groupBy(*by).agg(digest.alias("d"), F.sum("n").alias("n"))

    quarter = fold(leaves.withColumn("n", F.lit(1)), ["b4"], "id")
    half = fold(quarter.withColumn("b2", F.substring("b4", 1, 2)).withColumn("d", F.concat("b4", "d")), ["b2"], "d")
    return fold(half.withColumn("d", F.concat("b2", "d")), [], "d").select(
        F.col("d").alias("fingerprint"), F.col("n").alias("ids"))


def coverage_check(left: DataFrame, right: DataFrame, key: str | list[str], attributes: list[str]) -> DataFrame:
    """One-to-one check of two tables; both sides collapse to one row per key before they meet."""
    keys = [key] if isinstance(key, str) else key

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"),
                                   *[F.min(a).alias(f"{name}_{a}") for a in attributes])

    both = side(left, "l").join(side(right, "r"), keys, "full_outer")
    differs = F.lit(False)
    for a in attributes:
        differs = differs | ~F.col(f"l_{a}").eqNullSafe(F.col(f"r_{a}"))
    state = (F.when(F.col("r_n").isNull(), "only_left").when(F.col("l_n").isNull(), "only_right")
             .when((F.col("l_n") > 1) | (F.col("r_n") > 1), "duplicate").when(differs, "mismatch").otherwise("matched"))
    return both.select(*keys, state.alias("state"))


def paired_differences(df: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """Loss(left) - loss(right) per (keys, seed) where both models scored the same event; no self join is needed."""
    loss = log_loss(label_probability(vector(), F.col("outcome")))
    pick = {m: F.col("model") == m for m in (left, right)}
    rows = df.where(F.col("model").isin(left, right)).groupBy(*keys, "seed").agg(
        F.max(F.when(pick[left], loss)).alias("left_loss"), F.max(F.when(pick[right], loss)).alias("right_loss"),
        F.max("start_time").alias("start_time"),
        (F.count_distinct("outcome", "start_time") == 1).alias("agreed"))
    return rows.where("left_loss is not null and right_loss is not null").select(
        *keys, "seed", "start_time", "agreed", (F.col("left_loss") - F.col("right_loss")).alias("difference"))


def seed_averaged(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.avg("difference").alias("difference"), F.max("start_time").alias("start_time"),
                                    F.count(F.lit(1)).alias("seeds"))


def select_model(candidates: DataFrame, by: list[str], eligible: Column, order: list[str]) -> DataFrame:
    """Best eligible candidate per group; later columns of ``order`` break ties."""
    rest = [c for c in candidates.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return candidates.where(eligible).groupBy(*by).agg(best).select(*by, "_b.*")
