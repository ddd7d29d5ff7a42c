"""Deterministic selections: hash ranking, interleaving, ranked slots, panel slices, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import hash_ranked, ranked


def hash_top(keys: DataFrame, key: str, items: DataFrame, item: str, n: int, salt: str) -> DataFrame:
    """The n items of every key with the smallest sha256(salt:key:item).

    Items are a declared vocabulary (a type list) of any length: it travels as one array, and every key folds over it
    keeping only its n best so far, so no scored list is ever held and nothing is joined.
    """
    listed = items.select(item).distinct().agg(F.array_sort(F.collect_list(item)).alias("items")).scalar()
    none = F.array().cast("array<struct<h: string, item: string>>")

    def better(best: Column, x: Column) -> Column:
        scored = F.struct(F.sha2(F.concat_ws(":", F.lit(salt), F.col(key), x), 256).alias("h"), x.alias("item"))
        return F.slice(F.array_sort(F.array_append(best, scored)), 1, n)

    best = F.aggregate(F.col("_items"), none, better)
    return keys.select(key, listed.alias("_items")).select(key, F.posexplode(best).alias("rank", "b")).select(
        key, (F.col("rank") + 1).alias("rank"), "b.item")


def interleave(rows: DataFrame, key: str, side: str, sides: list[str], salt: str) -> DataFrame:
    """Alternate the sides in hash order as far as the shorter side reaches."""
    coded = rows.where(F.col(side).isin(sides)).withColumn("_h", F.sha2(F.concat_ws(":", F.lit(salt), F.col(key)), 256))
    order = hash_ranked(coded, [side], "_h", [key], "_k")
    shortest = coded.groupBy(side).agg(F.count(F.lit(1)).alias("n")).agg(
        F.when(F.count(F.lit(1)) == len(sides), F.min("n")).otherwise(0)).scalar()
    place = F.lit(0)
    for number, name in enumerate(sides):
        place = F.when(F.col(side) == name, number).otherwise(place)
    return order.where(F.col("_k") <= shortest).select(
        ((F.col("_k") - 1) * len(sides) + place + 1).alias("position"), key, side)


def slot_assign(names: DataFrame, name: str, strength: str, features: int, span: float = 1.5) -> DataFrame:
    """Drop the weakest surplus names, then deal the rest in name order over features and evenly spaced centres."""
    total = names.agg(F.count(F.lit(1))).scalar()
    surplus = total % features
    per_feature = F.floor(total / features)
    by_strength = ranked(names, [], [F.col(strength), F.col(name)], "_s").where(F.col("_s") > surplus).drop("_s")
    by_name = ranked(by_strength, [], [F.col(name)], "_r").withColumn("_r", F.col("_r") - 1)
    place = F.floor(F.col("_r") / features)
    centre = F.when(per_feature > 1, -span + place * (2 * span) / (per_feature - 1)).otherwise(0.0)
    return by_name.select(name, strength, (F.col("_r") % features).cast("int").alias("feature"), centre.alias("centre"))


def panel_slice(rows: DataFrame, order: list[Column], key: str, offset: int, length: int, seeds: dict[str, int],
                conditions: list[str]) -> DataFrame:
    """Outcome-blind slice of an ordered list with its expected (seed set, condition) matrix; seeds derive from ids."""
    chosen = rows.orderBy(*order).offset(offset).limit(length)
    cells = F.array(*[F.struct(F.lit(s).alias("seed_set"), F.lit(k).cast("long").alias("salt"), F.lit(c).alias("condition"))
                      for s, k in seeds.items() for c in conditions])
    return chosen.select(key, F.inline(cells)).select(
        key, "seed_set", "condition", (F.col(key) * 1000 + F.col("salt")).alias("seed"))


def schedule_expand(items: DataFrame, item: str, cycles: int, retired_from: Column) -> DataFrame:
    """Every cycle an item takes part in; an item stops at the cycle it is retired from."""
    last = F.least(F.lit(cycles), F.coalesce(retired_from, F.lit(cycles))) - 1
    active = F.when(last >= 0, F.sequence(F.lit(0), last))
    return items.select(item, F.explode(active).alias("cycle"))
