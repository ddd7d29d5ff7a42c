"""Price expressions: validity, decimal prices and margin removal. Invalid prices give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def american_to_decimal(price: Column) -> Column:
    value = price.cast("double")
    return F.when(_finite(value) & (F.abs(value) >= 100),
                  1 + F.when(value > 0, value / 100).otherwise(100 / F.abs(value)))


def decimal_price(price: Column) -> Column:
    value = price.cast("double")
    return F.when(_finite(value) & (value > 1), value)


def to_decimal(price: Column, price_format: Column) -> Column:
    kind = F.lower(F.trim(price_format))
    return F.when(kind == "american", american_to_decimal(price)).when(kind == "decimal", decimal_price(price))


def devig_two_way(home: Column, away: Column) -> tuple[Column, Column]:
    """Proportional no-margin probabilities from two decimal prices."""
    total = 1 / home + 1 / away
    return (1 / home) / total, (1 / away) / total


def devig_draw(prices: Column) -> Column:
    """Normalised draw probability from three decimal prices; null unless all three are valid."""
    usable = (F.size(prices) == 3) & F.forall(prices, lambda x: F.coalesce(_finite(x) & (x > 1), F.lit(False)))
    implied = F.aggregate(prices, F.lit(0.0), lambda acc, x: acc + 1 / x)
    return F.when(usable, (1 / F.element_at(prices, 2)) / implied)
