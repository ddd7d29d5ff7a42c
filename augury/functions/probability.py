"""Probability-vector expressions: validity, picks, losses, intervals, scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def vector(prefix: str = "p") -> Column:
    return F.array(F.col(f"{prefix}_home"), F.col(f"{prefix}_draw"), F.col(f"{prefix}_away"))


def argmax(p: Column) -> Column:
    """Zero-based position of the first largest value."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def valid_vector(p: Column, sport: Column, tolerance: float = 1e-5) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    in_range = F.forall(p, lambda x: F.coalesce((x >= 0) & (x <= 1) & ~F.isnan(x), F.lit(False)))
    return F.coalesce((F.size(p) == 3) & in_range & (F.abs(total - 1) <= tolerance)
                      & ((sport != "baseball") | (F.element_at(p, 2) == 0)), F.lit(False))


def label_probability(p: Column, label: Column) -> Column:
    return F.element_at(p, label + 1)


def log_loss(probability: Column) -> Column:
    return -F.log(F.least(F.greatest(probability, F.lit(FLOOR)), F.lit(1.0)))


def brier(p: Column, label: Column) -> Column:
    return reduce(lambda a, b: a + b, [
        F.pow(F.element_at(p, i + 1) - F.when(label == i, 1.0).otherwise(0.0), 2) for i in range(3)])


def binary_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(FLOOR)), F.lit(1 - FLOOR))
    return -(y * F.log(q) + (1 - y) * F.log1p(-q))


def bin_of(p: Column, bins: int = 10) -> Column:
    """Equal-width bin; the last bin includes one."""
    return F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int")


Z95 = 1.959963984540054


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """95 % score interval of a rate; null for an empty group."""
    rate, z = hits / n, Z95
    scale = 1 + z * z / n
    centre = (rate + z * z / (2 * n)) / scale
    radius = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / scale
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - radius)), F.when(some, F.least(F.lit(1.0), centre + radius))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(xs: list[Column], weights: list[float], bias: float = 0.0) -> Column:
    return reduce(lambda a, b: a + b, [x * float(w) for x, w in zip(xs, weights)], F.lit(float(bias)))


def masked_softmax(logits: list[Column], mask: list[Column]) -> list[Column]:
    """Softmax where a true mask gives probability zero."""
    open_logits = [F.when(~m, x) for x, m in zip(logits, mask)]
    top = F.greatest(*open_logits)
    weights = [F.coalesce(F.exp(x - top), F.lit(0.0)) for x in open_logits]
    total = reduce(lambda a, b: a + b, weights)
    return [w / total for w in weights]


def prior_adjusted(responses: list[Column], mean: list[float], scale: list[float], prior: list[float]) -> list[Column]:
    """Two-way probabilities: log prior minus the clipped standardised log1p response."""
    logits = [F.log(F.lit(p)) - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.log1p(r) - m) / s))
              for r, m, s, p in zip(responses, mean, scale, prior)]
    return masked_softmax(logits, [F.lit(False)] * len(logits))


def clip_scale(x: Column, mean: Column, std: Column, bound: float = 8.0, floor: float = 0.01) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), (x - mean) / F.greatest(std, F.lit(floor))))


def quality_key(q: Column, upper: Column, steps: int = 34) -> Column:
    """Half-up bucket of a quality in [0, 1]; the last key marks a confidently low quality."""
    return F.when(upper < 0.2, steps + 1).otherwise(F.floor(q * steps + 0.5)).cast("int")


def rest_scale(days: Column, transform: str) -> Column:
    """Rest transform; an unknown last day counts as zero."""
    if transform == "none":
        return F.lit(0.0)
    known = F.greatest(days, F.lit(0))
    value = F.least(known, F.lit(14)) / 14.0 if transform == "capped" else 1 - F.exp(-known / 3.0)
    return F.coalesce(value, F.lit(0.0))
