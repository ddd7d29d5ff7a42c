"""Logistic models with the usual C parameter: fold grids, week-resampled ensembles and readouts.

Feature tables are written once (reliable checkpoint). All fits of a grid or an ensemble step together (``newton``): each
pass over the table serves every fit. A single fit can also go to Spark ML.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixtures import week_start
from ..functions.probability import FLOOR, sigmoid
from ..plans.session import stable
from .newton import Fit, Scale, expit, fit_many, score_many
from .resample import draw


def feature_array(names: list[str]) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names])


def train_scale(train: DataFrame, names: list[str], floor: float = 0.01) -> tuple[list[float], list[float]]:
    """Mean and floored population deviation of every column, from training rows only."""
    row = train.agg(*[F.avg(n) for n in names], *[F.greatest(F.stddev_pop(n), F.lit(floor)) for n in names]).first()
    return [float(v) for v in row[:len(names)]], [float(v) for v in row[len(names):]]


def scaled(names: list[str], mean: list[float], std: list[float], bound: float = 8.0) -> Column:
    cells = [F.greatest(F.lit(-bound), F.least(F.lit(bound), (F.col(n).cast("double") - m) / s))
             for n, m, s in zip(names, mean, std)]
    return F.array(*cells)


def fit(rows: DataFrame, x: Column, y: Column, c: float, intercept: bool = True, weight: Column | None = None,
        family: str = "auto", max_iter: int = 200, tol: float = 1e-6) -> LogisticRegressionModel:
    """L2 fit of sum(w * loss) * C + |beta|^2 / 2, which is Spark's mean-loss objective with 1 / (C * sum(w))."""
    data = rows.select(array_to_vector(x).alias("features"), y.cast("double").alias("label"),
                       (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")).where("w > 0")
    total = data.agg(F.sum("w")).first()[0]
    model = LogisticRegression(regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                               tol=tol, fitIntercept=intercept, weightCol="w", family=family)
    return model.fit(data)


def converged(model: LogisticRegressionModel, max_iter: int = 200) -> bool:
    return model.summary.totalIterations < max_iter


def positive(model: LogisticRegressionModel, x: Column) -> Column:
    """Probability of the positive class as a plain expression over the feature array."""
    weights = F.array(*[F.lit(float(v)) for v in model.coefficients])
    total = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return sigmoid(total + float(model.intercept))


def fit_rows(rows: DataFrame, part: Column, y: Column, names: list[str], weights: Column | None = None) -> DataFrame:
    """Rows in the form that many fits share: part, class number, columns, weights."""
    w = F.lit(None).cast("array<double>") if weights is None else weights
    return rows.select(part.alias("part"), y.cast("int").alias("y"), feature_array(names).alias("x"), w.alias("w"))


def part_scales(rows: DataFrame, width: int, floor: float = 0.01, bound: float = 8.0, centred: bool = True) -> dict[str, Scale]:
    """Mean and floored population deviation of every column by part, in one aggregate."""
    facts = rows.groupBy("part").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean"),
                                     F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(width)]).alias("spread"))
    return {r["part"]: Scale(np.array(r["mean"]) if centred else np.zeros(width), np.maximum(r["spread"], floor), bound)
            for r in facts.collect()}


def grid(features: DataFrame, configs: dict[str, list[str]], folds: list[str], c_values: list[float]) -> DataFrame:
    """Out-of-fold loss of every (config, C): scaled on fit rows, scored on evaluation rows, pooled over folds.

    ``features``: fold, role (fit / evaluation), y (0/1) and every named feature column. All configs x folds x C values
    are fitted together.
    """
    names = sorted({c for own in configs.values() for c in own})
    place = {n: i for i, n in enumerate(names)}
    rows = stable(features.where(F.col("fold").isin(folds)))
    train = fit_rows(rows.where("role = 'fit'"), F.col("fold"), F.col("y"), names)
    held = fit_rows(rows.where("role = 'evaluation'"), F.col("fold"), F.col("y"), names)
    scales = part_scales(train, len(names))
    fits = [Fit((config, c), fold, tuple(place[n] for n in own), c)
            for config, own in configs.items() for fold in folds if fold in scales for c in c_values]
    solved = fit_many(train, fits, scales)
    facts = [(i, *f.name, s.converged) for i, (f, s) in enumerate(zip(fits, solved))]
    named = rows.sparkSession.createDataFrame(facts, "fit int, config string, c double, converged boolean")
    return score_many(held, fits, solved, scales, FLOOR).join(named, "fit").groupBy("config", "c").agg(
        F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"), (F.sum("loss") / F.sum("n")).alias("log_loss"),
        (F.sum("hits") / F.sum("n")).alias("accuracy"), F.bool_and("converged").alias("converged"))


def select_from_grid(scores: DataFrame) -> DataFrame:
    """Lowest loss among converged candidates; smaller C, then the name, break ties."""
    return scores.where("converged").agg(
        F.min_by(F.struct("config", "c", "log_loss"), F.struct("log_loss", "c", "config")).alias("b")).select("b.*")


def week_weights(rows: DataFrame, day: Column, resamples: int, seed: int) -> DataFrame:
    """Per observed week, how often each resample draws it (array of ``resamples`` counts). Bounded by the calendar."""
    weeks = rows.select(week_start(day).alias("week")).distinct()
    numbered = weeks.select("week", (F.row_number().over(Window.partitionBy().orderBy("week")) - 1).alias("ix"))
    size = weeks.agg(F.count(F.lit(1)))
    draws = rows.sparkSession.range(resamples).select(F.col("id").alias("rep"), size.scalar().alias("size")).select(
        "rep", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("j"))
    drawn = draws.select("rep", draw(F.lit(seed), F.col("rep"), F.col("j"), F.col("size")).alias("ix"))
    counts = drawn.groupBy("ix").agg(*[F.count_if(F.col("rep") == r).alias(f"r{r}") for r in range(resamples)])
    joined = numbered.join(counts, "ix", "left")
    return joined.select("week", F.array(*[F.coalesce(f"r{r}", F.lit(0)).cast("double") for r in range(resamples)])
                         .alias("weights"))


def side_vectors(rows: DataFrame, columns: list[str], centre: list[float]) -> DataFrame:
    """game_id, home and away: the side's columns less their neutral values, so that an unknown team is near zero."""
    def side(name: str) -> Column:
        return F.array(*[F.col(f"{name}_{c}").cast("double") - m for c, m in zip(columns, centre)]).alias(name)
    return rows.select("game_id", side("home"), side("away"))


def quality_interval(rows: DataFrame, columns: list[str], centre: list[float], day: Column, y: Column, c: float, resamples: int,
                     seed: int, known: str | None = None) -> DataFrame:
    """Per event and side: quality in [0, 1] and its interval from week-resampled coefficient vectors.

    The main fit and all resamples are solved together. ``known`` names a side column that is 1 for a side with a full
    history; other sides get the interval [0, 1].
    """
    full = [F.lit(True) if known is None else F.coalesce(F.col(f"{s}_{known}") >= 1, F.lit(False)) for s in ("home", "away")]
    keyed = rows.select("game_id", F.array(*full).alias("_full"), week_start(day).alias("_week"), y.cast("int").alias("y"))
    weights = week_weights(keyed, F.col("_week"), resamples, seed)
    table = stable(side_vectors(rows, columns, centre).join(keyed, "game_id").join(
        weights.withColumnRenamed("week", "_week"), "_week"))
    delta = F.zip_with("home", "away", lambda h, a: h - a)
    train = table.select(F.lit("all").alias("part"), "y", delta.alias("x"), F.col("weights").alias("w"))
    width = len(columns)
    scales = part_scales(train, width, 1e-8, np.inf, centred=False)
    if not scales:
        return table.select("game_id", *[F.lit(None).cast("double").alias(f"{s}_{n}") for s in ("home", "away") for n in ("q", "low", "high")])
    every = tuple(range(width))
    fits = [Fit(("main",), "all", every, c), *[Fit((r,), "all", every, c, weight=r) for r in range(resamples)]]
    solved = [s.beta[0] for s in fit_many(train, fits, scales)]
    spread, roles = scales["all"].spread, {"home": 0.5, "away": -0.5}

    def main_score(side: str) -> Column:
        terms = F.zip_with(side, F.array(*[F.lit(float(b / s)) for b, s in zip(solved[0], spread)]), lambda v, b: v * b)
        return F.aggregate(terms, F.lit(roles[side] * float(solved[0][-1])), lambda a, v: a + v)

    both = table.select(F.explode(F.array(main_score("home"), main_score("away"))).alias("s"))
    middle, width_ = both.agg(F.avg("s"), F.greatest(F.stddev_pop("s"), F.lit(1e-8))).first()
    beta = np.array(solved)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(0)]
            for i, role in ((1, 0.5), (2, -0.5)):
                v = batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(spread)) / spread
                q = expit((v @ beta[:, :-1].T + role * beta[:, -1] - middle) / width_)
                low, high = np.quantile(q[:, 1:], [0.025, 0.975], axis=1)
                low, high = np.minimum(low, q[:, 0]), np.maximum(high, q[:, 0])
                sure = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)[:, i - 1]
                out += [pa.array(q[:, 0]), pa.array(np.where(sure, low, 0.0)), pa.array(np.where(sure, high, 1.0))]
            yield pa.RecordBatch.from_arrays(out, names=["game_id", *named])

    named = [f"{s}_{n}" for s in ("home", "away") for n in ("q", "low", "high")]
    return table.select("game_id", "home", "away", "_full").mapInArrow(
        work, "game_id long, " + ", ".join(f"{n} double" for n in named))


def array_quantile(ordered: Column, size: int, q: float) -> Column:
    """Linear quantile of a sorted array of known size."""
    position = q * (size - 1)
    low = int(position)
    high = min(low + 1, size - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (position - low)


def readout(rows: DataFrame, names: list[str], y: Column, train: Column, c: float, intercept: bool) -> DataFrame:
    """Fixed readout of one arm: scale on training rows, fit without (or with) intercept, return coefficients."""
    fitted = stable(fit_rows(rows.where(train), F.lit("train"), y, names))
    scales = part_scales(fitted, len(names), 1e-8, np.inf, centred=False)
    if not scales:
        return rows.sparkSession.createDataFrame([], "term string, coefficient double, scale double")
    beta = fit_many(fitted, [Fit(("readout",), "train", tuple(range(len(names))), c, intercept)], scales)[0].beta[0]
    out = [(n, float(w), float(s)) for n, w, s in zip(names, beta, scales["train"].spread)]
    out.append(("(intercept)", float(beta[-1]) if intercept else 0.0, 1.0))
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, scale double")


#: Outcomes a sport can have.
SPORT_CLASSES = {"soccer": [0, 1, 2], "baseball": [0, 2]}


def sport_readouts(rows: DataFrame, names: list[str], train: Column, c: float) -> DataFrame:
    """One readout per sport, three-way for soccer and two-way for baseball, scored on the held-out rows.

    Sports get equal total weight, so the busier one does not set the regularisation.
    """
    label = F.lit(None).cast("int")
    for sport, classes in SPORT_CLASSES.items():
        own = F.array_position(F.array(*[F.lit(k) for k in classes]), F.col("outcome")).cast("int") - 1
        label = F.when(F.col("sport") == sport, own).otherwise(label)
    data = stable(rows.select("*", label.alias("_label"), train.alias("_train")).where("_label >= 0"))
    sizes = {r["sport"]: r["count"] for r in data.where("_train").groupBy("sport").count().collect()}
    weight = F.lit(None).cast("double")
    for sport, n in sizes.items():
        weight = F.when(F.col("sport") == sport, F.lit(sum(sizes.values()) / (len(SPORT_CLASSES) * n))).otherwise(weight)
    fitted = fit_rows(data.where("_train"), F.col("sport"), F.col("_label"), names, F.array(weight))
    scales = part_scales(fitted, len(names))
    fits = [Fit((s,), s, tuple(range(len(names))), c, weight=0, classes=len(SPORT_CLASSES[s])) for s in sorted(scales)]
    solved = fit_many(fitted, fits, scales)
    scored = score_many(fit_rows(data.where("NOT _train"), F.col("sport"), F.col("_label"), names), fits, solved, scales, FLOOR)
    named = rows.sparkSession.createDataFrame([(i, f.part) for i, f in enumerate(fits)], "fit int, sport string")
    return scored.join(named, "fit").select("sport", "n", (F.col("loss") / F.col("n")).alias("log_loss"),
                                            (F.col("hits") / F.col("n")).alias("accuracy"))
