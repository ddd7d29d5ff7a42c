"""Many fits at once against direct solutions of the same objectives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.catalog.models import grid_rows
from augury.operators import models
from augury.operators.newton import Fit, Scale, expit, fit_many, score_many, softmax
from augury.plans.views import Tables

RNG = np.random.default_rng(4)
N, P = 1500, 4
X = RNG.normal(size=(N, P)) * [1, 3, 0.2, 1] + [0, 5, 0, 0]
Y = (RNG.random(N) < expit(X @ [0.7, -0.2, 2.0, 0.0] + 0.4)).astype(int)
Y3 = RNG.integers(0, 3, N) * (X[:, 0] > 0) + (X[:, 3] > 1)
Y3 = np.minimum(Y3, 2)
W = np.column_stack([np.ones(N), RNG.integers(0, 4, N)]).astype(float)
PART = np.where(np.arange(N) % 3 == 0, "a", "b")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(str(PART[i]), int(Y[i]), X[i].tolist(), W[i].tolist(), int(Y3[i])) for i in range(N)]
    return spark.createDataFrame(rows, "part string, y int, x array<double>, w array<double>, y3 int").repartition(5)


def gradient(z, y, w, beta, c, classes):
    """Gradient of c * sum(w * loss) + |b|^2 / 2 with a free intercept in the last column."""
    free = np.ones_like(beta)
    free[:, -1] = 0
    if classes == 2:
        return c * ((w * (expit(z @ beta[0]) - y)) @ z) + free[0] * beta[0]
    own = np.eye(classes)[y]
    return (c * ((w[:, None] * (softmax(z @ beta.T) - own)).T @ z) + free * beta).ravel()


def scales_of(part):
    own = X[PART == part]
    return Scale(own.mean(0), np.maximum(own.std(0), 0.01), 2.0)


def test_every_fit_solves_its_own_objective(table):
    scales = {p: scales_of(p) for p in "ab"}
    fits = [Fit((part, cols, c, w), part, cols, c, weight=w) for part in "ab" for cols in ((0, 1, 2, 3), (2, 0), (3,))
            for c in (1e-5, 0.01, 1.0, 1000.0) for w in (None, 1)]
    solved = fit_many(table, fits, scales)
    for f, s in zip(fits, solved):
        at = PART == f.part
        z = np.column_stack([scales[f.part].of(X[at])[:, list(f.columns)], np.ones(at.sum())])
        weight = np.ones(at.sum()) if f.weight is None else W[at, 1]
        assert s.converged and s.steps < 15
        assert np.abs(gradient(z, Y[at], weight, s.beta, f.c, 2)).max() < 1e-5 * max(1, f.c)


def test_multinomial_and_no_intercept(table):
    scales = {"a": scales_of("a")}
    rows = table.withColumn("y", F.col("y3"))
    three, plain = Fit((3,), "a", (0, 1, 3), 0.5, classes=3), Fit((2,), "a", (0, 3), 0.5, intercept=False)
    got = fit_many(rows, [three], scales)[0]
    at = PART == "a"
    z = np.column_stack([scales["a"].of(X[at])[:, [0, 1, 3]], np.ones(at.sum())])
    assert got.converged and np.abs(gradient(z, Y3[at], np.ones(at.sum()), got.beta, 0.5, 3)).max() < 1e-5
    one = fit_many(table, [plain], scales)[0]
    z = scales["a"].of(X[at])[:, [0, 3]]
    assert np.abs(0.5 * ((expit(z @ one.beta[0]) - Y[at]) @ z) + one.beta[0]).max() < 1e-5
    scored = score_many(rows, [three], [got], scales).first()
    p = softmax(np.column_stack([scales["a"].of(X[at])[:, [0, 1, 3]], np.ones(at.sum())]) @ got.beta.T)
    assert scored.n == at.sum() and scored.hits == (p.argmax(1) == Y3[at]).sum()
    assert scored.loss == pytest.approx(-np.log(p[np.arange(len(p)), Y3[at]]).sum())


def test_same_as_the_library(table):
    scales = {"a": Scale(np.zeros(P), np.ones(P))}
    ours = fit_many(table, [Fit((), "a", tuple(range(P)), 0.1)], scales)[0].beta[0]
    theirs = models.fit(table.where("part = 'a'"), F.col("x"), F.col("y"), 0.1, tol=1e-10)
    assert np.allclose(ours, [*theirs.coefficients, theirs.intercept], atol=1e-4)


def test_parts_without_rows_or_classes(spark, table):
    fits = [Fit(("none",), "z", (0,), 1.0), Fit(("one",), "a", (0,), 1.0)]
    got = fit_many(table.where("part = 'a' AND y = 1"), fits, {"a": scales_of("a"), "z": scales_of("a")}, most_passes=12)
    assert not got[0].converged and (got[0].beta == 0).all()
    assert np.isfinite(got[1].beta).all()
    assert fit_many(table.where("part = 'q'"), fits, {"a": scales_of("a")})[1].loss == 0


def test_whole_grid_and_selection(spark):
    """All 900 fits of the grid on the small tables; the choice is the smallest loss."""
    rows, configs = grid_rows(Tables(spark, "/root/testdata/sf0.01"))
    assert len(configs) == 30 and all(len(c) == 15 for c in configs.values())
    scores = models.grid(rows, configs, ["f1", "f2", "f3", "f4", "f5"], [0.00001, 0.0001, 0.001, 0.01, 0.1, 1.0]).collect()
    assert len(scores) == 180 and all(r.converged and r.folds == 5 for r in scores) and len({r.n for r in scores}) == 1
    best = models.select_from_grid(spark.createDataFrame(scores)).first()
    assert (best.log_loss, best.c, best.config) == min((r.log_loss, r.c, r.config) for r in scores)


def test_quality_interval_holds_its_quality(spark):
    schema = "game_id long, day date, y int, home_a double, away_a double, home_k double, away_k double"
    rows = [(i, f"2020-{1 + i % 12:02d}-{1 + i % 28:02d}", int(Y[i]), *map(float, X[i, :2]), float(i % 3 > 0), 1.0) for i in range(400)]
    table = spark.createDataFrame([(r[0], __import__("datetime").date.fromisoformat(r[1]), *r[2:]) for r in rows], schema)
    got = models.quality_interval(table, ["a"], [0.5], F.col("day"), F.col("y"), 0.1, 30, 7, "k").collect()
    assert len(got) == 400
    for r in got:
        assert r.home_low <= r.home_q <= r.home_high and r.away_low <= r.away_q <= r.away_high
        assert (r.home_low, r.home_high) == (0.0, 1.0) if r.game_id % 3 == 0 else r.home_high - r.home_low < 1
