"""Many L2 logistic fits at once by Newton steps.

One pass over the rows yields the loss, gradient and Hessian of every fit: tasks add up their own rows for all fits and
send one small array per fit, so a pass costs one shuffle of (tasks x fits) arrays however many fits there are. The steps
themselves are solved on the driver, from sums whose number is that of the fits and never that of the rows. Fits that
have converged take no part in further passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handled at a time inside a task.
SLICE = 4096


@dataclass(frozen=True)
class Fit:
    """One fit: which rows (``part``), which columns of x, and how strong the penalty is (as 1 / ``c``).

    ``weight`` is a place in the rows' weight array; without it every row counts once. More than two ``classes`` make the
    fit multinomial with one coefficient vector per class; two make it binary with one for class 1.
    """

    name: tuple
    part: str
    columns: tuple[int, ...]
    c: float
    intercept: bool = True
    weight: int | None = None
    classes: int = 2

    @property
    def vectors(self) -> int:
        return 1 if self.classes == 2 else self.classes

    @property
    def size(self) -> int:
        return len(self.columns) + self.intercept


@dataclass(frozen=True)
class Scale:
    """Centre and spread of every column for the rows of a part, and the bound of scaled values."""

    mean: np.ndarray
    spread: np.ndarray
    bound: float = np.inf

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -self.bound, self.bound)


@dataclass(frozen=True)
class Solution:
    """Coefficients (one line per vector, the intercept last where there is one) and how the fit ended."""

    beta: np.ndarray
    loss: float
    steps: int
    converged: bool


def design(z: np.ndarray, columns: tuple[int, ...], intercept: bool) -> np.ndarray:
    part = z[:, list(columns)]
    return np.hstack([part, np.ones((len(part), 1))]) if intercept else part


def softmax(eta: np.ndarray) -> np.ndarray:
    e = np.exp(eta - eta.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def expit(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(part, y, x, weights) of batches with columns part, y, x and w."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            rows = batch.slice(first, SLICE)
            flat = rows.column(2).flatten().to_numpy(zero_copy_only=False)
            w = rows.column(3)
            yield (np.array(rows.column(0).to_pylist(), dtype=object), rows.column(1).to_numpy(zero_copy_only=False),
                   flat.reshape(rows.num_rows, -1),
                   None if w.null_count else w.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1))


def binary_sums(z: np.ndarray, y: np.ndarray, weights: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper Hessian (a column per fit) of binary fits that share a design."""
    eta = z @ beta
    p = expit(eta)
    loss = (weights * (np.logaddexp(0, eta) - y[:, None] * eta)).sum(0)
    i, j = np.triu_indices(z.shape[1])
    return np.vstack([loss, z.T @ (weights * (y[:, None] - p)), (z[:, i] * z[:, j]).T @ (weights * p * (1 - p))])


def class_sums(z: np.ndarray, y: np.ndarray, weights: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The same of one multinomial fit: the gradient and Hessian blocks of its classes, one after the other."""
    eta = z @ beta.T
    p = softmax(eta)
    classes = len(beta)
    own = np.eye(classes)[y.astype(int)]
    loss = -(weights * np.log(np.maximum((p * own).sum(1), 1e-300))).sum()
    i, j = np.triu_indices(z.shape[1])
    zz = z[:, i] * z[:, j]
    blocks = [zz.T @ (weights * p[:, k] * ((k == m) - p[:, m])) for k in range(classes) for m in range(k, classes)]
    return np.concatenate([[loss], (z.T @ (weights[:, None] * (own - p))).T.ravel(), *blocks])


def square(upper: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = upper
    return np.triu(out) + np.triu(out, 1).T


def hessian(fit: Fit, values: np.ndarray) -> np.ndarray:
    n, k = fit.size, fit.vectors
    if k == 1:
        return square(values, n)
    out, blocks = np.zeros((k * n, k * n)), iter(np.split(values, k * (k + 1) // 2))
    for a in range(k):
        for b in range(a, k):
            block = square(next(blocks), n)
            out[a * n: (a + 1) * n, b * n: (b + 1) * n] = out[b * n: (b + 1) * n, a * n: (a + 1) * n] = block
    return out


def pass_over(rows: DataFrame, fits: list[Fit], betas: dict[int, np.ndarray], scales: dict[str, Scale]) -> dict[int, np.ndarray]:
    """Sums of the fits numbered in ``betas`` at their current coefficients."""
    groups: dict[tuple, list[int]] = {}
    for number in betas:
        f = fits[number]
        groups.setdefault((f.part, f.columns, f.intercept, f.classes), []).append(number)

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def add(number: int, values: np.ndarray) -> None:
            total[number] = total[number] + values if number in total else values

        for part, y, x, w in slices(batches):
            scaled: dict[str, tuple] = {}
            for name in set(part.tolist()) & set(scales):
                at = part == name
                scaled[name] = scales[name].of(x[at]), y[at].astype(float), None if w is None else w[at]
            for (name, columns, intercept, classes), numbers in groups.items():
                if name not in scaled:
                    continue
                z, own, weights = scaled[name]
                z = design(z, columns, intercept)
                each = [np.ones(len(z)) if fits[n].weight is None else weights[:, fits[n].weight] for n in numbers]
                if classes == 2:
                    sums = binary_sums(z, own, np.column_stack(each), np.column_stack([betas[n][0] for n in numbers]))
                    for n, values in zip(numbers, sums.T):
                        add(n, values)
                else:
                    for n, weight in zip(numbers, each):
                        add(n, class_sums(z, own, weight, betas[n]))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                                         names=["fit", "sums"])

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = values.values.to_numpy()
                total[number] = total[number] + values if number in total else values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                                         names=["fit", "sums"])

    schema = "fit int, sums array<double>"
    added = rows.select("part", "y", "x", "w").mapInArrow(local, schema).repartition("fit").mapInArrow(together, schema)
    return {r["fit"]: np.array(r["sums"]) for r in added.collect()}


def fit_many(rows: DataFrame, fits: list[Fit], scales: dict[str, Scale], most_passes: int = 60, tolerance: float = 1e-10) -> list[Solution]:
    """Minimise c * sum(weight * loss) + |coefficients|^2 / 2 for every fit; intercepts are not penalised.

    ``rows``: part (string), y (class number from 0), x (array of double, one length), w (array of double, or null). Rows
    of parts without a scale are ignored. A step that does not lower the objective is halved. A fit has converged once a
    full step would lower the objective by less than ``tolerance`` of it. A fit without any row keeps zeros.
    """
    beta = [np.zeros((f.vectors, f.size)) for f in fits]
    trial = {i: b for i, b in enumerate(beta)}
    best = [np.inf] * len(fits)
    step: dict[int, np.ndarray] = {}
    done: dict[int, Solution] = {}
    for passes in range(1, most_passes + 1):
        sums = pass_over(rows, fits, trial, scales)
        for i in list(trial):
            f = fits[i]
            penalised = np.ones((f.vectors, f.size))
            penalised[:, len(f.columns):] = 0
            if i not in sums:
                done[i] = Solution(beta[i], 0.0, passes, False)
                del trial[i]
                continue
            values, now = sums[i], trial[i]
            objective = f.c * values[0] + (penalised * now * now).sum() / 2
            if not objective <= best[i] + 1e-12 * abs(best[i]):
                step[i] = step[i] / 2
                trial[i] = beta[i] + step[i]
                continue
            beta[i], best[i] = now, objective
            size = f.vectors * f.size
            gradient = f.c * values[1: 1 + size] - (penalised * now).ravel()
            curve = f.c * hessian(f, values[1 + size:]) + np.diag(penalised.ravel())
            move = np.linalg.lstsq(curve, gradient, rcond=None)[0]  # class intercepts are free up to a common shift
            if gradient @ move / 2 <= tolerance * max(1.0, abs(objective)):
                done[i] = Solution(now + move.reshape(now.shape), objective, passes, True)
                del trial[i]
            else:
                step[i] = move.reshape(now.shape)
                trial[i] = now + step[i]
        if not trial:
            break
    return [done.get(i) or Solution(beta[i], best[i], most_passes, False) for i in range(len(fits))]


def score_many(rows: DataFrame, fits: list[Fit], solutions: list[Solution], scales: dict[str, Scale], floor: float = 1e-15) -> DataFrame:
    """(fit, n, loss, hits) over the rows of every fit's part, added up in the tasks first: log loss of the class that
    happened and whether the likeliest class (p of class 1 at 0.5 or more) is it."""
    by_part: dict[str, list[int]] = {}
    for i, f in enumerate(fits):
        by_part.setdefault(f.part, []).append(i)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part, y, x, _ in slices(batches):
            for name in set(part.tolist()) & set(by_part):
                at = part == name
                z, own = scales[name].of(x[at]), y[at].astype(int)
                for i in by_part[name]:
                    f, d = fits[i], design(z, fits[i].columns, fits[i].intercept)
                    if f.classes == 2:
                        p1 = expit(d @ solutions[i].beta[0])
                        p, hit = np.where(own == 1, p1, 1 - p1), (p1 >= 0.5) == (own == 1)
                    else:
                        every = softmax(d @ solutions[i].beta.T)
                        p, hit = every[np.arange(len(own)), own], every.argmax(1) == own
                    total[i] = total.get(i, 0) + np.array([len(own), -np.log(np.clip(p, floor, 1)).sum(), hit.sum()])
        sums = np.array(list(total.values())).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(sums[:, 0].astype(np.int64)),
                                          pa.array(sums[:, 1]), pa.array(sums[:, 2].astype(np.int64))], names=["fit", "n", "loss", "hits"])

    scored = rows.select("part", "y", "x", "w").mapInArrow(work, "fit int, n long, loss double, hits long")
    return scored.groupBy("fit").agg(*[F.sum(c).alias(c) for c in ("n", "loss", "hits")])
