"""Logistic regression by Newton steps on weighted cells, for many folds and penalties at once.

Rows with equal features, label and fold are one cell with a count. A first pass adds up moments per fold;
a model that leaves out a fold takes its means and spreads from the sums of the other folds. Then each Newton
step is one pass over the cells: a task turns its cells into gradient and Hessian sums of every model, a few
hundred numbers each, which are added up before they reach the driver. There the penalised quadratic is
solved by coordinate descent, which takes absolute penalties as well as square ones.

The penalty is ``strength * (mix * |b| + (1 - mix) / 2 * b**2)`` on coefficients of features scaled to a spread
of one, added to the mean loss. Unknown values count as the mean of the known ones. A feature without
spread gets no coefficient. Cells are written once, so a lost executor costs its own part of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import settled

_SUMS = "model int, place int, value double"


@dataclass(frozen=True)
class Wanted:
    """A model to fit: its penalty, and the fold it must not see (None: it sees all)."""

    strength: float = 0.0
    mix: float = 0.0
    left_out: int | None = None


@dataclass(frozen=True)
class Fit:
    """Coefficients on the plain features, and what an unknown value counts as."""

    names: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]
    means: tuple[float, ...]
    steps: int

    def score(self) -> Column:
        """The log odds of label 1 for a row."""
        parts = [F.coalesce(F.col(n), F.lit(m)) * F.lit(w) for n, w, m in zip(self.names, self.weights, self.means)]
        return sum(parts, F.lit(self.intercept))

    def scaled(self, lows: Sequence[float], highs: Sequence[float]) -> tuple[float, list[float]]:
        """Intercept and coefficients for features mapped to 0..1 between the given ends."""
        return self.intercept + sum(w * a for w, a in zip(self.weights, lows)), [w * (b - a) for w, a, b in zip(self.weights, lows, highs)]


def weighted_cells(rows: DataFrame, label: str, names: Sequence[str], fold: Column | None = None) -> DataFrame:
    """(fold, label, x, n): distinct rows of label and features with their number, written once."""
    x = F.array(*[F.col(n).cast("double") for n in names])
    keyed = rows.select((F.lit(0) if fold is None else fold).cast("int").alias("fold"), F.col(label).cast("double").alias("label"), x.alias("x"))
    return settled(keyed.groupBy("fold", "label", "x").agg(F.count("*").alias("n")))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """fold, label, n and the features, unknown ones as NaN."""
    fold, label, n = (batch[c].to_numpy().astype(float) for c in ("fold", "label", "n"))
    return fold, label, n, batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(n), -1)


def _told(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    models = np.repeat(list(sums), [len(v) for v in sums.values()]).astype(np.int32)
    places = np.concatenate([np.arange(len(v), dtype=np.int32) for v in sums.values()] or [np.zeros(0, np.int32)])
    values = np.concatenate([*sums.values(), np.zeros(0)])
    return pa.RecordBatch.from_arrays([pa.array(models, pa.int32()), pa.array(places), pa.array(values)], ["model", "place", "value"])


def _added(cells: DataFrame, work) -> dict[int, np.ndarray]:
    """Sums per model that the tasks give, added up by (model, place)."""
    found: dict[int, list] = {}
    for r in cells.mapInArrow(work, _SUMS).groupBy("model", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r.model, []).append((r.place, r.value))
    return {m: np.array([v for _, v in sorted(pairs)]) for m, pairs in found.items()}


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fold: rows, and per feature known rows, sum and sum of squares."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        fold, _, n, x = _arrays(batch)
        known = ~np.isnan(x)
        x = np.where(known, x, 0.0)
        for f in np.unique(fold).astype(int).tolist():
            w = np.where(fold == f, n, 0.0)
            mine = np.concatenate(([w.sum()], w @ known, w @ x, w @ (x * x)))
            sums[f] = sums.get(f, 0.0) + mine
    yield _told(sums)


def _slopes(models: list[tuple[int | None, np.ndarray, np.ndarray, np.ndarray]]):
    """Per model (fold left out, means, spreads, coefficients): gradient and Hessian sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, label, n, x = _arrays(batch)
            for m, (left_out, means, spreads, b) in enumerate(models):
                w = n if left_out is None else np.where(fold == left_out, 0.0, n)
                z = (np.where(np.isnan(x), means, x) - means) / np.where(spreads > 0, spreads, np.inf)
                z = np.column_stack((np.ones(len(z)), z))
                p = 1 / (1 + np.exp(-np.clip(z @ b, -700, 700)))
                mine = np.concatenate(((w * (p - label)) @ z, ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()))
                sums[m] = sums.get(m, 0.0) + mine
        yield _told(sums)

    return work


def descended(b: np.ndarray, slope: np.ndarray, curve: np.ndarray, strength: float, mix: float, most: int = 5000) -> np.ndarray:
    """The least of the penalised quadratic around b, one coordinate after another; the first has no penalty."""
    new = b.copy()
    flat, square = np.full(len(b), strength * mix), np.full(len(b), strength * (1 - mix))
    flat[0] = square[0] = 0.0
    for _ in range(most):
        moved = 0.0
        for j in range(len(b)):
            below = curve[j, j] + square[j]
            pull = curve[j, j] * new[j] - slope[j] - curve[j] @ (new - b)
            value = np.sign(pull) * max(abs(pull) - flat[j], 0.0) / below if below > 0 else 0.0
            moved, new[j] = max(moved, abs(value - new[j])), value
        if moved < 1e-13:
            break
    return new


def fitted(cells: DataFrame, names: Sequence[str], wanted: Sequence[Wanted], most_steps: int = 25, close: float = 1e-10) -> list[Fit]:
    """One fit for each wanted model, all of them in the same passes over the cells."""
    d = len(names)
    per_fold = _added(cells, _moments)
    if not per_fold:
        raise ValueError("there are no rows to learn from")
    state = []
    for m in wanted:
        sums = sum(v for f, v in per_fold.items() if f != m.left_out)
        if np.isscalar(sums):
            raise ValueError("a model has no rows to learn from")
        rows, known, total, squares = sums[0], sums[1 : d + 1], sums[d + 1 : 2 * d + 1], sums[2 * d + 1 :]
        means = total / np.maximum(known, 1)
        spreads = np.sqrt(np.maximum(squares - known * means**2, 0.0) / max(rows - 1, 1))
        # What is left of a constant by rounding is no spread.
        spreads[spreads <= 1e-9 * np.abs(means)] = 0.0
        state.append([m, rows, means, spreads, np.zeros(d + 1), 0, False])
    for _ in range(most_steps):
        open_ = [s for s in state if not s[6]]
        if not open_:
            break
        sums = _added(cells, _slopes([(s[0].left_out, s[2], s[3], s[4]) for s in open_]))
        for k, s in enumerate(open_):
            m, rows, b = s[0], s[1], s[4]
            new = descended(b, sums[k][: d + 1] / rows, sums[k][d + 1 :].reshape(d + 1, d + 1) / rows, m.strength, m.mix)
            s[4], s[5], s[6] = new, s[5] + 1, bool(np.abs(new - b).max() < close)
    fits = []
    for _, _, means, spreads, b, steps, _ in state:
        weights = np.divide(b[1:], spreads, out=np.zeros(d), where=spreads > 0)
        fits.append(Fit(tuple(names), float(b[0] - weights @ means), tuple(map(float, weights)), tuple(map(float, means)), steps))
    return fits


def predicted(rows: DataFrame, fit: Fit) -> DataFrame:
    """Rows with ``rawPrediction`` (both log odds) and ``prediction`` (0 or 1)."""
    score = fit.score()
    raw = array_to_vector(F.array(-score, score))
    return rows.withColumn("rawPrediction", raw).withColumn("prediction", F.when(score > 0, 1.0).otherwise(0.0))
