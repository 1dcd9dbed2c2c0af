"""A dense classification head trained by distributed minibatch gradients (V3): features -> 128 -> 32 -> classes.

Rectified layers with dropout, class-weighted cross entropy, AdamW, and early stopping on the macro F1 of the validation fold -
what MLlib's multilayer perceptron does not offer. All fits of a grid (parameter sets x folds) advance together: one Spark job
computes the gradients of one minibatch for every open fit, so a grid costs as many jobs as one fit. Rows stay in their
partitions. A task returns one row with the gradient sum of each fit; they are summed in two steps, by slice and by fit,
so no task adds up more than its share, and the driver holds parameters only (their size follows the features, not the rows).

A minibatch is the rows whose hash of (id, epoch) falls into the step's part; dropout masks follow from (id, epoch, layer), so a
task that is run again, or rows that are dealt otherwise, give the same gradient up to the order of a sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.operators.folds import FoldSets
from newslens.operators.validate import per_class_metrics

# --- fixed values: layers and training ------------------------------------------------------------------
HIDDEN = (128, 32)
EPOCHS, PATIENCE, WEIGHT_DECAY = 5, 2, 1e-4
DROPOUTS = (0.1, 0.3)
# --- end fixed values ------------------------------------------------------------------------------------
#: Step sizes for a head on fixed vectors; a network below it, tuned along, would take far smaller ones.
RATES = (1e-3, 3e-3)
#: Minibatches of an epoch: a batch is this share of the rows, however many they are.
STEPS = 8
_SLICES = 32


def layer_sizes(dim: int, classes: int, hidden: tuple[int, ...] = HIDDEN) -> list[tuple[int, int]]:
    sizes = [dim, *hidden, classes]
    return list(zip(sizes[:-1], sizes[1:]))


def initial(shapes: list[tuple[int, int]], seed: int) -> np.ndarray:
    """All weights and biases in one vector, uniform by fan-in."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes:
        bound = 1.0 / np.sqrt(max(a, 1))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def _layers(theta: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes:
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _mask(ids: np.ndarray, epoch: int, layer: int, width: int, rate: float, seed: int) -> np.ndarray:
    """Inverted dropout: 0 or 1 / (1 - rate) for each row and unit, from hashes."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
        x += np.uint64((seed * 1_000_003 + epoch * 1009 + layer * 31 + 7) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) / 2.0**53 >= rate) / (1.0 - rate)


def predict(theta: np.ndarray, shapes: list[tuple[int, int]], x: np.ndarray) -> np.ndarray:
    """Class scores of each row, without dropout."""
    layers = _layers(theta, shapes)
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return x


def gradient(theta: np.ndarray, shapes: list[tuple[int, int]], x: np.ndarray, y: np.ndarray, weight: np.ndarray,
             masks: list[np.ndarray] | None = None) -> tuple[np.ndarray, float, float]:
    """(summed gradient, summed loss, summed weight) of the weighted cross entropy over the rows."""
    layers = _layers(theta, shapes)
    inputs, h = [], x
    for i, (w, b) in enumerate(layers):
        inputs.append(h)
        h = h @ w + b
        if i < len(layers) - 1:
            h = np.maximum(h, 0.0)
            if masks is not None:
                h = h * masks[i]
    h = h - h.max(1, keepdims=True)
    total = np.exp(h).sum(1, keepdims=True)
    rows = np.arange(len(y))
    loss = float((weight * (np.log(total[:, 0]) - h[rows, y])).sum())
    delta = np.exp(h) / total
    delta[rows, y] -= 1.0
    delta *= weight[:, None]
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        w, _ = layers[i]
        parts = [(inputs[i].T @ delta).ravel(), delta.sum(0), *parts]
        if i:
            delta = delta @ w.T
            delta *= inputs[i] > 0  # a unit that dropout silenced is 0 as well
            if masks is not None:
                delta = delta * masks[i - 1]
    return np.concatenate(parts), loss, float(weight.sum())


@dataclass
class Fit:
    """One parameter set on one fold."""
    params: dict
    fold: int
    theta: np.ndarray
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)
    updates: int = 0
    best_f1: float = -1.0
    best_acc: float = 0.0
    best_classes: dict[int, float] = field(default_factory=dict)
    best_theta: np.ndarray | None = None
    stale: int = 0
    epochs: int = 0

    def __post_init__(self):
        self.first, self.second = np.zeros_like(self.theta), np.zeros_like(self.theta)

    def update(self, g: np.ndarray) -> None:
        """AdamW."""
        self.updates += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        step = (self.first / (1 - 0.9**self.updates)) / (np.sqrt(self.second / (1 - 0.999**self.updates)) + 1e-8)
        self.theta = self.theta - self.params["lr"] * (step + WEIGHT_DECAY * self.theta)


def _x(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, dim))


def _gradients(rows: DataFrame, fits: list[tuple[int, dict, int, np.ndarray]], shapes, epoch: int, seed: int) -> dict[int, tuple[np.ndarray, float]]:
    """number of a fit -> (mean gradient, mean loss) over the rows of its fold."""
    size = sum(a * b + b for a, b in shapes)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x, y, weight, ids = _x(part["x"], shapes[0][0]), part["label"].to_numpy(), part["weight"].to_numpy(), part["id"].to_numpy()
                for number, params, of, theta in fits:
                    if of == fold:
                        masks = [_mask(ids, epoch, i, b, params["dropout"], seed) for i, (_, b) in enumerate(shapes[:-1])]
                        g, loss, total = gradient(theta, shapes, x, y, weight, masks)
                        held = sums.setdefault(number, np.zeros(size + 2))
                        held[:size] += g
                        held[size:] += loss, total
        if sums:
            at = TaskContext.get().partitionId() % _SLICES
            yield pd.DataFrame({"fit": list(sums), "slice": [at] * len(sums), "g": [v.tobytes() for v in sums.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in pdf["g"]], axis=0)
        return pd.DataFrame({"fit": [pdf["fit"].iat[0]], "slice": [0], "g": [total.tobytes()]})

    schema = "fit int, slice int, g binary"
    found = rows.mapInPandas(partial, schema).groupBy("fit", "slice").applyInPandas(add, schema).groupBy("fit").applyInPandas(add, schema)
    out = {}
    for r in found.select("fit", "g").collect():  # one row for each fit
        v = np.frombuffer(r.g)
        out[r.fit] = (v[:size] / max(v[size + 1], 1e-300), v[size] / max(v[size + 1], 1e-300))
    return out


def predictions(rows: DataFrame, fits: list[tuple[int, int, np.ndarray]], shapes) -> DataFrame:
    """rows (fold, id, x, label) -> (fit, id, label, pred) for every fit (number, fold, theta) of the row's fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x = _x(part["x"], shapes[0][0])
                for number, of, theta in fits:
                    if of == fold:
                        yield pd.DataFrame({"fit": number, "id": part["id"], "label": part["label"], "pred": predict(theta, shapes, x).argmax(1)})

    return rows.mapInPandas(run, "fit int, id long, label int, pred int")


def scores(predicted: DataFrame) -> dict[int, tuple[float, float, dict[int, float]]]:
    """fit -> (accuracy, macro F1, F1 of each class) of (fit, label, pred) rows; the counts have a row for each fit and class."""
    out: dict[int, tuple[float, float, dict[int, float]]] = {}
    rows = per_class_metrics(predicted, by=["fit"]).collect()
    for fit in {r.fit for r in rows}:
        own = [r for r in rows if r.fit == fit]
        f1s = {r["class"]: r.f1 for r in own}
        out[fit] = (sum(r.tp for r in own) / max(1, sum(r.n for r in own)), sum(f1s.values()) / len(f1s), dict(sorted(f1s.items())))
    return out


def train_grid(sets: FoldSets, params: list[dict], epochs: int = EPOCHS, steps: int = STEPS, patience: int = PATIENCE, hidden: tuple[int, ...] = HIDDEN,
               seed: int = 42) -> list[Fit]:
    """Every parameter set on every fold, together; each keeps its best epoch by macro F1 on its validation fold."""
    shapes = layer_sizes(sets.dim, sets.classes, hidden)
    fits = [Fit(p, f, initial(shapes, seed)) for p in params for f in sets.folds]
    for epoch in range(epochs):
        open_ = [i for i, fit in enumerate(fits) if fit.stale < patience]
        if not open_:
            break
        dealt = sets.training.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(epoch)), F.lit(steps)))
        for step in range(steps):
            found = _gradients(dealt.filter(F.col("part") == step).select("fold", "id", "x", "label", "weight"),
                               [(i, fits[i].params, fits[i].fold, fits[i].theta) for i in open_], shapes, epoch, seed)
            for i, (g, _) in found.items():
                fits[i].update(g)
        judged = scores(predictions(sets.validation, [(i, fits[i].fold, fits[i].theta) for i in open_], shapes))
        for i in open_:
            fit = fits[i]
            fit.epochs += 1
            acc, f1, classes = judged.get(i, (0.0, 0.0, {}))
            if f1 > fit.best_f1:
                fit.best_f1, fit.best_acc, fit.best_classes, fit.best_theta, fit.stale = f1, acc, classes, fit.theta, 0
            else:
                fit.stale += 1
    return fits
