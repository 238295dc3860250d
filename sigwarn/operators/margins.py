"""Kernel margins of all left-out subjects at once.

Each fold has its own scaling, class weights and landmarks, as `models.kernel_margin` fitted on the other subjects has. Its
objective is solved by Newton's steps on a hinge that is rounded off ever less. A step is one pass over the rows for all
folds: tasks work out the kernel with the few landmarks anew and hand on sums, so rows are neither copied to folds nor
stored with their kernel. What comes to the driver is a gradient and a curvature of `size` numbers each way per fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwarn.functions import hash_order
from sigwarn.operators.folds import _folds_of, _matrix, _merged, _merged_moments, _partial, _sigmoid, _sum, fold_moments
from sigwarn.operators.models import kernel_map
from sigwarn.sources.results import stored

#: Half the width at which the hinge is rounded off, at first and in the end: the objective is off by a quarter of it at most.
WIDEST, NARROWEST = 0.5, 1e-3
#: Passes over the rows at most, and the gain of a further step at which a fold is done.
PASSES, TOLERANCE = 150, 1e-12
#: Shares of a step whose losses a pass works out, so that a step that goes too far is cut without more passes.
SHARES = np.array([1, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05, 0.02, 0.005])
#: Curvature that the offset has at least, as rows away from their margin give it none.
FLAT = 1e-3
#: Rows whose kernel a task holds.
BLOCK = 1024


class Fold(NamedTuple):
    """What the model that leaves out `part` starts from; `to` takes kernel values to features, weights are those of labels 0 and 1."""

    part: object
    mean: np.ndarray
    scale: np.ndarray
    landmarks: np.ndarray
    gamma: float
    to: np.ndarray
    weights: np.ndarray


class Move(NamedTuple):
    """Kernel weights and offset that a fold is at, the step from there, and half the width of its hinge."""

    at: np.ndarray
    step: np.ndarray
    half: float


def _kernel(x: np.ndarray, fold: Fold) -> np.ndarray:
    """Gaussian kernel of rows and landmarks, and a column of ones for the offset."""
    z, at = (x - fold.mean) * fold.scale, fold.landmarks
    out = np.ones((len(x), len(at) + 1))
    e = z @ (2 * fold.gamma * at.T)
    e -= (fold.gamma * (z * z).sum(axis=1))[:, None]
    e -= fold.gamma * (at * at).sum(axis=1)
    np.exp(np.minimum(e, 0, out=e), out=out[:, :-1])
    return out


def _drawn(rows: DataFrame, size: int) -> list:
    return [(r[0], np.array(r[1])) for r in rows.orderBy(hash_order("landmarks", F.col("part"), F.col("seq")), "part", "seq").limit(size).select("part", "features").collect()]


def folds(rows: DataFrame, size: int, gamma: float | None) -> list[Fold]:
    """The folds of rows(part, seq, label, features) that learn from both classes.

    Of the first 2 * size rows by hash, a fold's landmarks are the first `size` of other parts; only one part can hold more than half.
    """
    found = sorted(((r["part"], np.asarray(r["v"])) for r in fold_moments(rows.withColumn("pool", F.lit("all"))).collect()), key=lambda r: r[0])
    first, out = _drawn(rows, 2 * size), []
    for k, (part, _) in enumerate(found):
        others = [v for i, (_, v) in enumerate(found) if i != k]
        if not others:
            continue
        v = _merged_moments(np.stack(others))
        (n, p), d = v[:2], (len(v) - 2) // 2
        if not 0 < p < n:
            continue
        mean, std = v[2 : 2 + d], np.sqrt(v[2 + d :] / (n - 1))
        own = [x for s, x in first if s != part][:size]
        if len(own) < min(size, n):
            own = [x for _, x in _drawn(rows.where(F.col("part") != F.lit(part)), size)]
        varies = std > 1e-12 * np.abs(mean)  # the mean of equal numbers can be off by their last digit
        scale = np.where(varies, 1 / np.where(varies, std, 1), 0.0)
        at = (np.stack(own) - mean) * scale
        width = gamma if gamma is not None else 1 / max(d * at.var(), 1e-12)
        out.append(Fold(part, mean, scale, at, width, kernel_map(at, width), np.array([0.5 / (n - p), 0.5 / p])))
    return out


def _hinge(u: np.ndarray, half: float) -> np.ndarray:
    near = np.clip(1 + half - u, 0, 2 * half)
    return near * near / (4 * half) + np.maximum(1 - half - u, 0)


def _passed(rows: DataFrame, fits: list[Fold], moves: dict[int, Move]) -> dict[int, dict[int, np.ndarray]]:
    """{fold: {0: losses at all shares of its step and the gradient at its end, 1: the curvature there, if any}}."""
    place = {fold.part: k for k, fold in enumerate(fits)}
    open_ = {k: (fits[k], move) for k, move in moves.items()}

    def statistics(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x, label = _matrix(batch), batch.column("label").to_numpy(zero_copy_only=False).astype(int)
        own = _folds_of(batch.column("part"), place)
        for begin in range(0, len(x), BLOCK):
            at = slice(begin, begin + BLOCK)
            for k, (fold, move) in open_.items():
                here = own[at] != k
                if not here.any():
                    continue
                y, weight = 2.0 * label[at][here] - 1, fold.weights[label[at][here]]
                kernel = _kernel(x[at][here], fold)
                start, step = (kernel @ np.stack([move.at, move.step], axis=1)).T
                losses = [weight @ _hinge(y * (start + s * step), move.half) for s in SHARES]
                left = 1 + move.half - y * (start + step)
                yield (k, 0), np.concatenate([losses, -(weight * y * np.clip(left / (2 * move.half), 0, 1)) @ kernel])
                band = (left > 0) & (left < 2 * move.half)
                if band.any():
                    near = kernel[band]
                    yield (k, 1), (((weight[band] / (2 * move.half))[:, None] * near).T @ near).ravel()

    found: dict[int, dict[int, np.ndarray]] = {k: {} for k in moves}
    keyed = rows.select("part", "label", "features").withColumns({"fold": F.lit(0), "kind": F.lit(0)})
    for r in _merged(_partial(keyed, ["fold", "kind"], statistics, _sum), _sum).toArrow().to_batches():
        for i, (k, kind) in enumerate(zip(r.column("fold").to_pylist(), r.column("kind").to_pylist(), strict=True)):
            found[k][kind] = r.column("v")[i].values.to_numpy()
    return found


class _Search:
    """Newton's steps of one fold, in its features, the offset last."""

    def __init__(self, fold: Fold, regularised: float) -> None:
        wide = fold.to.shape[1]
        self.to = np.zeros((len(fold.to) + 1, wide + 1))
        self.to[:-1, :-1], self.to[-1, -1] = fold.to, 1
        self.penalty = np.append(np.full(wide, regularised), 0.0)
        self.at = self.step = np.zeros(wide + 1)
        self.half, self.value, self.slope, self.done = WIDEST, np.inf, 0.0, False

    def move(self) -> Move:
        return Move(self.to @ self.at, self.to @ self.step, self.half)

    def take(self, sums: np.ndarray, curvature: np.ndarray | None) -> None:
        """Goes to the step's end and plans the next, or cuts the step where it gains too little."""
        values = sums[: len(SHARES)] + [0.5 * self.penalty @ (self.at + s * self.step) ** 2 for s in SHARES]
        best = int(np.argmin(values))
        enough = values[0] <= self.value + 0.1 * self.slope or -self.slope <= TOLERANCE
        if not enough and not (best == 0 and values[0] < self.value):
            share = SHARES[best] if values[best] < self.value else SHARES[-1] / 4
            self.step, self.slope = share * self.step, share * self.slope
            return
        self.at, self.value = self.at + self.step, values[0]
        gradient = self.to.T @ sums[len(SHARES) :] + self.penalty * self.at
        h = np.diag(np.append(self.penalty[:-1], FLAT))
        if curvature is not None:
            h += self.to.T @ curvature.reshape(len(self.to), -1) @ self.to
        self.step = -np.linalg.solve(h, gradient)
        self.slope = float(gradient @ self.step)
        last = curvature is None or self.half <= NARROWEST  # without rows near their margin a narrower hinge is the same
        if -self.slope <= (TOLERANCE if last else 1e-2 * self.half):
            if last:
                self.done = True
            else:
                self.half, self.value = max(self.half / 4, NARROWEST), np.inf


class Models(NamedTuple):
    """The folds, and per fold the weights of the kernel with its landmarks, the offset last."""

    folds: list[Fold]
    weights: list[np.ndarray]
    searches: list[_Search]


def fit(rows: DataFrame, size: int = 256, gamma: float | None = None, regularised: float = 0.01, passes: int = PASSES) -> Models:
    """The margins of all parts' other rows; rows(part, seq, label, features) are read once a pass: hand in a stored table.

    Minimised is the mean hinge, classes weighing the same, plus half of regularised times the squared weights; the offset is
    free, and stays at its least change from 0 where many are as good. Rows with a label other than 0 and 1 aren't learned from.
    """
    rows = rows.where("label in (0, 1)")
    fits = folds(rows, size, gamma)
    searches = [_Search(fold, regularised) for fold in fits]
    for _ in range(passes):
        moves = {k: s.move() for k, s in enumerate(searches) if not s.done}
        if not moves:
            break
        for k, found in _passed(rows, fits, moves).items():
            searches[k].take(found[0], found.get(1))
    return Models(fits, [s.to @ s.at for s in searches], searches)


def score(rows: DataFrame, models: Models) -> DataFrame:
    """The rows that a fold holds out, with `prob`, its squashed margin; all columns but the features stay."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "features") + ", prob double"
    place, held = {fold.part: k for k, fold in enumerate(models.folds)}, list(zip(models.folds, models.weights, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, prob = _matrix(batch), _folds_of(batch.column("part"), place), np.zeros(len(batch))
            for begin in range(0, len(x), BLOCK):
                for k in set(own[begin : begin + BLOCK].tolist()) - {-1}:
                    at = begin + np.flatnonzero(own[begin : begin + BLOCK] == k)
                    prob[at] = _sigmoid(_kernel(x[at], held[k][0]) @ held[k][1])
            yield batch.drop_columns(["features"]).append_column("prob", pa.array(prob)).filter(pa.array(own >= 0))

    return rows.mapInArrow(run, kinds)


def leave_one_out(df: DataFrame, size: int = 256, gamma: float | None = None, regularised: float = 0.01) -> DataFrame:
    """(subject_id, seq, label, prob): each subject scored by a margin of all the others; empty if there is no fold."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where("subject_id is not null").select(F.col("subject_id").alias("part"), F.col("seq").cast("long").alias("seq"), F.col("label").cast("int").alias("label"), "features")
    table = stored(rows.repartition(tasks, "part", "seq"), "margins")
    return score(table, fit(table, size, gamma, regularised)).withColumnRenamed("part", "subject_id")
