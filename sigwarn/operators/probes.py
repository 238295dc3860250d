"""Identifiability: how well a row's subject can be told from groups of its features, all probes trained together.

A probe is a multinomial logistic model of the subject on some of the features; each has a model per fold. Every pass over
the rows gives the gradients of all models of all probes, so a probe more costs a matrix product, not a job. The
curvature bound that the steps use is one matrix of products per fold, of which every probe takes its rows and columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwarn.functions import hash_order
from sigwarn.operators.folds import _matrix, _moments_of, _partial, _sum, _totals, fold_moments
from sigwarn.operators.prefix import numbered
from sigwarn.sources.results import stored

PASSES, TOLERANCE = 200, 1e-6


class Probes(NamedTuple):
    """Trained models: groups of feature places, subjects in order, means and deviations, weights by (group, fold), largest gradient per row."""

    groups: dict[str, list[int]]
    subjects: list
    folds: int
    mean: np.ndarray
    std: np.ndarray
    weights: dict[tuple[str, int], np.ndarray]
    gradient: float


def dealt(rows: DataFrame, folds: int, seed: str = "probe") -> DataFrame:
    """(subject_id, seq, features, fold), as a table: each subject's rows are dealt to the folds in turn, in hash order."""
    hashed = rows.select("subject_id", "seq", "features", hash_order(seed, F.col("subject_id"), F.col("seq")).alias("_h"))
    return stored(numbered(hashed, ["subject_id"], ["_h", "seq"]).select("subject_id", "seq", "features", (F.col("_n") % folds).cast("int").alias("fold"), F.lit("all").alias("pool")), "dealt")


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _design(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), (x - mean) / std], axis=1)


def train(rows: DataFrame, groups: dict[str, list[int]], folds: int = 3, strength: float = 1.0, passes: int = PASSES, tolerance: float = TOLERANCE) -> Probes:
    """Models of every group and fold, from all rows of dealt() outside the fold; penalised as on features standardised by its training rows.

    Steps are accelerated and use a bound of the curvature, half the products of the features, that holds for any number of
    subjects; they end when no gradient per row exceeds the tolerance. The driver holds the weights, subjects x features of a
    group, and the products of each fold, features x features.
    """
    subjects = sorted(r[0] for r in rows.select("subject_id").distinct().collect())
    found = fold_moments(rows.withColumn("label", F.lit(0)).withColumnRenamed("fold", "part")).collect()
    if len(subjects) < 2:
        return Probes(groups, subjects, folds, np.zeros(0), np.ones(0), {}, 0.0)
    moments = _moments_of([r["part"] for r in found], np.stack([np.asarray(r["v"]) for r in found]))
    _, _, mean, std = moments.without(None)
    std = np.where(std > 0, std, 1.0)
    width = len(mean) + 1
    place = {s: k for k, s in enumerate(subjects)}

    def products(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        z, fold = _design(_matrix(batch), mean, std), batch.column("fold").to_numpy()
        for f in np.unique(fold):
            yield (int(f),), (z[fold == f].T @ z[fold == f]).ravel()

    own = {r["fold"]: np.asarray(r["v"]).reshape(width, width) for r in _totals(_partial(rows, ["fold"], products, _sum), width**2).collect()}
    whole = sum(own.values())
    names = [(g, f) for g in groups for f in range(folds) if f in own]
    at = {g: np.array([0, *[k + 1 for k in places]]) for g, places in groups.items()}
    penalty, solve, n_train = {}, {}, {}
    for g, f in names:
        n_train[g, f], _, _, deviation = moments.without(moments.parts.index(f))
        penalty[g, f] = np.append(0.0, (np.where(deviation > 0, deviation, 1.0) / std) ** 2 / strength)[at[g]]
        solve[g, f] = np.linalg.pinv(0.5 * (whole - own[f])[np.ix_(at[g], at[g])] + np.diag(penalty[g, f]))
    shapes = [(len(subjects), len(at[g])) for g, _ in names]
    cuts = np.cumsum([0, *[a * b for a, b in shapes]])
    n_losses = len(names)

    def gradients(weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        def statistics(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
            z, fold = _design(_matrix(batch), mean, std), batch.column("fold").to_numpy()
            y = np.array([place[s] for s in batch.column("subject_id").to_pylist()], dtype=np.int64)
            out, losses = np.zeros(cuts[-1]), np.zeros(n_losses)
            for k, (g, f) in enumerate(names):
                learns = fold != f
                x, own_y = z[learns][:, at[g]], y[learns]
                p = _softmax(x @ weights[k].T)
                losses[k] = -np.log(np.maximum(p[np.arange(len(p)), own_y], 1e-300)).sum()
                p[np.arange(len(p)), own_y] -= 1
                out[cuts[k] : cuts[k + 1]] = (p.T @ x).ravel()
            yield ("all",), np.concatenate([losses, out])

        total = np.asarray(_totals(_partial(rows, ["pool"], statistics, _sum), n_losses + int(cuts[-1])).first()["v"])
        return total[:n_losses], [total[n_losses + cuts[k] : n_losses + cuts[k + 1]].reshape(s) for k, s in enumerate(shapes)]

    weights = [np.zeros(s) for s in shapes]
    before, speed, last, worst = weights, np.ones(n_losses), np.full(n_losses, np.inf), np.inf
    for _ in range(passes):
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead = [w + (s - 1) / t * (w - b) for w, b, s, t in zip(weights, before, speed, faster, strict=True)]
        losses, found = gradients(ahead)
        losses = losses + [0.5 * (penalty[name] * a * a).sum() for name, a in zip(names, ahead, strict=True)]
        found = [g + penalty[name] * a for g, name, a in zip(found, names, ahead, strict=True)]
        worst = max(float(np.abs(g).max()) / n_train[name] for g, name in zip(found, names, strict=True))
        before, weights = weights, [a - g @ solve[name] for a, g, name in zip(ahead, found, names, strict=True)]
        if worst <= tolerance:
            break
        # a model that got worse starts its acceleration anew
        speed = np.where(losses > last, 1.0, faster)
        last = losses
    return Probes(groups, subjects, folds, mean, std, dict(zip(names, weights, strict=True)), worst)


def recalls(rows: DataFrame, probes: Probes) -> DataFrame:
    """(probe, fold, subject_id, n, hits): held-out rows of each subject, and those that the fold's model gives to it."""
    kind = rows.schema["subject_id"].dataType.simpleString()
    names, subjects = list(probes.groups), probes.subjects
    place = {s: k for k, s in enumerate(subjects)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), probes.folds, len(subjects), 2), dtype=np.int64)
        for batch in batches:
            if not probes.weights:
                continue
            z, fold = _design(_matrix(batch), probes.mean, probes.std), batch.column("fold").to_numpy()
            y = np.array([place[s] for s in batch.column("subject_id").to_pylist()], dtype=np.int64)
            for i, g in enumerate(names):
                for f in np.unique(fold):
                    mine = fold == f
                    told = (z[mine][:, [0, *[k + 1 for k in probes.groups[g]]]] @ probes.weights[g, int(f)].T).argmax(axis=1)
                    np.add.at(counts[i, f, :, 0], y[mine], 1)
                    np.add.at(counts[i, f, :, 1], y[mine][told == y[mine]], 1)
        some = np.argwhere(counts[..., 0] > 0)
        columns = [pa.array([names[i] for i in some[:, 0]], pa.string()), pa.array(some[:, 1], pa.int32()), pa.array(some[:, 2], pa.int32()), *[pa.array(counts[tuple(some.T)][:, k] if len(some) else [], pa.int64()) for k in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, ["probe", "fold", "k", "n", "hits"])

    found = rows.mapInArrow(run, "probe string, fold int, k int, n long, hits long").groupBy("probe", "fold", "k").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    named = rows.sparkSession.createDataFrame(list(enumerate(subjects)), f"k int, subject_id {kind}")
    return found.join(F.broadcast(named), "k").select("probe", "fold", "subject_id", "n", "hits")  # a row per subject


def identifiability(told: DataFrame) -> DataFrame:
    """(probe, mean_acc, std_acc, chance, multiple_of_chance): balanced accuracies over folds of recalls(); std is the population's."""
    folds = told.groupBy("probe", "fold").agg(F.avg(F.col("hits") / F.col("n")).alias("acc"))
    chance = told.groupBy("probe").agg((1 / F.countDistinct("subject_id")).alias("chance"))
    out = folds.groupBy("probe").agg(F.avg("acc").alias("mean_acc"), F.stddev_pop("acc").alias("std_acc")).join(chance, "probe")
    return out.withColumn("multiple_of_chance", F.col("mean_acc") / F.col("chance"))
