"""Scalers and logistic models of many folds at once: statistics are summed per part, a fold is the whole less its own part.

Rows have `pool` (what a model may learn from), `part` (the fold that holds the row out; null: every fold learns from it),
`label` (0 or 1) and `features` (an array of doubles of one length, without nulls). Fold (pool, part) learns from the rows of
the pool outside the part and is tested on the part. Rows are never copied to the folds, and no fold has a job of its
own: each step is one pass over the rows for all folds of all pools. What comes to the driver are the coefficients of
each fold; matrices of a pool meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwarn.sources.results import stored

#: Statistics that a task holds before it hands them on, and tasks whose statistics meet first.
MOST_HELD, FAN_IN = 64, 64
#: Statistics of up to so many numbers are summed number by number, wider ones as whole lists in tasks.
WIDE = 10_000
#: Passes over the rows at most, and the gradient per row at which a model is done.
PASSES, TOLERANCE = 40, 1e-9


class Moments(NamedTuple):
    """Of each part of a pool: rows, rows of label 1, means and sums of squared deviations of the features."""

    parts: list
    n: np.ndarray
    positives: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    def without(self, k: int | None) -> tuple[float, float, np.ndarray, np.ndarray]:
        """(rows, positives, mean, population deviation) of all parts, or of all but part k."""
        n, mean = self.n.sum(), (self.n[:, None] * self.mean).sum(axis=0) / self.n.sum()
        m2 = (self.m2 + self.n[:, None] * (self.mean - mean) ** 2).sum(axis=0)
        if k is None:
            return n, self.positives.sum(), mean, np.sqrt(m2 / n)
        left = n - self.n[k]
        if not left:
            return 0, 0, mean, np.zeros_like(mean)
        rest = (n * mean - self.n[k] * self.mean[k]) / left
        m2 = m2 - self.m2[k] - self.n[k] * left / n * (self.mean[k] - rest) ** 2
        return left, self.positives.sum() - self.positives[k], rest, np.sqrt(np.maximum(m2, 0) / left)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("features")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """The place of each row's value among the distinct values, and these, the last one null."""
    told = column.dictionary_encode()
    return told.indices.fill_null(len(told.dictionary)).to_numpy(zero_copy_only=False), [*told.dictionary.to_pylist(), None]


def _groups(*columns: pa.Array) -> Iterator[tuple[tuple, np.ndarray]]:
    """(values, places) of equal rows of the columns; nulls are equal."""
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for code, values in map(_codes, columns):
        key = key * len(values) + code
    order = np.argsort(key, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(at):
            yield tuple(c[int(at[0])].as_py() for c in columns), at


def _folds_of(column: pa.Array, where: dict) -> np.ndarray:
    """The fold that holds each row out; -1 for none."""
    code, values = _codes(column)
    return np.array([where.get(v, -1) for v in values])[code]


def _partial(rows: DataFrame, keys: list[str], statistics: Callable[[pa.RecordBatch], Iterator[tuple[tuple, np.ndarray]]], merge: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, v): each key's statistics of the rows of a task."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out(schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], schema.field(c).type) for i, c in enumerate(keys)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(pa.float64()))], [*keys, "v"])

        for batch in batches:
            for key, v in statistics(batch):
                held[key] = merge(np.stack([held[key], v])) if key in held else v
            if len(held) >= MOST_HELD:
                yield out(batch.schema)
                held = {}
        if held:
            yield out(batch.schema)

    return rows.mapInArrow(run, f"{named}, v array<double>")


def _merged(partial: DataFrame, merge: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The statistics of each key merged over some tasks, then over all."""
    keys = [c for c in partial.columns if c != "v"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in partial.schema.fields)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1][keys].astype(object).assign(v=[merge(np.stack(frame["v"].to_list())).tolist()])

    some = partial.withColumn("_some", F.floor(F.spark_partition_id() / FAN_IN).cast("int"))
    return some.groupBy(*keys, "_some").applyInPandas(merged, schema).groupBy(*keys).applyInPandas(merged, schema)


def _sum(stack: np.ndarray) -> np.ndarray:
    return stack.sum(axis=0)


def _totals(partial: DataFrame, width: int) -> DataFrame:
    """The sums of each key."""
    if width > WIDE:
        return _merged(partial, _sum)
    keys = [c for c in partial.columns if c != "v"]
    each = partial.select(*keys, F.posexplode("v").alias("k", "x")).groupBy(*keys, "k").agg(F.sum("x").alias("x"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s")).select(*keys, F.transform("s", lambda e: e["x"]).alias("v"))


def _merged_moments(stack: np.ndarray) -> np.ndarray:
    """Rows (n, positives, means, squared deviations) as one."""
    d = (stack.shape[1] - 2) // 2
    n, mean, m2 = stack[:, :1], stack[:, 2 : 2 + d], stack[:, 2 + d :]
    whole = (n * mean).sum(axis=0) / n.sum()
    return np.concatenate([stack[:, :2].sum(axis=0), whole, (m2 + n * (mean - whole) ** 2).sum(axis=0)])


def fold_moments(rows: DataFrame) -> DataFrame:
    """(pool, part, v): rows, positives, means and squared deviations of each part, in one pass."""

    def statistics(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x, y = _matrix(batch), batch.column("label").to_numpy(zero_copy_only=False)
        for key, at in _groups(batch.column("pool"), batch.column("part")):
            mean = x[at].mean(axis=0)
            yield key, np.concatenate([[len(at), (y[at] == 1).sum()], mean, ((x[at] - mean) ** 2).sum(axis=0)])

    return _merged(_partial(rows.select("pool", "part", "label", "features"), ["pool", "part"], statistics, _merged_moments), _merged_moments)


def _moments_of(parts: list, stack: np.ndarray) -> Moments:
    d = (stack.shape[1] - 2) // 2
    return Moments(parts, stack[:, 0], stack[:, 1], stack[:, 2 : 2 + d], stack[:, 2 + d :])


def fold_scalers(rows: DataFrame) -> DataFrame:
    """(pool, part, n, mean, std): of the rows that fold (pool, part) learns from; std is the population's. Folds without such rows are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    whole = int if kinds["part"].endswith("int") else lambda x: x  # beside nulls pandas has numbers as floats

    def folds(frame: pd.DataFrame) -> pd.DataFrame:
        m, out = _moments_of(frame["part"].to_list(), np.stack(frame["v"].to_list())), []
        for k, part in enumerate(m.parts):
            n, _, mean, std = m.without(k)
            if not pd.isna(part) and n:
                out.append((frame["pool"].iloc[0], whole(part), int(n), mean.tolist(), std.tolist()))
        return pd.DataFrame(out, columns=["pool", "part", "n", "mean", "std"], dtype=object)

    return fold_moments(rows).groupBy("pool").applyInPandas(folds, f"pool {kinds['pool']}, part {kinds['part']}, n long, mean array<double>, std array<double>")


class _Pool(NamedTuple):
    """What all folds of a pool need: scale of the features, and per fold its part, class weights and penalties."""

    mean: np.ndarray
    std: np.ndarray
    parts: list
    weights: np.ndarray
    penalties: np.ndarray
    rows: np.ndarray


def _pools(moments: DataFrame, strength: float, least_train: int, least_test: int, both_tested: bool) -> dict:
    """{pool: _Pool}, the first "fold" being the pool as a whole, without a part. Folds that lack rows or a class are left out."""
    held: dict[object, list] = {}
    for r in moments.toLocalIterator():
        held.setdefault(r["pool"], []).append((r["part"], np.asarray(r["v"])))
    out = {}
    for pool, found in held.items():
        m = _moments_of([p for p, _ in found], np.stack([v for _, v in found]))
        n, p, mean, std = m.without(None)
        unit = np.where(std > 0, std, 1.0)
        parts, weights, penalties, rows = [], [], [], []
        for k in [None, *range(len(m.parts))]:
            size, pos, _, own = m.without(k)
            if k is not None:
                tested = m.positives[k] > 0 and m.positives[k] < m.n[k]
                if m.parts[k] is None or not 0 < pos < size or size < least_train or m.n[k] < least_test or (both_tested and not tested):
                    continue
            elif not 0 < pos < size:
                break
            parts.append(None if k is None else m.parts[k])
            weights.append((size / (2 * (size - pos)), size / (2 * pos)))
            penalties.append(np.append(0.0, (np.where(own > 0, own, 1.0) / unit) ** 2 / strength))
            rows.append(size)
        if len(parts) > 1:
            out[pool] = _Pool(mean, unit, parts, np.array(weights), np.array(penalties), np.array(rows))
    return out


def _inputs(x: np.ndarray, pool: _Pool) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), (x - pool.mean) / pool.std], axis=1)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses and probabilities of margins, from one exponential each."""
    e = np.exp(-np.abs(m))
    return np.log1p(e) + np.maximum(np.where(y == 1, -m, m), 0), np.where(m >= 0, 1.0, e) / (1 + e)


def _sigmoid(m: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(m))
    return np.where(m >= 0, 1.0, e) / (1 + e)


def _place(parts: list) -> dict:
    return {p: k for k, p in enumerate(parts) if k}


def _gradients(rows: DataFrame, pools: dict, coef: dict) -> dict:
    """{pool: (loss, gradient) of each fold at its coefficients}: one product of rows and coefficients for all folds of a pool."""

    def statistics(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x, y = _matrix(batch), (batch.column("label").to_numpy(zero_copy_only=False) == 1).astype(int)
        for (name,), at in _groups(batch.column("pool")):
            if name in pools:
                pool, where = pools[name], _place(pools[name].parts)
                z, own = _inputs(x[at], pool), _folds_of(batch.column("part"), where)[at]
                margin = z @ coef[name].T
                weight = pool.weights[:, y[at]].T.copy()
                weight[np.flatnonzero(own >= 0), own[own >= 0]] = 0
                loss, p = _logistic(margin, y[at][:, None])
                loss, gradient = (weight * loss).sum(axis=0), (weight * (p - y[at][:, None])).T @ z
                yield (name,), np.concatenate([loss[:, None], gradient], axis=1).ravel()

    partial = _partial(rows, ["pool"], statistics, _sum)
    sums = partial.select("pool", F.posexplode("v").alias("k", "v")).groupBy("pool", "k").agg(F.sum("v").alias("v")).toPandas()
    out = {name: np.zeros(len(pool.parts) * (coef[name].shape[1] + 1)) for name, pool in pools.items()}
    for name, own in sums.groupby("pool"):
        out[name][own["k"].to_numpy()] = own["v"].to_numpy()
    return {name: v.reshape(len(pools[name].parts), -1) for name, v in out.items()}


def _curvatures(rows: DataFrame, pools: dict, coef: dict) -> DataFrame:
    """(pool, part, label, v): sums of p (1 - p) z z' of each part and class at the whole pool's coefficients."""

    def statistics(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x = _matrix(batch)
        for (name, part, label), at in _groups(batch.column("pool"), batch.column("part"), batch.column("label")):
            if name in pools:
                z = _inputs(x[at], pools[name])
                p = _sigmoid(z @ coef[name])
                yield (name, part if part in _place(pools[name].parts) else None, int(label == 1)), ((p * (1 - p))[:, None] * z).T.dot(z).ravel()

    partial = _partial(rows.withColumn("label", F.col("label").cast("int")), ["pool", "part", "label"], statistics, _sum)
    return _totals(partial, next(iter(coef.values())).shape[0] ** 2)


def _own_curvatures(rows: DataFrame, pools: dict, coef: dict) -> DataFrame:
    """(pool, fold, v): the curvature of each fold at its own coefficients, without its penalty."""

    def statistics(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x, y = _matrix(batch), (batch.column("label").to_numpy(zero_copy_only=False) == 1).astype(int)
        for (name,), at in _groups(batch.column("pool")):
            if name in pools:
                pool, where = pools[name], _place(pools[name].parts)
                z, own = _inputs(x[at], pool), _folds_of(batch.column("part"), where)[at]
                p = _sigmoid(z @ coef[name].T)
                for k in range(len(pool.parts)):
                    weight = np.where(own == k, 0.0, pool.weights[k, y[at]] * p[:, k] * (1 - p[:, k]))
                    yield (name, k), ((weight[:, None] * z).T @ z).ravel()

    partial = _partial(rows.withColumn("fold", F.lit(0)), ["pool", "fold"], statistics, _sum)
    return _totals(partial, next(iter(coef.values())).shape[1] ** 2)


def _own_steps(curvatures: DataFrame, pools: dict, gradients: dict) -> dict:
    kind = curvatures.schema["pool"].dataType.simpleString()

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        name, k = frame["pool"].iloc[0], int(frame["fold"].iloc[0])
        gradient = gradients[name][k, 1:]
        h = np.asarray(frame["v"].iloc[0]).reshape(len(gradient), -1) + np.diag(pools[name].penalties[k])
        return pd.DataFrame({"pool": pd.Series([name], dtype=object), "fold": [k], "v": [np.linalg.lstsq(h, gradient, rcond=None)[0].tolist()]})

    out = {name: np.zeros((len(pool.parts), pool.penalties.shape[1])) for name, pool in pools.items()}
    for r in curvatures.groupBy("pool", "fold").applyInPandas(solve, f"pool {kind}, fold int, v array<double>").collect():
        out[r["pool"]][r["fold"]] = r["v"]
    return out


def _steps(curvatures: DataFrame, pools: dict, gradients: dict) -> dict:
    """{pool: a step of each fold}: its curvature is the sum of all parts less its own, weighted by its own class weights."""
    kind = curvatures.schema["pool"].dataType.simpleString()

    curvatures = curvatures.where(F.col("pool").isin(list(pools)))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["pool"].iloc[0]
        pool, gradient = pools[name], gradients[name][:, 1:]
        d, where = gradient.shape[1], _place(pool.parts)
        whole, own = np.zeros((2, d, d)), {}
        for part, label, v in zip(frame["part"].astype(object), frame["label"], frame["v"], strict=True):
            h = np.asarray(v).reshape(d, d)
            whole[label] += h
            if not pd.isna(part):
                own[where[part], label] = h
        out = []
        for k in range(len(pool.parts)):
            h = sum(pool.weights[k, c] * (whole[c] - own.get((k, c), 0)) for c in (0, 1)) + np.diag(pool.penalties[k])
            out.append(np.linalg.lstsq(h, gradient[k], rcond=None)[0])
        return pd.DataFrame({"pool": pd.Series([name], dtype=object), "v": [np.concatenate(out).tolist()]})

    found = curvatures.groupBy("pool").applyInPandas(solve, f"pool {kind}, v array<double>").collect()
    return {r["pool"]: np.asarray(r["v"]).reshape(len(pools[r["pool"]].parts), -1) for r in found}


class Models(NamedTuple):
    """Coefficients of every fold, the intercept first, on features as they come; gradients per row where fitting ended."""

    pools: dict
    coef: dict
    gradient: dict

    def table(self, rows: DataFrame) -> DataFrame:
        """(pool, part, intercept, coefficients)."""
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        out = []
        for name, pool in self.pools.items():
            for k, part in enumerate(pool.parts):
                if k:
                    raw = self.coef[name][k, 1:] / pool.std
                    out.append((name, part, float(self.coef[name][k, 0] - raw @ pool.mean), raw.tolist()))
        return rows.sparkSession.createDataFrame(out, f"pool {kinds['pool']}, part {kinds['part']}, intercept double, coefficients array<double>")


def fit_logistic(rows: DataFrame, strength: float = 1.0, least_train: int = 2, least_test: int = 1, both_tested: bool = False, passes: int = PASSES, tolerance: float = TOLERANCE) -> Models:
    """Logistic models with balanced class weights and a squared penalty on standardised coefficients, of every fold.

    First the model of each whole pool is fitted by Newton's steps. From there every fold starts: its curvature is the pool's
    less that of its own part, which no pass is needed for, its gradient is exact, from one pass for all folds. Such steps
    end at the fold's own optimum. Where they gain too little (a part that holds much of its pool), each fold's own
    curvature is summed. Scaling and class weights are the fold's own.

    Left out are pools and folds that would learn from one class, folds that learn from fewer than least_train rows or test fewer than
    least_test, and with both_tested those that test one class. `rows` is read once a pass: hand in a stored table.
    """
    rows = rows.select("pool", "part", "label", "features")
    pools = _pools(fold_moments(rows), strength, least_train, least_test, both_tested)
    if not pools:
        return Models({}, {}, {})
    width = len(next(iter(pools.values())).mean) + 1
    centre = {name: np.zeros(width) for name in pools}
    # the pools themselves: every fold's coefficients are the pool's, so the first row of gradients is the pool's
    whole = {name: pool._replace(parts=pool.parts[:1], weights=pool.weights[:1], penalties=pool.penalties[:1], rows=pool.rows[:1]) for name, pool in pools.items()}
    centre, _ = _descend(rows, whole, {name: c[None] for name, c in centre.items()}, passes, 1e-4)
    coef = {name: np.repeat(centre[name], len(pool.parts), axis=0) for name, pool in pools.items()}
    coef, gradient = _descend(rows, pools, coef, passes, tolerance)
    return Models(pools, coef, gradient)


def _descend(rows: DataFrame, pools: dict, coef: dict, passes: int, tolerance: float) -> tuple[dict, dict]:
    """The coefficients at which each fold's objective is least, and its gradient there.

    Steps are taken with the curvatures summed first for as long as they pay; pools where they don't get steps with
    each fold's own curvature. A step that makes a fold worse is taken back and halved.
    """
    at, best, tried = coef, {}, coef
    curvatures, size, share = None, {}, {name: np.ones(len(c)) for name, c in coef.items()}
    for _ in range(passes):
        found = _gradients(rows, pools, tried)
        moved, slow = {}, {}
        for name, pool in pools.items():
            value, c, before = found[name], tried[name], size.get(name)
            value[:, 0] += 0.5 * (pool.penalties * c * c).sum(axis=1)
            value[:, 1:] += pool.penalties * c
            worse = np.zeros(len(c), dtype=bool)
            if name in best:
                worse = value[:, 0] > best[name][:, 0] + 1e-9 * np.abs(best[name][:, 0])
                share[name] = np.where(worse, share[name] / 2, 1.0)
                value, c = np.where(worse[:, None], best[name], value), np.where(worse[:, None], at[name], c)
            best[name], moved[name] = value, c
            size[name] = np.abs(value[:, 1:]).max(axis=1) / pool.rows
            if before is not None and ((size[name] > tolerance) & (size[name] > 0.1 * before)).any():
                slow[name] = pool
        at = moved
        if all((g <= tolerance).all() for g in size.values()):
            break
        if curvatures is None:
            curvatures = stored(_curvatures(rows, pools, {name: c.mean(axis=0) for name, c in at.items()}), "curvatures")
        rest = {name: pool for name, pool in pools.items() if name not in slow}
        steps = _own_steps(_own_curvatures(rows, slow, {name: at[name] for name in slow}), slow, best) if slow else {}
        steps |= _steps(curvatures, rest, best) if rest else {}
        tried = {name: c - share[name][:, None] * steps[name] for name, c in at.items()}
    return at, size


def score(rows: DataFrame, models: Models) -> DataFrame:
    """The rows that a fold holds out, with `prob` by that fold's model; all columns but the features stay."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "features") + ", prob double"
    pools, coef = models.pools, models.coef

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, prob = _matrix(batch), np.full(len(batch), np.nan)
            for (name, part), at in _groups(batch.column("pool"), batch.column("part")):
                k = _place(pools[name].parts).get(part) if name in pools else None
                if k is not None:
                    prob[at] = _sigmoid(_inputs(x[at], pools[name]) @ coef[name][k])
            out = batch.drop_columns(["features"]).append_column("prob", pa.array(prob))
            yield out.filter(pa.array(np.isfinite(prob)))

    return rows.mapInArrow(run, kinds)
