"""Descriptors of square matrices that are stored row by row: a[i * n + j] is the weight from j to i."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = ("in_deg", "out_deg", "net_flow")
SCALARS = ("mean_off", "std_off", "max_off", "min_off", "mean_asym", "std_asym", "density", "spec_radius")
#: Largest singular values that are descriptors.
SINGULAR = 5


def names(channels: list[str], prefix: str = "") -> list[str]:
    """Names of the descriptors in order."""
    return [f"{prefix}{g}_{c}" for g in GROUPS for c in channels] + [prefix + s for s in SCALARS] + [f"{prefix}sv_{k}" for k in range(1, SINGULAR + 1)]


def describe(a: np.ndarray, normalise: bool = True) -> np.ndarray:
    """The descriptors of a batch of n x n matrices: sums of rows and columns without the diagonal, their difference, scalars, singular values.

    With normalise, a matrix is first divided by its Frobenius norm unless that is 1e-10 or less. Density is the share
    of other cells above half the largest one. Fewer than SINGULAR singular values are filled up with 0.
    """
    count, n = len(a), a.shape[1]
    if normalise:
        norm = np.sqrt((a * a).sum(axis=(1, 2)))
        a = a / np.where(norm > 1e-10, norm, 1.0)[:, None, None]
    diagonal = np.einsum("bii->bi", a)
    into, out = a.sum(2) - diagonal, a.sum(1) - diagonal
    off = a[:, ~np.eye(n, dtype=bool)] if n > 1 else np.zeros((count, 1))
    i, j = np.triu_indices(n, 1)
    asym = np.abs(a[:, i, j] - a[:, j, i]) if n > 1 else np.zeros((count, 1))
    top = off.max(1)
    density = (off > 0.5 * np.maximum(top, 1e-12)[:, None]).mean(1)
    radius = np.abs(np.linalg.eigvals(a)).max(1) if count else np.zeros(0)
    values = np.linalg.svd(a, compute_uv=False)[:, :SINGULAR] if count else np.zeros((0, SINGULAR))
    values = np.pad(values, ((0, 0), (0, SINGULAR - values.shape[1])))
    return np.concatenate([into, out, out - into, np.stack([off.mean(1), off.std(1), top, off.min(1), asym.mean(1), asym.std(1), density, radius], 1), values], axis=1)


def descriptors(a: Column, normalise: bool = True) -> Column:
    """The descriptors of a matrix as an array; null for a null, ragged or non-finite one. Matrices of a batch are worked on by size."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out, by_size = [None] * len(column), {}
        for k, v in enumerate(column):
            v = None if v is None else np.asarray(v, dtype=float)
            n = 0 if v is None else int(round(len(v) ** 0.5))
            if n and n * n == len(v) and np.isfinite(v).all():
                by_size.setdefault(n, []).append((k, v))
        for n, rows in by_size.items():
            found = describe(np.stack([v for _, v in rows]).reshape(-1, n, n), normalise)
            for (k, _), d in zip(rows, found, strict=True):
                out[k] = d.tolist()
        return pd.Series(out, dtype=object)

    return run(a)


def off_diagonal(a: Column, n: Column) -> Column:
    return F.filter(a, lambda x, k: F.floor(k / n) != k % n)


def asymmetry(a: Column, n: Column) -> Column:
    """|a_ij - a_ji| of all i < j, by row."""
    pairs = F.filter(F.sequence(F.lit(0).cast("int"), (n * n - 1).cast("int")), lambda k: F.floor(k / n) < k % n)
    return F.transform(pairs, lambda k: F.abs(F.get(a, k) - F.get(a, ((k % n) * n + F.floor(k / n)).cast("int"))))


def z_scores(values: Column, logarithm: bool = True) -> Column:
    """values, through log1p if asked for, less their mean, divided by their population deviation + 1e-8."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    named = lambda c, body: F.get(F.transform(F.array(c), body), F.lit(0))  # noqa: E731  c is worked out once
    x = F.transform(values, lambda v: F.log1p(v)) if logarithm else values
    centre = lambda x: named(total(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))
    scale = lambda c: named(F.sqrt(total(F.transform(c, lambda u: u * u)) / F.size(c)) + 1e-8, lambda d: F.transform(c, lambda v: v / d))
    return named(named(x, centre), scale)


def feature_groups(features: DataFrame, key: str, column: str, channels: int, bands: list[str] | None = None) -> DataFrame:
    """(key, band, part, place, value) of vectors of descriptors, one block of them per band: in_deg, out_deg, net_flow, scalars, singular."""
    bands = bands or [""]
    sizes = {**{g: channels for g in GROUPS}, "scalars": len(SCALARS), "singular": SINGULAR}
    width, parts = sum(sizes.values()), []
    for b, band in enumerate(bands):
        at = b * width
        for part, size in sizes.items():
            parts.append(F.struct(F.lit(band).alias("band"), F.lit(part).alias("part"), F.slice(column, at + 1, size).alias("_v")))
            at += size
    return features.select(key, F.inline(F.array(*parts))).select(key, "band", "part", F.posexplode("_v").alias("place", "value"))
