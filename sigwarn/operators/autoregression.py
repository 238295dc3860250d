"""Vector autoregressions of batches of windows: one set of lag products serves every order, and each window is tested for rank.

A batch x has the axes window, channel, sample. A window whose lagged samples are linearly dependent (a flat channel, two
channels alike, too few samples) has no model: it is marked and its numbers are NaN, whatever the others in its batch are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

RIDGE = 1e-10
#: A channel that moves by no more than this share of its level is flat; what is left of it is rounding.
FLAT = 64 * np.finfo(float).eps


class Fit(NamedTuple):
    """Models of one order: coefficients (window, channel, lag * channel), residual covariance, whether there is a model."""

    order: int
    coef: np.ndarray
    cov: np.ndarray
    valid: np.ndarray


def lag_products(x: np.ndarray, most: int) -> np.ndarray:
    """Sums over samples t >= most of x[t - i] x[t - j]', axes window, i, j, channel, channel, for i and j up to most.

    Only the products of unshifted samples with every lag are sums over the window; shifting both by one sample
    changes a sum by the sample that comes in at the front and the one that falls out at the end.
    """
    w, n, length = x.shape
    out = np.empty((w, most + 1, most + 1, n, n))
    outer = lambda a, b: a[:, :, None] * b[:, None, :]
    for j in range(most + 1):
        out[:, 0, j] = x[:, :, most:] @ x[:, :, most - j : length - j].transpose(0, 2, 1)
    for i in range(1, most + 1):
        for j in range(i, most + 1):
            out[:, i, j] = out[:, i - 1, j - 1] + outer(x[:, :, most - i], x[:, :, most - j]) - outer(x[:, :, length - i], x[:, :, length - j])
    for i in range(1, most + 1):
        for j in range(i):
            out[:, i, j] = out[:, j, i].transpose(0, 2, 1)
    return out


def full_rank(gram: np.ndarray, scaled: bool) -> np.ndarray:
    """Whether the smallest eigenvalue of each symmetric matrix stands out from rounding; of those brought to a unit diagonal if asked for."""
    m, ok = gram.shape[-1], np.ones(len(gram), dtype=bool)
    if scaled:
        size = np.sqrt(np.maximum(np.einsum("wii->wi", gram), 0))
        ok = (size > 0).all(axis=1)
        size = np.where(size > 0, size, 1)
        gram = gram / size[:, :, None] / size[:, None, :]
    values = np.linalg.eigvalsh(gram)
    return ok & (values[:, 0] > values[:, -1] * m * np.finfo(float).eps)


def fits(x: np.ndarray, orders: list[int], ridge: float = RIDGE, scaled_test: bool = True) -> Iterator[Fit]:
    """Least-squares models of every order, from the highest to the lowest.

    Order p regresses samples t >= p on the p before. Lag products are summed once, for the highest order; each lower
    order adds the one sample more that it can use. `ridge` is added to the mean products before solving.

    The rank test takes the products at unit variance, so that it holds for microvolts as for millions; with
    scaled_test=False it takes the products with the ridge as they are, which lets dependent windows of small values pass.
    """
    w, n, length = x.shape
    known = np.isfinite(x).all(axis=(1, 2))
    x = np.where(known[:, None, None], x, 0.0)
    level = np.abs(x).max(axis=2, keepdims=True) if length else 0.0
    x = x - x.mean(axis=2, keepdims=True)
    x = np.where(np.abs(x).max(axis=2, keepdims=True, initial=0) > FLAT * level, x, 0.0)
    fitting = sorted({p for p in orders if length - p >= n * p + 1 and p >= 1}, reverse=True)
    for p in sorted(set(orders) - set(fitting), reverse=True):
        yield Fit(p, np.full((w, n, n * p), np.nan), np.full((w, n, n), np.nan), np.zeros(w, dtype=bool))
    if not fitting or not w:
        return
    sums = lag_products(x, fitting[0]).transpose(0, 1, 3, 2, 4).reshape(w, n * (fitting[0] + 1), n * (fitting[0] + 1))
    at = fitting[0]
    for p in fitting:
        while at > p:
            at -= 1
            front = x[:, :, at::-1].transpose(0, 2, 1).reshape(w, -1)
            sums = sums[:, : front.shape[1], : front.shape[1]] + front[:, :, None] * front[:, None, :]
        rows, m = length - p, n * p
        gram, cross = sums[:, n:, n:] / rows, sums[:, :n, n:] / rows
        ridged = gram + ridge * np.eye(m)
        valid = known & full_rank(gram if scaled_test else ridged, scaled_test)
        coef, cov = np.full((w, n, m), np.nan), np.full((w, n, n), np.nan)
        size = np.sqrt(np.einsum("wii->wi", ridged[valid]))
        unit = ridged[valid] / size[:, :, None] / size[:, None, :]
        coef[valid] = np.linalg.solve(unit, (cross[valid] / size[:, None, :]).transpose(0, 2, 1)).transpose(0, 2, 1) / size[:, None, :]
        rest = x[valid][:, :, p:].copy()
        for k in range(1, p + 1):
            rest -= coef[valid][:, :, n * (k - 1) : n * k] @ x[valid][:, :, p - k : length - k]
        cov[valid] = rest @ rest.transpose(0, 2, 1) / rows
        yield Fit(p, coef, cov, valid)


def autoregression(x: np.ndarray, order: int, ridge: float = RIDGE, scaled_test: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual covariance of one order; NaN for windows without a model."""
    fit = next(fits(x, [order], ridge, scaled_test), None)
    n = x.shape[1]
    return (fit.coef, fit.cov) if fit else (np.zeros((0, n, n * order)), np.zeros((0, n, n)))


def lags(coef: np.ndarray) -> np.ndarray:
    """Coefficients with the axes window, lag, to, from."""
    w, n, m = coef.shape
    return coef.reshape(w, n, m // n, n).transpose(0, 2, 1, 3)


def granger(x: np.ndarray, order: int, scaled_test: bool = True) -> np.ndarray:
    """Sum of absolute coefficients over lags."""
    return np.abs(lags(autoregression(x, order, scaled_test=scaled_test)[0])).sum(axis=1)


def signed_views(x: np.ndarray, order: int) -> np.ndarray:
    """Signed sum, absolute sum and first lag of the coefficients, and the mean absolute asymmetry of the absolute sum."""
    a = lags(autoregression(x, order)[0])
    views = np.stack([a.sum(axis=1), np.abs(a).sum(axis=1), a[:, 0]], axis=1)
    i, j = np.triu_indices(a.shape[-1], 1)
    uneven = np.abs(views[:, 1, i, j] - views[:, 1, j, i]).mean(axis=1)
    return np.concatenate([views.reshape(len(x), -1), uneven[:, None]], axis=1)


def order_criteria(x: np.ndarray, orders: list[int]) -> np.ndarray:
    """(log determinant, Akaike, Bayes, mean variance) of the residuals, axes window, order, number; NaN where an order has no model."""
    n, out = x.shape[1], np.full((len(x), len(orders), 4), np.nan)
    for fit in fits(x, orders):
        rows, free = x.shape[2] - fit.order, fit.order * n * n
        sign, log = np.linalg.slogdet(np.where(fit.valid[:, None, None], fit.cov, np.eye(n)) + 1e-12 * np.eye(n))
        log = np.where(fit.valid & (sign > 0), log, np.nan)
        out[:, orders.index(fit.order)] = np.stack([log, rows * log + 2 * free, rows * log + free * np.log(rows), np.trace(fit.cov, axis1=1, axis2=2) / n + 0 * log], axis=1)
    return out
