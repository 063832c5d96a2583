"""Small dense solvers for grouped functions: bounded least squares, non-negative least squares."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nnls(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """min |A w - y| over w >= 0, from A'A and A'y: the active-set method of Lawson and Hanson."""
    n = len(rhs)
    w, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-10 * max(1.0, np.abs(rhs).max(initial=0.0))
    for _ in range(10 * n):
        grad = rhs - gram @ w
        grad[free] = -np.inf
        j = int(np.argmax(grad))
        if free.all() or grad[j] <= tol:
            break
        free[j] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], rhs[free], rcond=None)[0]
            if (trial[free] > 0).all():
                w = trial
                break
            down = free & (trial <= 0)
            step = np.min(w[down] / np.maximum(w[down] - trial[down], 1e-300))
            w = w + step * (trial - w)
            free &= w > 1e-14
            w[~free] = 0.0
            if not free.any():
                break
    return w


def unit_sum(w: np.ndarray) -> np.ndarray:
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def bounded_lsq(residuals: Callable[[np.ndarray], np.ndarray], x0: np.ndarray, low: np.ndarray, high: np.ndarray, evals: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Levenberg-Marquardt within bounds: steps are projected, and variables held at a bound are left out.

    ``evals`` bounds the residuals taken at trial points; those of the Jacobian's columns don't count."""
    x = np.clip(np.asarray(x0, float), low, high)
    r = residuals(x)
    cost, damp, used = r @ r, 1e-2, 1
    span = np.maximum(np.abs(x), 1e-3)
    while used < evals:
        jac = np.empty((len(r), len(x)))
        for k in range(len(x)):
            h = 1e-6 * max(span[k], abs(x[k]))
            h = -h if x[k] + h > high[k] else h
            moved = x.copy()
            moved[k] += h
            jac[:, k] = (residuals(moved) - r) / h
        grad = jac.T @ r
        held = ((x <= low) & (grad > 0)) | ((x >= high) & (grad < 0))
        move = ~held
        if not move.any() or np.abs(grad[move]).max() < tol * max(1.0, cost):
            break
        normal = jac[:, move].T @ jac[:, move]
        better = False
        for _ in range(12):
            step = np.linalg.lstsq(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), -grad[move], rcond=None)[0]
            trial = x.copy()
            trial[move] = np.clip(x[move] + step, low[move], high[move])
            tr = residuals(trial)
            used += 1
            if np.isfinite(tr).all() and tr @ tr < cost:
                gain, better = cost - tr @ tr, True
                x, r, cost, damp = trial, tr, tr @ tr, max(damp / 5, 1e-12)
                break
            damp *= 4
        if not better or gain < tol * cost:
            break
    return x
