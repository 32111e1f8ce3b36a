"""Components of complete curves, splines and their derivatives, simultaneous bands."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np

from panelia.kernels.distributions import t_ppf


def trapezoid_weights(grid) -> np.ndarray:
    step = np.diff(np.asarray(grid, float))
    return np.concatenate([step, [0]]) / 2 + np.concatenate([[0], step]) / 2


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    phi: np.ndarray
    scores: np.ndarray
    weights: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def components(curves, grid, most: int = 4) -> Components:
    """Principal functions, orthonormal under the trapezoid integral; the entry of the largest size is positive."""
    y = np.asarray(curves, float)
    w = trapezoid_weights(grid)
    mean = y.mean(0)
    root = np.sqrt(w)
    _, d, v = np.linalg.svd((y - mean) * root, full_matrices=False)
    if (d**2).sum() <= 1e-12:
        raise ValueError("the curves don't vary")
    m = min(most, len(y) - 1, y.shape[1])
    phi = v[:m].T / root[:, None]
    phi *= np.sign(phi[np.abs(phi).argmax(0), np.arange(m)])
    return Components(mean, phi, (y - mean) @ (w[:, None] * phi), w, d[:m] ** 2 / (len(y) - 1), d[:m] ** 2 / (d**2).sum())


def principal_angle(a: np.ndarray, b: np.ndarray, weights: np.ndarray, k: int) -> float:
    """The largest angle (degrees) between the spaces of the first k functions."""
    s = np.linalg.svd(a[:, :k].T @ (weights[:, None] * b[:, :k]), compute_uv=False)
    return float(np.degrees(np.arccos(np.clip(s, 0, 1)).max()))


def reconstruction_errors(train: Components, curves, k: int) -> np.ndarray:
    """Weighted RMSE of each curve from the mean and the first k functions."""
    rest = np.asarray(curves, float) - train.mean
    phi = train.phi[:, :k]
    rest = rest - (rest @ (train.weights[:, None] * phi)) @ phi.T
    return np.sqrt(rest**2 @ train.weights / train.weights.sum())


def constant_errors(curves, weights: np.ndarray) -> np.ndarray:
    """Weighted RMSE of each curve about its own weighted mean."""
    y = np.asarray(curves, float)
    centre = y @ weights / weights.sum()
    return np.sqrt((y - centre[:, None]) ** 2 @ weights / weights.sum())


def match_axes(a: Components, b: Components) -> tuple[list[int], np.ndarray]:
    """The one-to-one order of b's functions that agrees best with a's, and the agreements."""
    inner = np.abs(a.phi.T @ (a.weights[:, None] * b.phi))
    best = max(permutations(range(inner.shape[1])), key=lambda p: inner[range(len(p)), p].sum())
    return list(best), inner[range(len(best)), best]


def spline_basis(t, low: float, high: float, size: int, degree: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Clamped B-splines with evenly spaced knots, and their derivatives, by the Cox-de Boor recursion."""
    t = np.asarray(t, float)
    if (t < low).any() or (t > high).any() or size < degree + 1:
        raise ValueError("times outside the boundaries, or too few functions")
    inner = np.linspace(low, high, size - degree + 1)
    knots = np.concatenate([[low] * degree, inner, [high] * degree])
    last = np.searchsorted(knots, high, side="left") - 1
    at = np.minimum(np.searchsorted(knots, t, side="right") - 1, last)
    table = (at[:, None] == np.arange(len(knots) - 1)).astype(float)
    below = table
    for d in range(1, degree + 1):
        below = table
        n = table.shape[1] - 1
        left = knots[d : d + n] - knots[:n]
        right = knots[d + 1 : d + 1 + n] - knots[1 : 1 + n]
        up = np.divide(t[:, None] - knots[:n], left, out=np.zeros((len(t), n)), where=left > 0)
        down = np.divide(knots[d + 1 : d + 1 + n] - t[:, None], right, out=np.zeros((len(t), n)), where=right > 0)
        table = up * table[:, :n] + down * table[:, 1 : n + 1]
    n = table.shape[1]
    left, right = knots[degree : degree + n] - knots[:n], knots[degree + 1 : degree + 1 + n] - knots[1 : 1 + n]
    slope = degree * (np.divide(below[:, :n], left, out=np.zeros((len(t), n)), where=left > 0) - np.divide(below[:, 1 : n + 1], right, out=np.zeros((len(t), n)), where=right > 0))
    return table, slope


@dataclass(frozen=True)
class SlopeCurve:
    """The slope of a common spline on whole minutes, with its jackknife errors and the people behind each minute."""

    grid: np.ndarray
    slope: np.ndarray
    error: np.ndarray
    support: np.ndarray
    people: np.ndarray

    def band(self, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
        """Bounds that hold at all minutes together, by Bonferroni's share of Student's t."""
        half = t_ppf(1 - alpha / (2 * len(self.grid)), len(self.people) - 1) * self.error
        return self.slope - half, self.slope + half


def normal_equations(x: np.ndarray, y: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Each person's sums of products of [x, y] with x."""
    out = np.zeros((n, x.shape[1], x.shape[1] + 1))
    np.add.at(out, code, x[:, :, None] * np.column_stack([x, y])[:, None, :])
    return out


def slope_curve(person, t, y, low: int, high: int, size: int = 10, least_people: int = 20, least_support: int = 10) -> SlopeCurve:
    """Least-squares spline over all people, its slope on low, low + 1, ..., high."""
    t, y = np.asarray(t, float), np.asarray(y, float)
    people, code = np.unique(np.asarray(person), return_inverse=True)
    grid = np.arange(low, high + 1, dtype=float)
    if not np.isfinite(y).all():
        raise ValueError("a value is not finite")
    if len(np.unique(np.column_stack([code, t]), axis=0)) < len(t):
        raise ValueError("a person has a minute twice")
    support = np.bincount(np.searchsorted(grid, t[np.isin(t, grid)]), minlength=len(grid))
    if len(people) < least_people or support.min() < least_support:
        raise ValueError("too few people")
    sums = normal_equations(spline_basis(t, low, high, size)[0], y, code, len(people))
    # the whole fit, then the fits without each person
    systems = sums.sum(0) - np.concatenate([np.zeros((1, size, size + 1)), sums])
    if (np.linalg.matrix_rank(systems[:, :, :size]) < size).any():
        raise ValueError("a fit has not full rank")
    slopes = np.linalg.solve(systems[:, :, :size], systems[:, :, size:])[:, :, 0] @ spline_basis(grid, low, high, size)[1].T
    return SlopeCurve(grid, slopes[0], np.sqrt((len(people) - 1) * slopes[1:].var(0)), support, people)


def simultaneous_band(design: np.ndarray, beta: np.ndarray, cov: np.ndarray, rng: np.random.Generator, draws: int = 5000, level: float = 0.95, df: float = np.inf) -> dict[str, np.ndarray | float]:
    """A band whose critical value is a quantile of the simulated greatest studentised deviation (normal or t)."""
    se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", design, cov, design), 0))
    if (se <= 0).any():
        raise ValueError("standard errors must be positive")
    value, vector = np.linalg.eigh(cov)
    z = rng.standard_normal((draws, len(beta))) * np.sqrt(np.maximum(value, 0)) @ vector.T
    if np.isfinite(df):
        z /= np.sqrt(rng.chisquare(df, draws) / df)[:, None]
    critical = float(np.quantile(np.abs(z @ design.T / se).max(1), level))
    estimate = design @ beta
    return {"estimate": estimate, "se": se, "lower": estimate - critical * se, "upper": estimate + critical * se, "critical": critical}
