"""Student's t and binomial distributions without scipy."""

from __future__ import annotations

import math


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_ppf(p: float, df: float) -> float:
    """The p-quantile, by bisection on the survival function."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    low, high = -1.0, 1.0
    while t_sf(low, df) < 1 - p:
        low *= 2
    while t_sf(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k)."""
    return 0.0 if k < 0 else 1.0 if k >= n else 1 - incomplete_beta(k + 1, n - k, p)


def rank_interval(n: int, p: float, gamma: float) -> tuple[int, int]:
    """Ranks (r, s) of order statistics that enclose the p-quantile but for gamma; 0 and n + 1 stand for no bound."""
    if n < 1 or not 0 < p < 1 or not 0 < gamma < 1:
        raise ValueError("n, p or gamma out of range")

    def least(test, low: int, high: int) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if test(mid) else (mid + 1, high)
        return low

    r = least(lambda k: binomial_cdf(k - 1, n, p) > gamma / 2, 0, n + 1) - 1
    s = least(lambda k: 1 - binomial_cdf(k - 1, n, p) <= gamma / 2, 1, n + 1)
    return max(r, 0), s
