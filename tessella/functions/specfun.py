"""Special functions and distribution tails on the driver, for statistics that aggregates gave."""

from __future__ import annotations

import math

_TINY = 1e-300


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + term / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c = x + 1 - a, 1 / _TINY
    d = value = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * value


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + x * x))
    return tail if x < 0 else 1 - tail


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else betainc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def chi2_cdf(x: float, df: float) -> float:
    return gammainc(df / 2, x / 2)


def _quantile(cdf, p: float, low: float, high: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a quantile needs a probability between 0 and 1")
    while cdf(low) > p:
        low *= 2
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    return _quantile(normal_cdf, p, -1.0, 1.0)


def t_quantile(p: float, df: float) -> float:
    return _quantile(lambda x: t_cdf(x, df), p, -1.0, 1.0)


def chi2_quantile(p: float, df: float) -> float:
    return _quantile(lambda x: chi2_cdf(x, df), p, 0.0, df + 1.0)


def t_two_sided(t: float, df: float) -> float:
    """Probability of a t at least that far from 0."""
    return betainc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def f_upper(x: float, d1: float, d2: float) -> float:
    return 1 - f_cdf(x, d1, d2) if math.isfinite(x) else 0.0


def chi2_upper(x: float, df: float) -> float:
    return 1 - chi2_cdf(x, df)
