"""Tail probabilities of the chi-square, t and F distributions; driver only."""

from __future__ import annotations

import math

_TINY = 1e-300


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series for P
        term = total = 1 / a
        n = a
        for _ in range(100_000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-17:
                break
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b or _TINY
        c = b + an / c or _TINY
        d = 1 / d
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + top / c
            c = c if abs(c) > _TINY else _TINY
            step = d * c
            h *= step
        if abs(step - 1) < 1e-16:
            break
    return h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi2_tail(x: float, dof: float) -> float:
    return gamma_q(dof / 2, x / 2)


def t_tail_both(t: float, dof: float) -> float:
    """Probability of |T| >= |t|."""
    if math.isinf(t):
        return 0.0
    return beta_i(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    return 1.0 if f <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def pearson_p(r: float, n: int) -> float:
    """Two-sided probability of a correlation as strong among n independent normal pairs."""
    if n < 3:
        return 1.0
    rest = (1 - r) * (1 + r)
    return 0.0 if rest <= 0 else beta_i(n / 2 - 1, 0.5, rest)
