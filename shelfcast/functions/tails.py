"""Tail probabilities for the few summary rows a test produces.

Every function takes plain numbers. ``as_udf`` wraps one for use on result tables, which hold one row per
test and never one row per observation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return upper_gamma(df / 2.0, x / 2.0)


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a Pearson correlation."""
    if n <= 2:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def kolmogorov_p(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p."""
    x = d * math.sqrt(n1 * n2 / (n1 + n2))
    if x < 0.2:
        return 1.0
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, total))


def t_quantile(p: float, df: float) -> float:
    """Student t quantile by bisection on the tail."""
    if p == 0.5:
        return 0.0
    tail = 2 * min(p, 1 - p)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_two_sided(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return hi if p > 0.5 else -hi


def signed_rank_p(ranks: list[float], w_plus: float) -> float:
    """P(W+ >= w_plus) under the null, exact over all sign patterns of the given (possibly tied) ranks.

    Ranks are doubled so that half ranks stay integral; the table has one cell per reachable sum, so it
    grows with the square of the number of folds, which is about a dozen.
    """
    doubled = [round(2 * r) for r in ranks]
    ways = [1] + [0] * sum(doubled)
    for r in doubled:
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return sum(ways[round(2 * w_plus):]) / 2 ** len(ranks)


def as_udf(fn: Callable[..., float]):
    """Wrap a tail function as a null-safe UDF for result rows."""

    def guarded(*args):
        if any(a is None for a in args):
            return None
        out = fn(*args)
        return None if isinstance(out, float) and math.isnan(out) else out

    return F.udf(guarded, "double")
