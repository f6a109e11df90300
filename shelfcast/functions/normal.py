"""Standard normal quantile as a column expression (Acklam's rational approximation, relative error 1.2e-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published coefficients of the approximation.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
SPLIT = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Value z with P(Z <= z) = p, for 0 < p < 1."""
    centre = p - 0.5
    square = centre * centre
    body = _horner(A, square) * centre / (_horner(B, square) * square + 1.0)

    def edge(tail: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.ln(tail))
        return _horner(C, q) / (_horner(D, q) * q + 1.0)

    return F.when(p < SPLIT, edge(p)).when(p > 1 - SPLIT, -edge(1.0 - p)).otherwise(body)
