"""Numeric expressions whose null handling must be explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to a range and keep nulls null (``greatest`` and ``least`` alone would skip them)."""
    out = col
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(col.isNotNull(), out)


def finite(col: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """num / den where den > 0, else a fixed value."""
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise).cast("double"))


def cut(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(lo, hi]``; values outside every bin give null."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        inside = (col > lo) & (col <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def equal_width_bin(col: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number 0..bins-1 between low and high, the last bin closed; outside gives null."""
    raw = F.floor((col - low) / ((high - low) / F.lit(float(bins))))
    return F.when((col >= low) & (col <= high) & (high > low), F.least(raw, F.lit(bins - 1))).cast("int")


def tidy(col: Column, digits: int = 4) -> Column:
    """Round for comparison and turn negative zero into zero."""
    return F.round(col, digits) + F.lit(0.0)


def share(condition: Column) -> Column:
    """Percent of rows for which a condition holds; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def hits(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def hash_fraction(key: Column, seed: int) -> Column:
    """Stable pseudo-random fraction in [0, 1) from a key, the same on every engine that has MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
