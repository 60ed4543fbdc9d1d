"""Scalar expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
G_NEWTON = 6.674e-11


def tidy(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def finite(c: Column | str) -> Column:
    """The value, with NaN and infinities as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clip(c: Column, low, high) -> Column:
    """low..high; null stays null, which least and greatest alone would not keep."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def azimuth(c: Column, period: float = 360.0) -> Column:
    return F.pmod(c, F.lit(period))


def complex_tanh(a: Column, b: Column) -> tuple[Column, Column]:
    """tanh(a + ib) by real functions; beyond a = 20 it is 1."""
    down = F.cosh(2 * a) + F.cos(2 * b)
    return F.when(a > 20, 1.0).otherwise(F.sinh(2 * a) / down), F.when(a > 20, 0.0).otherwise(F.sin(2 * b) / down)


def hann(n: Column, size) -> Column:
    """Hann taper at sample n of size."""
    return 0.5 - 0.5 * F.cos(F.lit(TWO_PI) * n / (F.lit(size) - 1) if not isinstance(size, Column) else F.lit(TWO_PI) * n / (size - 1))


def solve3(m: list[list[Column]], v: list[Column]) -> list[Column]:
    """The solution of a 3 x 3 system by Cramer's rule; null where it is singular."""

    def det(a):
        return (
            a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
            - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
            + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
        )

    base = det(m)
    out = []
    for k in range(3):
        own = [[v[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]
        out.append(F.when(base != 0, det(own) / base))
    return out
