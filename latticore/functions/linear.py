"""Small closed forms over columns: weighted means, 2 x 2 systems and principal directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def covariance(w: Column, su: Column, sv: Column, suv: Column) -> Column:
    """Covariance of u and v from their weighted sums."""
    return suv / w - (su / w) * (sv / w)


def solve2(a: Column, b: Column, d: Column, p: Column, q: Column, ok: Column) -> tuple[Column, Column]:
    """(x, y) of [[a, b], [b, d]] (x, y) = (p, q) by Cramer's rule; zeros where not ok."""
    det = a * d - b * b
    zero = F.lit(0.0)
    return F.when(ok, (p * d - q * b) / det).otherwise(zero), F.when(ok, (q * a - p * b) / det).otherwise(zero)


def well_posed(a: Column, b: Column, d: Column, share: float = 0.05) -> Column:
    """Whether [[a, b], [b, d]] is far from singular: its determinant against that of a circle of equal trace."""
    return a * d - b * b > share * (a + d) * (a + d) / 4


def principal(a: Column, b: Column, d: Column) -> Column:
    """Angle of the direction of largest scatter of the covariance [[a, b], [b, d]]."""
    return F.atan2(2 * b, a - d) / 2
