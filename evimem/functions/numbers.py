"""Column arithmetic used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(value: Column) -> Column:
    """Rounded to six places, the precision of reported numbers."""
    return F.round(value, 6)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0 or null."""
    return F.when(whole > 0, part / whole)


def days_between(later: Column, earlier: Column) -> Column:
    """Days from `earlier` to `later` as a fraction."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def wilson(positive: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share, null without observations."""
    p = positive / total
    d = 1 + z * z / total
    centre, half = p + z * z / (2 * total), z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)
    return F.when(total > 0, F.greatest(F.lit(0.0), (centre - half) / d)), F.when(total > 0, F.least(F.lit(1.0), (centre + half) / d))
