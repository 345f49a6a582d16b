"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(found: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of a share by Wilson's interval, within 0 and 1; the whole range where total is 0."""
    n = total.cast("double")
    p = found / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / scale
    low = F.when(total > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(total > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)
    return low, high


def clamp(value: Column, low: int, high: int) -> Column:
    """value, but low or high where it is beyond them; null stays null."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def percent(done: Column, target: Column) -> Column:
    """Share of a target in percent, 100 at most; 0 where there is no target."""
    return F.when(target > 0, F.least(F.lit(100.0), 100.0 * done / target)).otherwise(0.0)
