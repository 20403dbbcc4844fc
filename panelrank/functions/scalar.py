"""Row-level feature expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


def weekday_sin(date: Column) -> Column:
    return F.sin(weekday(date) * (2 * math.pi / 7))


def weekday_cos(date: Column) -> Column:
    return F.cos(weekday(date) * (2 * math.pi / 7))


def is_weekend(date: Column) -> Column:
    return (weekday(date) >= 5).cast("int")


def weekend_distance(date: Column) -> Column:
    """0 at the weekend, else days to the nearest weekend day."""
    day = weekday(date)
    ahead = F.pmod(5 - day, F.lit(7))
    behind = F.pmod(day - 6, F.lit(7))
    return F.when(day >= 5, 0).otherwise(F.least(ahead, behind))


def floored_ratio(a: Column, b: Column, floor: float = 0.001) -> Column:
    return F.when(b.isNotNull(), a / F.greatest(b, F.lit(floor)))


def level(mean: Column, low: float = 6.8, high: float = 7.2) -> Column:
    """0 below ``low``, 2 above ``high``, 1 between."""
    return F.when(mean < low, 0).when(mean > high, 2).otherwise(1)


def intensity(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def angle(a: Column, b: Column) -> Column:
    return F.atan2(a, b)


def quadrant(vertical: Column, horizontal: Column, dead: float = 0.1) -> Column:
    """1..4 counter-clockwise from both positive, 0 in the dead zone around the centre."""
    return (
        F.when((F.abs(vertical) < dead) & (F.abs(horizontal) < dead), 0)
        .when((horizontal >= 0) & (vertical >= 0), 1)
        .when((horizontal < 0) & (vertical >= 0), 2)
        .when((horizontal < 0) & (vertical < 0), 3)
        .otherwise(4)
    )


def positive_count(values: Sequence[Column]) -> Column:
    total = F.lit(0)
    for v in values:
        total = total + F.when(v > 0, 1).otherwise(0)
    return total


def entropy(values: Sequence[Column]) -> Column:
    """Shannon entropy (natural log) of the values' shares; 0 if nothing is positive."""
    clipped = [F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) for v in values]
    total = F.lit(0.0)
    for v in clipped:
        total = total + v
    result = F.lit(0.0)
    for v in clipped:
        share = F.try_divide(v, total)
        result = result - F.when(v > 0, share * F.ln(share)).otherwise(F.lit(0.0))
    return F.when(total > 0, result).otherwise(F.lit(0.0))


def balance(gain: Sequence[Column], cost: Sequence[Column]) -> Column:
    """Sum of one family over the sum of another plus one; missing counts as 0."""
    top, bottom = F.lit(0.0), F.lit(1.0)
    for v in gain:
        top = top + F.coalesce(v, F.lit(0.0))
    for v in cost:
        bottom = bottom + F.coalesce(v, F.lit(0.0))
    return top / bottom


def variation(mean: Column, std: Column, floor: float = 0.001) -> Column:
    """Spread over absolute mean, 0 for means near 0."""
    return F.when(F.abs(mean) > floor, std / F.abs(mean)).otherwise(F.lit(0.0))
