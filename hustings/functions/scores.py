"""Scalar formulas of scoring: penalties, terms, turnout levels, softmax."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of latitude, the least share of its target a region may hold, and its price.
METRES_PER_DEGREE, FLOOR_SHARE, FLOOR_PRICE = 111_320.0, 0.2, 300_000.0


def segment_metres(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Length of a segment in degrees, at its middle's latitude."""
    across = (x2 - x1) * METRES_PER_DEGREE * F.cos(F.radians((y1 + y2) / 2))
    return F.hypot(across, (y2 - y1) * METRES_PER_DEGREE)


def clipped(x: Column, low: Column, high: Column, mean: Column, sd: Column, slack: float = 0.5) -> Column:
    """x held to its training range and half its width beyond, then standardised; a spread of 0 counts as 1."""
    held = F.least(F.greatest(x, low - slack * (high - low)), high + slack * (high - low))
    return (held - mean) / F.when(sd == 0, 1.0).otherwise(sd)


def softmax(scores: Column) -> Column:
    """Shares of an array of scores, safe for large ones."""
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def term(mode: str, x: Column, mean: Column, threshold: float = 0.5, steepness: float = 10.0, above: bool = True, cap: float = 1.0) -> Column:
    """What a region's value adds to the score: near the mean, far from it, or over a threshold."""
    if mode == "average":
        return (x - mean) * (x - mean)
    if mode == "extreme":
        held = F.least(F.abs(x - mean), F.lit(cap))
        return -held * held
    if mode == "gerrymander":
        by = (x - threshold) if above else (threshold - x)
        return 1 / (1 + F.exp(by * max(0.0, steepness)))
    return F.lit(0.0)


def floor_cost(people: Column, target: Column, share: float = FLOOR_SHARE) -> Column:
    """0 from the floor up; 1 and rising below it."""
    s = F.greatest(people / (target * share), F.lit(1e-6))
    return F.when(people >= target * share, 0.0).otherwise(1 + (1 - s) * (1 - s) / s)


def land_penalty(area: Column, sx: Column, sy: Column, sxx: Column, own: Column) -> Column:
    """Second moment of a region about its centre, 1 for a disc."""
    return F.when(area <= 0, 1.0).otherwise(2 * math.pi * (sxx - F.try_divide(sx * sx + sy * sy, area) + own) / F.nullif(area * area, F.lit(0.0)))


def people_penalty(people: Column, px: Column, py: Column, pxx: Column, area: Column) -> Column:
    """The same of where people live, beside the region's area."""
    return 2 * math.pi * F.try_divide(pxx - F.try_divide(px * px + py * py, people), people * area)


def turnout_level(size: Column, small: tuple[float, float], large: tuple[float, float]) -> Column:
    """Turnout at an electorate of `size`, between two anchors (electorate, level) on log scales, never beyond."""
    span = math.log(large[0]) - math.log(small[0])
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(size) - math.log(small[0])) / span))
    return F.exp(math.log(small[1]) + at * (math.log(large[1]) - math.log(small[1])))
