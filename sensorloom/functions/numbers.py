"""Rounding and clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, places: int = 0) -> Column:
    """Round with halves toward plus infinity."""
    scale = float(10 ** places)
    scaled = value.cast("double") * scale + 0.5
    # floor() gives a long, which cannot hold NaN, the infinities or large values.
    whole = F.when(F.abs(scaled) < 9e15, F.floor(scaled).cast("double")).otherwise(value.cast("double") * scale)
    return whole / scale


def clamp_bounds(mean: Column, deviation: Column) -> tuple[Column, Column]:
    """Lower and upper bound: four deviations around the mean, not below zero."""
    return F.greatest(F.lit(0.0), mean - deviation * 4), mean + deviation * 4


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Keep a value inside its bounds; a null bound does not bind."""
    raised = F.when(low.isNotNull() & (value < low), low).otherwise(value)
    return F.when(high.isNotNull() & (raised > high), high).otherwise(raised)
