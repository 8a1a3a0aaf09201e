"""Circular statistics as Column expressions over angles in radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(angle: Column) -> Column:
    """The same angle between -pi and pi."""
    return F.atan2(F.sin(angle), F.cos(angle))


def circular_mean(angle: Column) -> Column:
    """Aggregate: direction of the summed unit vectors."""
    return F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))


def resultant_length(angle: Column) -> Column:
    """Aggregate: length of the mean unit vector."""
    return F.sqrt(F.pow(F.avg(F.sin(angle)), 2) + F.pow(F.avg(F.cos(angle)), 2))


def circular_mad(angle: Column, center: Column) -> Column:
    """Aggregate: median of the absolute wrapped differences from a center."""
    return F.median(F.abs(wrap(angle - center)))
