"""Ordered decisions on shapes, cells and matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_class(ground: Column, obstacle: Column) -> Column:
    return F.when(ground == 0, "OBSTACLE").when(obstacle == 0, "GROUND").otherwise("MIXED")


def shape_class(width: Column, length: Column, height: Column, points: Column, upright: float) -> Column:
    """upright: least height over horizontal extent of a pole, 2.5 for components and 2.0 for groups."""
    wide, narrow = F.greatest(width, length), F.least(width, length)
    verticality = height / F.greatest(wide, F.lit(1e-6))
    return (
        F.when((height >= 1.5) & (verticality >= upright) & (width <= 1.5) & (length <= 1.5), "POLE")
        .when((height >= 1.0) & (wide >= 2.0) & (narrow <= 2.5), "WALL")
        .when(height.between(1.0, 3.5) & (width <= 5.0) & (length <= 8.0) & (points >= 20), "VEHICLE-LIKE")
        .otherwise("OBSTACLE")
    )


def graded(x: Column, high: float, low: float, strict: bool = False) -> Column:
    """0.25, 0.15 or 0.05."""
    over = (lambda v: x > v) if strict else (lambda v: x >= v)
    return F.when(over(high), 0.25).when(over(low), 0.15).otherwise(0.05)


def confidence(points: Column, cells: Column, max_height: Column, mean_height: Column, density: Column) -> Column:
    steady = F.when(max_height > 0, 0.25 * F.least(mean_height / max_height, F.lit(1.0))).otherwise(0.0)
    return F.least(graded(points, 20, 10) + graded(cells, 10, 5) + steady + graded(density, 50, 10, strict=True), F.lit(1.0))


def distance_bucket(d: Column) -> Column:
    return F.when(d < 10, "0-10").when(d < 25, "10-25").when(d < 50, "25-50").otherwise("50-100")


def motion_class(speed: Column, hits: Column, missed: Column) -> Column:
    return F.when((missed > 0) | (hits < 2), "UNCERTAIN").when(speed < 0.15, "STATIC").when(speed >= 0.5, "MOVING").otherwise("UNCERTAIN")


def traversability(cls: Column) -> Column:
    return F.when(cls == "GROUND", 0).when(cls == "MIXED", 1).otherwise(2)
