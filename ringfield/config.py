"""Fixed values that results depend on, and the parameters built from them."""

from __future__ import annotations

from dataclasses import dataclass

# Rings [lo, hi) in metres and their cell sizes.
RINGS = ((0.0, 10.0, 0.05), (10.0, 25.0, 0.10), (25.0, 50.0, 0.25), (50.0, 100.0, 0.50))
MAX_RANGE = 100.0

# Semantic ids and their names.
SEMANTIC_NAMES = {
    0: "unlabeled", 1: "outlier", 10: "car", 11: "bicycle", 13: "bus", 15: "motorcycle", 16: "on-rails",
    18: "truck", 20: "other-vehicle", 30: "person", 31: "bicyclist", 32: "motorcyclist", 40: "road",
    44: "parking", 48: "sidewalk", 49: "other-ground", 50: "building", 51: "fence", 52: "other-structure",
    60: "lane-marking", 70: "vegetation", 71: "trunk", 72: "terrain", 80: "pole", 81: "traffic-sign",
    99: "other-object", 252: "moving-car", 253: "moving-bicyclist", 254: "moving-person",
    255: "moving-motorcyclist", 256: "moving-on-rails", 257: "moving-bus", 258: "moving-truck",
    259: "moving-other-vehicle",
}
# Classes whose labelled instances count as objects (moving classes are left out).
GT_IDS = (10, 11, 13, 15, 16, 18, 20, 30, 31, 32)
# Classes whose cells form semantic objects.
OBJECT_IDS = (10, 11, 13, 15, 18, 20, 30, 31, 32, 50, 51, 52, 71, 80, 81, 99)
# Least points, cells and extent in metres of a semantic object, by class.
QUALITY = {
    10: (20, 2, 0.20), 11: (12, 2, 0.15), 13: (20, 2, 0.20), 15: (12, 2, 0.15), 18: (20, 2, 0.20), 20: (15, 2, 0.15),
    30: (10, 2, 0.15), 31: (10, 2, 0.15), 32: (10, 2, 0.15), 50: (30, 3, 0.30), 51: (15, 2, 0.20), 52: (20, 2, 0.20),
    71: (10, 2, 0.10), 80: (8, 2, 0.08), 81: (5, 2, 0.05), 99: (12, 2, 0.10),
}
QUALITY_DEFAULT = (8, 2, 0.05)
# Gap in metres up to which fragments of a class are merged.
MERGE_GAP = {50: 1.50, 51: 0.80, 52: 1.00, 71: 0.60, 80: 0.45, 81: 0.50}
MERGE_GAP_DEFAULT = 0.60
COMPATIBLE = {"vehicle": (10, 11, 13, 15, 18, 20), "person": (30, 31, 32), "structure": (50, 51, 52)}

# Labels that agree with a geometric class, labels of obstacles, and labels of surfaces.
PREFERRED = {"POLE": (71, 80, 81), "PERSON-LIKE": (30, 31, 32), "VEHICLE-LIKE": (10, 11, 13, 15, 16, 18, 20), "WALL": (50, 51, 52)}
OBSTACLE_LABELS = (10, 11, 13, 15, 16, 18, 20, 30, 31, 32, 50, 51, 52, 70, 71, 72, 80, 81, 99)
SURFACE_LABELS = (0, 1, 40, 44, 48, 49, 60)


@dataclass(frozen=True)
class Obstacles:
    min_height: float = 0.15
    min_points: int = 3
    radius: int = 20
    softening: float = 0.001


@dataclass(frozen=True)
class Tracking:
    max_distance: float = 3.0
    max_dimension_difference: float = 4.0
    weights: tuple[float, float, float] = (0.65, 0.25, 0.10)
    max_missed: int = 2
    confirm_hits: int = 2
    keep: float = 0.7
    moving_speed: float = 0.5
    noise_speed: float = 0.15
    streak: int = 3
    history: int = 8
    default_dt: float = 0.1


WORLD_HISTORY = 20
