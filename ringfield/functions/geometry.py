"""Rings, cells and rigid transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringfield.config import RINGS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ring_level(x: Column | str, y: Column | str) -> Column:
    """0 to 3 by squared distance; null from the outer radius on."""
    d2 = col(x) * col(x) + col(y) * col(y)
    out = F.when(d2 < RINGS[0][1] ** 2, 0)
    for level, (_, hi, _) in enumerate(RINGS[1:], 1):
        out = out.when(d2 < hi**2, level)
    return out.cast("int")


def level_resolution(level: Column | str) -> Column:
    out = F.when(col(level) == 0, F.lit(RINGS[0][2]))
    for k, (_, _, size) in enumerate(RINGS[1:], 1):
        out = out.when(col(level) == k, F.lit(size))
    return out


def cell_index(v: Column | str, resolution: Column | str) -> Column:
    """floor(v / r): a product with 1 / r would round otherwise."""
    return F.floor(col(v) / col(resolution)).cast("long")


def cell_id(frame: str = "frame_id", level: str = "level", ix: str = "ix", iy: str = "iy") -> Column:
    """One number for a frame's cell: indices lie within 4096 of the origin."""
    return (F.col(frame) * 4 + F.col(level)) * 67108864 + (F.col(ix) + 4096) * 8192 + (F.col(iy) + 4096)


def centre(index: Column | str, resolution: Column | str) -> Column:
    return col(index) * col(resolution) + col(resolution) / 2


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Between two closed intervals; 0 where they meet."""
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def plane_elevation(a: Column, b: Column, c: Column, d: Column, x: Column, y: Column) -> Column:
    return F.when(F.abs(c) >= 1e-9, -(a * x + b * y + d) / c)


ROTATION = tuple(f"r{i}{j}" for i in range(3) for j in range(3))
SHIFT = ("t0", "t1", "t2")


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Rotation entries r00 to r22 of a quaternion, normalised first; a zero quaternion is an error."""
    n2 = w * w + x * x + y * y + z * z
    n = F.when(n2 > 0, F.sqrt(n2)).otherwise(F.raise_error(F.lit("zero quaternion")).cast("double"))
    w, x, y, z = w / n, x / n, y / n, z / n
    one, two = F.lit(1.0), F.lit(2.0)
    return {
        "r00": one - two * (y * y + z * z), "r01": two * (x * y - z * w), "r02": two * (x * z + y * w),
        "r10": two * (x * y + z * w), "r11": one - two * (x * x + z * z), "r12": two * (y * z - x * w),
        "r20": two * (x * z - y * w), "r21": two * (y * z + x * w), "r22": one - two * (x * x + y * y),
    }


def transformed(x: Column, y: Column, z: Column, prefix: str = "") -> tuple[Column, Column, Column]:
    """R p + t from columns prefix + r00 ... t2."""
    at = lambda n: F.col(prefix + n)
    return tuple(at(f"r{i}0") * x + at(f"r{i}1") * y + at(f"r{i}2") * z + at(f"t{i}") for i in range(3))


def inverse(prefix: str = "") -> dict[str, Column]:
    """Of a rigid pose: transposed rotation, and -R^T t."""
    at = lambda n: F.col(prefix + n)
    out = {f"r{i}{j}": at(f"r{j}{i}") for i in range(3) for j in range(3)}
    for i in range(3):
        out[f"t{i}"] = -(at(f"r0{i}") * at("t0") + at(f"r1{i}") * at("t1") + at(f"r2{i}") * at("t2"))
    return out


def composed(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """a after b."""
    out = {}
    for i in range(3):
        for j in range(3):
            out[f"r{i}{j}"] = a[f"r{i}0"] * b[f"r0{j}"] + a[f"r{i}1"] * b[f"r1{j}"] + a[f"r{i}2"] * b[f"r2{j}"]
        out[f"t{i}"] = a[f"r{i}0"] * b["t0"] + a[f"r{i}1"] * b["t1"] + a[f"r{i}2"] * b["t2"] + a[f"t{i}"]
    return out
