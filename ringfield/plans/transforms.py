"""Queries on chains of transforms: calibration, cameras, frames among each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield.functions import matrix
from ringfield.operators import poses
from ringfield.plans.motion import drives
from ringfield.plans.registry import query, rounded
from ringfield.plans.sql import d
from ringfield.plans.sql import query as q
from ringfield.plans.sql import rounded as r
from ringfield.sources.derived import STRIDE, points, sequence_id

# A camera beside the lidar of each drive: it looks along the lidar's x axis, and is mounted a little lower from drive to drive.
_S = "sequence_id % 4"
CALIBRATION = {
    "r00": "0", "r01": "-1", "r02": "0", "r10": "0", "r11": "0", "r12": "-1", "r20": "1", "r21": "0", "r22": "0",
    "t0": "0.125", "t1": f"({_S}) * 0.0625 - 0.25", "t2": "-0.5",
}
MOUNTED = f"SELECT sequence_id, {', '.join(f'{d(v)} AS {k}' for k, v in CALIBRATION.items())} FROM (SELECT DISTINCT frame_id // {STRIDE} AS sequence_id FROM poses)"


def calibrations(spark, sf_dir):
    return drives(spark, sf_dir).select("sequence_id").distinct().select("sequence_id", *[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in CALIBRATION.items()])


def worlds(spark, sf_dir):
    return poses.calibrated(drives(spark, sf_dir), calibrations(spark, sf_dir))


def _dot(a: str, b: str, i: int, j: int) -> str:
    """Entry (i, j) of a product of rigid transforms whose columns are prefixed a and b."""
    terms = " + ".join(f"{a}r{i}{k} * {b}{f'r{k}{j}' if j < 3 else f't{k}'}" for k in range(3))
    return f"{terms} + {a}t{i}" if j == 3 else terms


def _name(i: int, j: int) -> str:
    return f"r{i}{j}" if j < 3 else f"t{i}"


TWELVE = [(i, j) for i in range(3) for j in range(4)]
NAMES = [_name(i, j) for i, j in TWELVE]
_SIDE = lambda t, p: ", ".join(f"{t}.{n} AS {p}{n}" for n in NAMES)
SQL = {
    "mounted": MOUNTED,
    "worlds": f"SELECT frame_id, sequence_id, {', '.join(f'{_dot("a", "b", i, j)} AS {_name(i, j)}' for i, j in TWELVE)} FROM (SELECT p.frame_id, m.sequence_id, {_SIDE('p', 'a')}, {_SIDE('m', 'b')} FROM poses p JOIN mounted m ON m.sequence_id = p.frame_id // {STRIDE})",
}
# inverse of a rigid transform: transposed rotation, and the shift turned back
_BACK = {_name(i, j): f"r{j}{i}" if j < 3 else "-(" + " + ".join(f"r{k}{i} * t{k}" for k in range(3)) + ")" for i, j in TWELVE}


def entries(m) -> list:
    return [F.round(matrix.entry(m, i, j), 9).alias(_name(i, j)) for i, j in TWELVE]


def positive(df):
    """No negative zeros, which SQL engines print apart."""
    return df.withColumns({c: F.col(c) + 0.0 for c in NAMES})


@query("pose_chain", q(f"SELECT frame_id, {', '.join(f'round({n}, 9) + 0.0 AS {n}' for n in NAMES)} FROM worlds", "poses", **SQL))
def pose_chain(spark, sf_dir):
    """Lidar to world of each frame: its pose after its drive's calibration."""
    return positive(worlds(spark, sf_dir).select("frame_id", *entries(F.col("world"))))


@query(
    "frame_to_frame",
    q(f"SELECT source, target, {', '.join(f'round({_dot("b", "a", i, j)}, 6) + 0.0 AS {_name(i, j)}' for i, j in TWELVE)} FROM (SELECT s.frame_id AS source, t.frame_id AS target, {_SIDE('s', 'a')}, {_SIDE('t', 'b')} FROM worlds s JOIN backs t ON t.sequence_id = s.sequence_id)",
      "poses", **SQL, backs=f"SELECT frame_id, sequence_id, {', '.join(f'{e} AS {n}' for n, e in _BACK.items())} FROM worlds"),
)
def frame_to_frame(spark, sf_dir):
    """The transform from each frame of a drive into each frame of the drive."""
    all_worlds = worlds(spark, sf_dir)
    frames = all_worlds.select("sequence_id", "frame_id")
    pairs = frames.withColumnRenamed("frame_id", "source").join(frames.withColumnRenamed("frame_id", "target"), "sequence_id")
    found = poses.between(all_worlds, pairs)
    return positive(found.select("source", "target", *[F.round(matrix.entry(F.col("transform"), i, j), 6).alias(_name(i, j)) for i, j in TWELVE]))


def _camera(spark, sf_dir):
    return calibrations(spark, sf_dir).select("sequence_id", matrix.of_columns().alias("camera"))


IN_CAMERA = ", ".join(f"m.r{i}0 * x + m.r{i}1 * y + m.r{i}2 * z + m.t{i} AS c{c}" for i, c in enumerate("xyz"))


@query("lidar_to_camera", q(f"SELECT frame_id, point_id, {r('cx cy cz')} FROM (SELECT frame_id, point_id, {IN_CAMERA} FROM points p JOIN mounted m ON m.sequence_id = p.frame_id // {STRIDE})", "points", "poses", mounted=MOUNTED))
def lidar_to_camera(spark, sf_dir):
    rows = poses.carried(points(spark, sf_dir).withColumn("sequence_id", sequence_id()), _camera(spark, sf_dir), ["sequence_id"], "camera", ("cx", "cy", "cz"))
    return rounded(rows.select("frame_id", "point_id", "cx", "cy", "cz"), "cx cy cz")


@query("camera_to_lidar", q(f"SELECT frame_id, point_id, {r('x y z', 6)} FROM points", "points"))
def camera_to_lidar(spark, sf_dir):
    """All points through the camera and back: where they were."""
    camera = _camera(spark, sf_dir)
    there = poses.carried(points(spark, sf_dir).withColumn("sequence_id", sequence_id()), camera, ["sequence_id"], "camera", ("cx", "cy", "cz"))
    seen = there.select("sequence_id", "frame_id", "point_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    back = poses.carried(seen, camera, ["sequence_id"], "camera", ("bx", "by", "bz"), back=True)
    return back.select("frame_id", "point_id", *[(F.round(f"b{c}", 6) + 0.0).alias(c) for c in "xyz"])


@query("lidar_to_world_ground", q(f"SELECT frame_id, point_id, round(r00 * x + r01 * y + t0, 6) + 0.0 AS ground_x, round(r20 * x + r21 * y + t2, 6) + 0.0 AS ground_z FROM points JOIN worlds USING (frame_id)", "points", "poses", **SQL))
def lidar_to_world_ground(spark, sf_dir):
    places = points(spark, sf_dir).select("frame_id", "point_id", "x", "y", sequence_id().alias("sequence_id"))
    rows = poses.world_ground(places, worlds(spark, sf_dir))
    return rows.select("frame_id", "point_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("ground_x", "ground_z")])
