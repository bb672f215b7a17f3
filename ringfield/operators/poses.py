"""Frames in one world: poses, moved points, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfield.functions import matrix
from ringfield.functions.geometry import ROTATION, SHIFT, composed, inverse, quaternion_rotation, transformed

POSE = [*ROTATION, *SHIFT]


def relative(poses: DataFrame, reference: int = 0) -> DataFrame:
    """Poses seen from the reference frame: inv(T_reference) * T."""
    ref = poses.where(F.col("frame_id") == reference).select(*[v.alias(f"ref_{k}") for k, v in inverse().items()])
    rows = poses.join(F.broadcast(ref.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k"))  # one row
    a = {n: F.col(f"ref_{n}") for n in POSE}
    return rows.select("frame_id", *[v.alias(k) for k, v in composed(a, {n: F.col(n) for n in POSE}).items()])


def world_points(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Points in world coordinates. A pose table has a row a frame; it is broadcast only while
    Spark finds it small."""
    rows = points.join(poses, "frame_id")
    x, y, z = transformed(F.col("x"), F.col("y"), F.col("z"))
    return rows.withColumns({"wx": x, "wy": y, "wz": z}).drop(*POSE)


def ego_points(points: DataFrame, poses: DataFrame) -> DataFrame:
    """World points (wx, wy, wz) back in their frame."""
    rows = points.join(poses.select("frame_id", *[v.alias(k) for k, v in inverse().items()]), "frame_id")
    x, y, z = transformed(F.col("wx"), F.col("wy"), F.col("wz"))
    return rows.withColumns({"ex": x, "ey": y, "ez": z}).drop(*POSE)


def heading(poses: DataFrame, *keys: str) -> DataFrame:
    """Where the sensor is and which way its x axis points."""
    return poses.select(*keys, "frame_id", F.col("t0").alias("x"), F.col("t1").alias("y"), F.col("t2").alias("z"), F.atan2("r10", "r00").alias("yaw"))


def displacement(poses: DataFrame, by: str = "sequence_id") -> DataFrame:
    """Distance and turn from each frame to the next of its sequence."""
    w = Window.partitionBy(by).orderBy("frame_id")
    rows = heading(poses, by).withColumns({f"p{c}": F.lag(c).over(w) for c in ("x", "y", "z", "yaw")}).where("px IS NOT NULL")
    d = [F.col(c) - F.col(f"p{c}") for c in "xyz"]
    return rows.select(by, "frame_id", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("distance"), (F.col("yaw") - F.col("pyaw")).alias("turn"))


def trajectory(poses: DataFrame, by: str = "sequence_id") -> DataFrame:
    """Path so far at each frame of a sequence, in metres."""
    w = Window.partitionBy(by).orderBy("frame_id")
    rows = poses.select(by, "frame_id", "t0", "t1").withColumns({"_x": F.lag("t0").over(w), "_y": F.lag("t1").over(w)})
    step = F.coalesce(F.hypot(F.col("t0") - F.col("_x"), F.col("t1") - F.col("_y")), F.lit(0.0))
    return rows.select(by, "frame_id", F.col("t0").alias("x"), F.col("t1").alias("y"), F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("travelled"))


def travel_metres(samples: DataFrame, by: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Length of each path; a path of one sample is as long as the sample is far from the origin."""
    w = Window.partitionBy(by).orderBy(order)
    rows = samples.withColumns({"_px": F.lag(x).over(w), "_py": F.lag(y).over(w)})
    step = F.when(F.col("_px").isNotNull(), F.hypot(F.col(x) - F.col("_px"), F.col(y) - F.col("_py")))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.sum(step).alias("_s"), F.min(F.hypot(F.col(x), F.col(y))).alias("_one"))
    return out.select(by, "samples", F.when(F.col("samples") == 1, F.col("_one")).otherwise(F.col("_s")).alias("metres"))


def frame_dt(frames: DataFrame, by: str, default: float = 0.1) -> DataFrame:
    """Seconds since the frame before, by time stamps in seconds; where these do not advance, a
    default step for each frame index passed."""
    w = Window.partitionBy(by).orderBy("frame_id")
    rows = frames.withColumns({"_t": F.lag("ts_s").over(w), "_f": F.lag("frame_id").over(w)}).where("_f IS NOT NULL")
    dt = F.col("ts_s") - F.col("_t")
    return rows.select(by, "frame_id", F.when(dt > 1e-6, dt).otherwise(default * F.greatest(F.lit(1), F.col("frame_id") - F.col("_f"))).alias("dt"))


def rotation_of(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [v.alias(k) for k, v in quaternion_rotation(w, x, y, z).items()]


def calibrated(poses: DataFrame, calibration: DataFrame, by: str = "sequence_id") -> DataFrame:
    """(by, frame_id, world): lidar to world for each frame, its pose after its sequence's calibration.
    poses: by, frame_id, POSE (sensor's carrier to world); calibration: by, POSE (lidar to carrier)."""
    rows = poses.select(by, "frame_id", matrix.of_columns().alias("_pose")).join(calibration.select(by, matrix.of_columns().alias("_calibration")), by)
    return rows.select(by, "frame_id", matrix.product(F.col("_pose"), F.col("_calibration")).alias("world"))


def between(worlds: DataFrame, pairs: DataFrame, by: str = "sequence_id") -> DataFrame:
    """(by, source, target, transform) for each pair of frames: points of the source frame into the target frame."""
    side = lambda name, m: worlds.select(by, F.col("frame_id").alias(name), m.alias(f"_{name}"))
    rows = pairs.join(side("source", F.col("world")), [by, "source"]).join(side("target", matrix.inverse(F.col("world"))), [by, "target"])
    return rows.select(by, "source", "target", matrix.product(F.col("_target"), F.col("_source")).alias("transform"))


def carried(points: DataFrame, transforms: DataFrame, on: list[str], name: str, into: tuple[str, str, str], back: bool = False) -> DataFrame:
    """points (x, y, z by default as `xyz`) through the transform `name` of their key, or back through its inverse."""
    m = matrix.inverse(F.col(name)) if back else F.col(name)
    rows = points.join(transforms.select(*on, m.alias("_m")), on)
    return rows.withColumns(dict(zip(into, matrix.applied(F.col("_m"), F.col("x"), F.col("y"), F.col("z")), strict=True))).drop("_m")


def world_ground(places: DataFrame, worlds: DataFrame, by: str = "sequence_id") -> DataFrame:
    """places (by, frame_id, x, y) at height 0 -> ground_x, ground_z: the horizontal place in a world whose y axis is vertical."""
    rows = carried(places.withColumn("z", F.lit(0.0)), worlds, [by, "frame_id"], "world", ("ground_x", "_up", "ground_z"))
    return rows.drop("z", "_up")


def pose_source(motion: bool, named: str | None = None, poses: DataFrame | None = None) -> str:
    """What the poses of a run are: none at all, those of a source that names itself, an empty table, or a table."""
    if not motion:
        return "identity_no_odometry"
    if named:
        return named
    return "identity_empty_poses" if poses is None or poses.isEmpty() else "kitti_poses_lidar_to_frame0"
