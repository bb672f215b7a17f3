"""Queries on poses, sampling, tracks and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield.operators import planning, poses, sampling, tracking
from ringfield.operators.components import proposals
from ringfield.operators.graph import cut
from ringfield.plans.grid import cells
from ringfield.plans.objects import groups
from ringfield.plans.registry import query, rounded
from ringfield.plans.sql import CELL_ID, d
from ringfield.plans.sql import query as q
from ringfield.plans.sql import rounded as r
from ringfield.sources.derived import STRIDE, points, sequence_id
from ringfield.sources.derived import poses as derived_poses

WORLD = "SELECT p.frame_id, p.point_id, " + ", ".join(f"r{i}0 * x + r{i}1 * y + r{i}2 * z + t{i} AS w{c}" for i, c in enumerate("xyz")) + " FROM points p JOIN poses USING (frame_id)"


DRIVES = f"PARTITION BY frame_id // {STRIDE}"


def drives(spark, sf_dir, lines=None):
    return derived_poses(spark, sf_dir, lines).withColumn("sequence_id", sequence_id())


@query("world_points", q(f"SELECT frame_id, point_id, {r('wx wy wz')} FROM world", "points", "poses", world=WORLD))
def world_points(spark, sf_dir):
    rows = poses.world_points(points(spark, sf_dir), derived_poses(spark, sf_dir))
    return rounded(rows.select("frame_id", "point_id", "wx", "wy", "wz"), "wx wy wz")


@query("world_round_trip", q("SELECT frame_id, count(*) AS points, CAST(0 AS BIGINT) AS moved FROM points GROUP BY frame_id", "points"))
def world_round_trip(spark, sf_dir):
    """Points that do not come back to where they were: none."""
    pose = derived_poses(spark, sf_dir)
    there = poses.world_points(points(spark, sf_dir), pose)
    back = poses.ego_points(there, pose)
    off = F.greatest(*[F.abs(F.col(f"e{c}") - F.col(c)) for c in "xyz"]) > 1e-9
    return back.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.count(F.when(off, 1)).alias("moved"))


@query(
    "relative_centroid",
    q(
        f"SELECT frame_id, {r('x y', 6)} FROM (SELECT w.frame_id, f.r00 * (avg(wx) - any_value(f.t0)) + f.r10 * (avg(wy) - any_value(f.t1)) AS x, f.r01 * (avg(wx) - any_value(f.t0)) + f.r11 * (avg(wy) - any_value(f.t1)) AS y"
        " FROM world w CROSS JOIN (SELECT * FROM poses WHERE frame_id = 3) f GROUP BY w.frame_id, f.r00, f.r01, f.r10, f.r11)",
        "points",
        "poses",
        world=WORLD,
    ),
)
def relative_centroid(spark, sf_dir):
    """Each frame's centroid as seen from frame 3."""
    rows = poses.world_points(points(spark, sf_dir), poses.relative(derived_poses(spark, sf_dir), 3))
    return rows.groupBy("frame_id").agg(F.round(F.avg("wx"), 6).alias("x"), F.round(F.avg("wy"), 6).alias("y"))


@query("ego_heading", q("SELECT frame_id, points, round(atan2(r10, r00), 9) AS yaw, t0 AS x, t1 AS y FROM poses JOIN (SELECT frame_id, count(*) AS points FROM points GROUP BY frame_id) USING (frame_id)", "points", "poses"))
def ego_heading(spark, sf_dir):
    n = points(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"))
    return rounded(poses.heading(derived_poses(spark, sf_dir)), "yaw").join(n, "frame_id").select("frame_id", "points", "yaw", "x", "y")


@query(
    "ego_displacement",
    q(
        "SELECT frame_id, round(sqrt((t0-p0)*(t0-p0) + (t1-p1)*(t1-p1)), 9) AS distance, round(yaw - pyaw, 9) AS turn FROM (SELECT *, lag(t0) OVER w AS p0, lag(t1) OVER w AS p1, lag(yaw) OVER w AS pyaw"
        f" FROM (SELECT *, atan2(r10, r00) AS yaw FROM poses) WINDOW w AS ({DRIVES} ORDER BY frame_id)) WHERE p0 IS NOT NULL",
        "poses",
    ),
)
def ego_displacement(spark, sf_dir):
    return rounded(poses.displacement(drives(spark, sf_dir)), "distance turn").drop("sequence_id")


@query(
    "trajectory",
    q(
        f"SELECT frame_id, t0 AS x, t1 AS y, round(sum(s) OVER ({DRIVES} ORDER BY frame_id), 9) AS travelled FROM (SELECT *, coalesce(sqrt((t0-lag(t0) OVER w)*(t0-lag(t0) OVER w) + (t1-lag(t1) OVER w)*(t1-lag(t1) OVER w)), 0.0) AS s FROM poses WINDOW w AS ({DRIVES} ORDER BY frame_id))",
        "poses",
    ),
)
def trajectory(spark, sf_dir):
    return rounded(poses.trajectory(drives(spark, sf_dir)), "travelled").drop("sequence_id")


EVENTS = "SELECT user_id, event_id, CAST(event_id % 97 AS DOUBLE) / 4 AS x, CAST(event_id % 89 AS DOUBLE) / 4 AS y FROM events"


@query(
    "travel_metres",
    f"WITH path AS ({EVENTS}) SELECT user_id, count(*) AS samples, round(CASE WHEN count(*) = 1 THEN min(sqrt(x*x + y*y)) ELSE sum(s) END, 9) AS metres FROM (SELECT *, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w) + (y-lag(y) OVER w)*(y-lag(y) OVER w)) AS s FROM path WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id",
)
def travel_metres(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = lambda k: (F.col("event_id") % k).cast("double") / 4
    return rounded(poses.travel_metres(e.select("user_id", "event_id", at(97).alias("x"), at(89).alias("y")), "user_id", "event_id"), "metres")


@query(
    "frame_dt",
    "WITH f AS (SELECT user_id, event_id AS frame_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS ts_s FROM events), g AS (SELECT *, ts_s - lag(ts_s) OVER w AS dt0, lag(frame_id) OVER w AS pf FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame_id))"
    " SELECT user_id, frame_id, round(CASE WHEN dt0 > 0.000001 THEN dt0 ELSE CAST(0.1 AS DOUBLE) * greatest(1, frame_id - pf) END, 6) AS dt FROM g WHERE pf IS NOT NULL",
)
def frame_dt(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    frames = e.select("user_id", F.col("event_id").alias("frame_id"), (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1000000).alias("ts_s"))
    return rounded(poses.frame_dt(frames, "user_id"), "dt", 6)


@query(
    "quat_to_matrix",
    "WITH e AS (SELECT event_id, CAST(event_id % 7 AS DOUBLE) + 1 AS w, CAST(event_id % 5 AS DOUBLE) - 2 AS x, CAST(event_id % 3 AS DOUBLE) AS y, CAST(event_id % 11 AS DOUBLE) - 5 AS z FROM events), n AS (SELECT event_id, w / l AS w, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS l FROM e))"
    " SELECT event_id, round(1 - 2*(y*y+z*z), 9) + 0.0 AS r00, round(2*(x*y-z*w), 9) + 0.0 AS r01, round(2*(x*z+y*w), 9) + 0.0 AS r02, round(2*(x*y+z*w), 9) + 0.0 AS r10, round(1 - 2*(x*x+z*z), 9) + 0.0 AS r11, round(2*(y*z-x*w), 9) + 0.0 AS r12,"
    " round(2*(x*z-y*w), 9) + 0.0 AS r20, round(2*(y*z+x*w), 9) + 0.0 AS r21, round(1 - 2*(x*x+y*y), 9) + 0.0 AS r22 FROM n",
)
def quat_to_matrix(spark, sf_dir):
    i = lambda k: (F.col("event_id") % k).cast("double")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = "r00 r01 r02 r10 r11 r12 r20 r21 r22"
    rows = rounded(e.select("event_id", *poses.rotation_of(i(7) + 1, i(5) - 2, i(3), i(11) - 5)), names)
    return rows.withColumns({c: F.col(c) + 0.0 for c in names.split()})  # no negative zeros


@query(
    "even_sample",
    q(
        "SELECT frame_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM points) WHERE n <= 500 OR EXISTS"
        " (SELECT 1 FROM range(500) i(i) WHERE round_even(i * (n - 1) / CAST(499 AS DOUBLE), 0) = k)",
        "points",
    ),
)
def even_sample(spark, sf_dir):
    return sampling.even_sample(points(spark, sf_dir).select("frame_id", "point_id"), ["frame_id"], "point_id", 500)


@query("random_subsample")
def random_subsample(spark, sf_dir):
    return sampling.hash_sample(points(spark, sf_dir).select("frame_id", "point_id"), ["frame_id"], "point_id", 500)


@query(
    "accumulated_cloud",
    q(
        f"SELECT frame_id, point_id, {r('wx wy wz')} FROM (SELECT *, row_number() OVER (ORDER BY frame_id, point_id, x, y, z) - 1 AS k, count(*) OVER () AS n FROM world) WHERE k % greatest(1, CAST(ceil(n / CAST(5000 AS DOUBLE)) AS BIGINT)) = 0",
        "points",
        "poses",
        world=WORLD.replace("p.point_id, ", "p.point_id, x, y, z, "),
    ),
)
def accumulated_cloud(spark, sf_dir):
    """An even share of all frames' points, in one world."""
    rows = sampling.stride_sample(points(spark, sf_dir), ["frame_id", "point_id", "x", "y", "z"], 5000)
    return rounded(poses.world_points(rows, derived_poses(spark, sf_dir)).select("frame_id", "point_id", "wx", "wy", "wz"), "wx wy wz")


def detections(spark, sf_dir):
    """Proposals of all frames in the world coordinates of their drive, 0.1 s apart; a drive is a sequence."""
    return detected(proposals(groups(spark, sf_dir)), derived_poses(spark, sf_dir))


def detected(found, pose):
    world = poses.world_points(found.withColumns({"x": F.col("center_x"), "y": F.col("center_y"), "z": F.lit(0.0)}), pose)
    return world.select(
        sequence_id().alias("sequence_id"), "frame_id", (F.col("frame_id") * 0.1).alias("ts_s"), "object_id", "classification",
        F.col("wx").alias("x"), F.col("wy").alias("y"), "width", "length", "confidence",
    )


@query("tracks")
def tracks(spark, sf_dir):
    return tracking.tracks(detections(spark, sf_dir))


@query("world_objects")
def world_objects(spark, sf_dir):
    return tracking.world_objects(tracking.tracks(detections(spark, sf_dir)))


@query("retired_tracks")
def retired_tracks(spark, sf_dir):
    return tracking.retired(tracking.tracks(detections(spark, sf_dir)))


@query("world_summary")
def world_summary(spark, sf_dir):
    return tracking.world_summary(tracking.tracks(detections(spark, sf_dir)))


@query("nearest_objects")
def nearest_objects(spark, sf_dir):
    return tracking.nearest(tracking.tracks(detections(spark, sf_dir)))


# Squares of two cells overlap only if these touch one square metre of a grid in common, as no cell is wider than half a metre.
SQUARES = {
    "squares": f"SELECT frame_id, {CELL_ID} AS id, cell_class, center_x, center_y, resolution, CAST(floor(center_x) AS BIGINT) AS bx, CAST(floor(center_y) AS BIGINT) AS by_ FROM stats",
    "walls": "SELECT frame_id, center_x, center_y, resolution, bx + di AS bx, by_ + dj AS by_ FROM squares, (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj) WHERE cell_class <> 'GROUND'",
    "struck": f"SELECT DISTINCT s.id FROM squares s JOIN walls o USING (frame_id, bx, by_) WHERE abs(o.center_x - s.center_x) < (o.resolution + s.resolution) / 2 + {d('0.0001')} AND abs(o.center_y - s.center_y) < (o.resolution + s.resolution) / 2 + {d('0.0001')}",
    "nodes": "SELECT s.*, cell_class <> 'GROUND' OR s.id IN (SELECT id FROM struck) AS blocked FROM squares s",
}


@query("plan_blocked", q("SELECT frame_id, id, blocked FROM nodes", "stats", **SQUARES))
def plan_blocked(spark, sf_dir):
    """Cells of all rings, and whether a path must not cross them."""
    return planning.plan_nodes(cut(cells(spark, sf_dir))).select("frame_id", "id", "blocked")


@query("plan_blocked_all", q("SELECT frame_id, id, blocked FROM nodes", "stats", **SQUARES))
def plan_blocked_all(spark, sf_dir):
    """plan_blocked, under the name that it had while that one kept to the outermost ring."""
    return plan_blocked(spark, sf_dir)


@query(
    "plan_edges",
    q("SELECT DISTINCT a.frame_id, a.id AS a, b.id AS b, round(sqrt((a.center_x-b.center_x)*(a.center_x-b.center_x) + (a.center_y-b.center_y)*(a.center_y-b.center_y)), 9) AS length FROM free a JOIN around b USING (frame_id, bx, by_)"
      f" WHERE a.id < b.id AND abs(a.center_x - b.center_x) <= (a.resolution + b.resolution) / 2 + {d('0.001')} AND abs(a.center_y - b.center_y) <= (a.resolution + b.resolution) / 2 + {d('0.001')}",
      "stats", **SQUARES, free="SELECT * FROM nodes WHERE NOT blocked", around="SELECT frame_id, id, center_x, center_y, resolution, bx + di AS bx, by_ + dj AS by_ FROM free, (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj)"),
)
def plan_edges(spark, sf_dir):
    return rounded(planning.plan_edges(planning.plan_nodes(cut(cells(spark, sf_dir)))), "length")


@query("plan_path")
def plan_path(spark, sf_dir):
    nodes = planning.plan_nodes(cut(cells(spark, sf_dir)))
    return planning.plan_path(nodes, planning.plan_edges(nodes), (-30.0, -20.0), (-26.0, -24.0))


@query(
    "point_along_path",
    f"WITH path AS ({EVENTS}), s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, coalesce(sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w) + (y-lag(y) OVER w)*(y-lag(y) OVER w)), 0.0) AS s FROM path WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),"
    " c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS reached, sum(s) OVER (PARTITION BY user_id) AS total FROM s), h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rk FROM c WHERE reached >= total * 0.5 AND (reached - s < total * 0.5 OR px IS NULL))"
    " SELECT user_id, round(CASE WHEN px IS NULL THEN x ELSE px + (x - px) * CASE WHEN s > 0 THEN (total * 0.5 - (reached - s)) / s ELSE 0 END END, 6) AS x, round(CASE WHEN py IS NULL THEN y ELSE py + (y - py) * CASE WHEN s > 0 THEN (total * 0.5 - (reached - s)) / s ELSE 0 END END, 6) AS y FROM h WHERE rk = 1",
)
def point_along_path(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = lambda k: (F.col("event_id") % k).cast("double") / 4
    return rounded(planning.point_along(e.select("user_id", "event_id", at(97).alias("x"), at(89).alias("y")), "user_id", "event_id", 0.5), "x y", 6)



@query("track_labels")
def track_labels(spark, sf_dir):
    return tracking.track_labels(tracking.tracks(detections(spark, sf_dir)))


@query("track_class_counts")
def track_class_counts(spark, sf_dir):
    return tracking.class_counts(tracking.tracks(detections(spark, sf_dir)))


@query("track_trails")
def track_trails(spark, sf_dir):
    return tracking.trails(tracking.world_objects(tracking.tracks(detections(spark, sf_dir))))


@query("motion_classes")
def motion_classes(spark, sf_dir):
    """Tracks at each frame, with their class of motion by speed, hits and misses."""
    found = tracking.motion_of(tracking.tracks(detections(spark, sf_dir)))
    return found.select("sequence_id", "frame_id", "track_id", "motion_class")
