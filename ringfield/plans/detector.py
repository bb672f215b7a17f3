"""Queries on the detector's path and on ground planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield.operators import detector as det
from ringfield.operators import ground
from ringfield.operators.graph import cut
from ringfield.plans.objects import obstacles
from ringfield.plans.registry import query, rounded
from ringfield.plans.sql import PARTS as PIECES
from ringfield.plans.sql import d, reach
from ringfield.plans.sql import query as q
from ringfield.plans.sql import rounded as r
from ringfield.sources.derived import points

_TOUCH = " AND ".join(
    f"a.center_{c} - a.resolution / 2 <= b.center_{c} + b.resolution / 2 + greatest(a.resolution, b.resolution) * {d('0.05')} AND a.center_{c} + a.resolution / 2 >= b.center_{c} - b.resolution / 2 - greatest(a.resolution, b.resolution) * {d('0.05')}"
    for c in "xy"
)
TOUCHING = (
    "SELECT a.frame_id, a.cell_id AS a, b.cell_id AS b FROM obstacles a JOIN obstacles b ON a.frame_id = b.frame_id AND a.cell_id < b.cell_id AND abs(a.center_x - b.center_x) <= 1 AND abs(a.center_y - b.center_y) <= 1"
    f" WHERE {_TOUCH} AND abs(a.obstacle_height - b.obstacle_height) <= greatest({d('0.75')}, {d(2)} * greatest(a.resolution, b.resolution))"
)
PARTS = (
    "SELECT frame_id, component_id, count(*) AS cell_count, CAST(sum(obstacle_count) AS BIGINT) AS point_count, min(center_x - resolution / 2) AS min_x, max(center_x + resolution / 2) AS max_x, min(center_y - resolution / 2) AS min_y,"
    " max(center_y + resolution / 2) AS max_y, min(ground_elevation) AS min_z, max(obstacle_elevation) AS max_z, max(obstacle_height) AS max_height, sum(obstacle_height) AS height_sum FROM"
    " (SELECT o.*, c.component AS component_id FROM obstacles o JOIN _component c ON c.id = o.cell_id) GROUP BY frame_id, component_id"
)
SHAPES = (
    f"SELECT *, sqrt(center_x*center_x + center_y*center_y) AS distance, greatest(width * length, {d('0.01')}) AS footprint, greatest(width, length) / greatest(least(width, length), {d('0.05')}) AS aspect_ratio,"
    f" max_height / greatest(least(width, length), {d('0.05')}) AS verticality, CAST(point_count AS DOUBLE) / greatest(width * length, {d('0.01')}) AS density FROM (SELECT *, (min_x + max_x) / 2 AS center_x, (min_y + max_y) / 2 AS center_y,"
    " (min_z + max_z) / 2 AS center_z, max_x - min_x AS width, max_y - min_y AS length, max_z - min_z AS height, height_sum / cell_count AS mean_height FROM parts)"
)
CLASS = (
    "CASE WHEN max_height >= 1.2 AND greatest(width, length) <= 1.2 AND least(width, length) <= 1.0 AND verticality >= 2.0 AND point_count >= 10 THEN 'POLE'"
    " WHEN max_height >= 1.0 AND greatest(width, length) >= 4.0 AND least(width, length) <= 2.5 AND aspect_ratio >= 2.0 THEN 'WALL'"
    " WHEN greatest(width, length) BETWEEN 1.5 AND 8.0 AND least(width, length) BETWEEN 0.8 AND 3.5 AND max_height BETWEEN 0.7 AND 3.2 AND footprint >= 1.2 AND point_count >= 50 THEN 'VEHICLE-LIKE'"
    " WHEN max_height BETWEEN 1.2 AND 2.3 AND greatest(width, length) <= 1.2 AND least(width, length) <= 1.0 AND point_count >= 15 THEN 'PERSON-LIKE' ELSE 'OBSTACLE' END"
)


def _recursive(select: str, *own: tuple[str, str]) -> str:
    base = q("", "obstacles", touching=TOUCHING).strip().removeprefix("WITH ")
    more = "".join(f", {n} AS ({s})" for n, s in own)
    return f"WITH RECURSIVE {base}, {reach('(SELECT cell_id AS id FROM obstacles)', 'touching')}{more} {select}"


@query("detector_links", q("SELECT frame_id, a, b FROM touching", "obstacles", touching=TOUCHING))
def detector_links(spark, sf_dir):
    return det.links(obstacles(spark, sf_dir))


@query("detector_components", _recursive("SELECT o.frame_id, o.cell_id, c.component AS component_id FROM obstacles o JOIN _component c ON c.id = o.cell_id"))
def detector_components(spark, sf_dir):
    return det.components(obstacles(spark, sf_dir)).select("frame_id", "cell_id", "component_id")


SHAPE = "center_x center_y center_z width length height distance max_height mean_height footprint aspect_ratio verticality density"


@query("detector_features", _recursive(f"SELECT frame_id, component_id, cell_count, point_count, {r(SHAPE, 6)} FROM shapes", ("parts", PARTS), ("shapes", SHAPES)))
def detector_features(spark, sf_dir):
    rows = det.features(det.extents(det.components(obstacles(spark, sf_dir))))
    return rounded(rows, SHAPE, 6).select("frame_id", "component_id", "cell_count", "point_count", *SHAPE.split())


@query("classify_detector", _recursive(f"SELECT frame_id, component_id, {CLASS} AS classification FROM shapes", ("parts", PARTS), ("shapes", SHAPES)))
def classify_detector(spark, sf_dir):
    rows = det.features(det.extents(det.components(obstacles(spark, sf_dir))))
    return rows.select("frame_id", "component_id", det.classify().alias("classification"))


@query("detector_merges")
def detector_merges(spark, sf_dir):
    """Kept components and the object that each ends in."""
    return det.detect(obstacles(spark, sf_dir))[1]


@query("detector_proposals")
def detector_proposals(spark, sf_dir):
    return rounded(det.detect(obstacles(spark, sf_dir))[2], SHAPE, 6)


_POINTS = " ".join(f"max(CASE WHEN k % 3 = {k} THEN {c} END) AS {c}{k}," for c in "xyz" for k in range(3)).rstrip(",")
_N = [f"({p}1 - {p}0) * ({s}2 - {s}0) - ({s}1 - {s}0) * ({p}2 - {p}0)" for p, s in (("y", "z"), ("z", "x"), ("x", "y"))]
PLANES = {
    "drawn": "SELECT * FROM (SELECT frame_id, x, y, z, row_number() OVER (PARTITION BY frame_id ORDER BY (point_id % 2147483647) * 48271 % 2147483647, point_id, x, y, z) - 1 AS k FROM points) WHERE k < 192",
    "triples": f"SELECT frame_id, k // 3 AS h, {_POINTS} FROM drawn GROUP BY 1, 2",
    "normals": f"SELECT *, CASE WHEN n2 < 0 THEN -sqrt(n0*n0 + n1*n1 + n2*n2) ELSE sqrt(n0*n0 + n1*n1 + n2*n2) END AS s FROM (SELECT *, {', '.join(f'{e} AS n{i}' for i, e in enumerate(_N))} FROM triples)",
    "planes": "SELECT *, -(a * x0 + b * y0 + c * z0) AS d FROM (SELECT frame_id, h, x0, y0, z0, n0 / s AS a, n1 / s AS b, n2 / s AS c FROM normals WHERE abs(s) > 1e-9)",
    "votes": f"SELECT p.frame_id, p.h, p.a, p.b, p.c, p.d, count(CASE WHEN abs(p.a * t.x + p.b * t.y + p.c * t.z + p.d) <= {d('0.08')} THEN 1 END) AS inliers, count(*) AS points FROM planes p JOIN points t ON t.frame_id = p.frame_id GROUP BY ALL",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY inliers DESC, h) AS rk FROM votes) WHERE rk = 1",
}


@query("ransac_ground", q(f"SELECT frame_id, {r('a b c d', 6)}, inliers, points FROM best", "points", **PLANES))
def ransac_ground(spark, sf_dir):
    return rounded(ground.ransac_ground(points(spark, sf_dir)), "a b c d", 6)


@query("ransac_mask", q(f"SELECT t.frame_id, t.point_id, abs(p.a * t.x + p.b * t.y + p.c * t.z + p.d) <= {d('0.08')} AS is_ground FROM points t JOIN best p ON t.frame_id = p.frame_id", "points", **PLANES))
def ransac_mask(spark, sf_dir):
    p = points(spark, sf_dir)
    return ground.with_ground(p, cut(ground.ransac_ground(p))).select("frame_id", "point_id", "is_ground")


_NEAR = f"abs(p.a * t.x + p.b * t.y + p.c * t.z + p.d) <= {d('0.08')}"
_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
FITTED = {
    "sums": f"SELECT t.frame_id, count(*) AS n, {', '.join(f'sum(t.{c}) AS s{c}' for c in 'xyz')}, {', '.join(f'sum(t.{u} * t.{v}) AS s{u}{v}' for u, v in _PAIRS)} FROM points t JOIN best p ON t.frame_id = p.frame_id WHERE {_NEAR} GROUP BY 1",
    "moments": f"SELECT frame_id, {', '.join(f's{c} / n AS m{c}' for c in 'xyz')}, {', '.join(f's{u}{v} - s{u} * s{v} / n AS {u}{v}' for u, v in _PAIRS)} FROM sums",
    "dets": "SELECT *, yy * zz - yz * yz AS dx, xx * zz - xz * xz AS dy, xx * yy - xy * xy AS dz, xz * yz - xy * zz AS p, xy * yz - xz * yy AS q, xy * xz - yz * xx AS s FROM moments",
    "fits": "SELECT *, CASE WHEN w < 0 THEN -sqrt(u*u + v*v + w*w) ELSE sqrt(u*u + v*v + w*w) END AS size FROM (SELECT *, CASE WHEN dz >= dx AND dz >= dy THEN q WHEN dy >= dx THEN p ELSE dx END AS u, CASE WHEN dz >= dx AND dz >= dy THEN s WHEN dy >= dx THEN dy ELSE p END AS v,"
    " CASE WHEN dz >= dx AND dz >= dy THEN dz WHEN dy >= dx THEN s ELSE q END AS w FROM dets)",
}


@query("ground_refit", q("SELECT f.frame_id, round(u / size, 6) + 0.0 AS a, round(v / size, 6) + 0.0 AS b, round(w / size, 6) + 0.0 AS c, round(-(u * mx + v * my + w * mz) / size, 6) + 0.0 AS d, inliers, points FROM fits f JOIN best USING (frame_id)", "points", **PLANES, **FITTED))
def ground_refit(spark, sf_dir):
    """The drawn plane of each frame, fitted to all its inliers."""
    p = points(spark, sf_dir)
    rows = rounded(ground.refitted(p, cut(ground.ransac_ground(p))), "a b c d", 6)
    return rows.withColumns({k: rows[k] + 0.0 for k in "abcd"})


@query(
    "ransac_grid",
    q("SELECT * FROM regrid", "points", **PLANES,
      reground=f"SELECT t.frame_id, t.point_id, t.x, t.y, t.z, t.label, coalesce({_NEAR}, false) AS is_ground FROM points t LEFT JOIN best p ON t.frame_id = p.frame_id",
      remapped=PIECES["mapped"].replace("FROM points", "FROM reground"), regrid=PIECES["cells"].replace("FROM mapped", "FROM remapped")),
)
def ransac_grid(spark, sf_dir):
    """The adaptive grid over ground that comes from the planes."""
    from ringfield.operators.grid import adaptive_grid

    p = points(spark, sf_dir)
    return adaptive_grid(cut(ground.with_ground(p, cut(ground.ransac_ground(p)))))


@query("plane_elevation", q("SELECT s.frame_id, s.level, s.ix, s.iy, round(CASE WHEN abs(c) >= 1e-9 THEN -(a * center_x + b * center_y + d) / c END, 6) + 0.0 AS elevation FROM stats s JOIN best USING (frame_id)", "points", "stats", **PLANES))
def plane_elevation(spark, sf_dir):
    """Height of the frame's ground plane below the centre of each cell."""
    from ringfield.functions import geometry
    from ringfield.operators.grid import KEY, adaptive_grid, cell_stats

    p = cut(points(spark, sf_dir))
    rows = cell_stats(cut(adaptive_grid(p))).join(ground.ransac_ground(p).select("frame_id", *"abcd"), "frame_id")
    height = geometry.plane_elevation(*[F.col(k) for k in "abcd"], F.col("center_x"), F.col("center_y"))
    return rows.select(*KEY, (F.round(height, 6) + 0.0).alias("elevation"))
