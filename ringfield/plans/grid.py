"""Queries on points and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield.functions import classify
from ringfield.functions.geometry import ring_level
from ringfield.operators import grid
from ringfield.plans.registry import query, rounded
from ringfield.plans.sql import CLASS, d, size_of
from ringfield.plans.sql import query as q
from ringfield.plans.sql import rounded as r
from ringfield.sources.derived import STRIDE, points, sequence_id

KEY = "frame_id, level, ix, iy"


def cells(spark, sf_dir):
    return grid.adaptive_grid(points(spark, sf_dir))


@query("adaptive_grid", q("SELECT * FROM cells", "cells"))
def adaptive_grid(spark, sf_dir):
    return cells(spark, sf_dir)


@query("merged_grid", q("SELECT * FROM cells", "cells"))
def merged_grid(spark, sf_dir):
    """Two halves of the points, gridded apart and added up."""
    p = points(spark, sf_dir)
    halves = [grid.adaptive_grid(p.where(F.col("point_id") % 2 == k)) for k in (0, 1)]
    return grid.merged(halves[0].unionByName(halves[1]))


@query("range_filter", q("SELECT frame_id, point_id, x, y, z FROM points WHERE x*x+y*y < 900", "points"))
def range_filter(spark, sf_dir):
    return grid.in_range(points(spark, sf_dir), 30.0).select("frame_id", "point_id", "x", "y", "z")


@query("ring_level", q("SELECT frame_id, point_id, level, resolution, ix, iy FROM mapped", "mapped"))
def ring_levels(spark, sf_dir):
    return grid.with_cell(points(spark, sf_dir)).select("frame_id", "point_id", "level", "resolution", "ix", "iy")


@query("ground_zfallback", q("SELECT frame_id, count(*) AS points, count(CASE WHEN z < 0 THEN 1 END) AS ground FROM points GROUP BY frame_id", "points"))
def ground_zfallback(spark, sf_dir):
    return points(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.count(F.when(F.col("z") < 0, 1)).alias("ground"))


@query("cell_elevation", q(f"SELECT {KEY}, ground_elevation, obstacle_elevation, z_mean, z_min, z_max, center_x, center_y FROM stats", "stats"))
def cell_elevation(spark, sf_dir):
    return grid.cell_stats(cells(spark, sf_dir)).select(*grid.KEY, "ground_elevation", "obstacle_elevation", "z_mean", "z_min", "z_max", "center_x", "center_y")


@query("cell_class", q(f"SELECT {KEY}, {CLASS} AS cell_class FROM cells", "cells"))
def cell_class(spark, sf_dir):
    return cells(spark, sf_dir).select(*grid.KEY, classify.cell_class(F.col("ground_count"), F.col("obstacle_count")).alias("cell_class"))


@query(
    "cell_parent",
    q(
        f"SELECT {KEY}, level + 1 AS parent_level, CAST(floor(center_x / up) AS BIGINT) AS parent_ix, CAST(floor(center_y / up) AS BIGINT) AS parent_iy"
        f" FROM (SELECT *, {size_of('(level + 1)')} AS up FROM stats WHERE level < 3)",
        "stats",
    ),
)
def cell_parent(spark, sf_dir):
    return grid.cell_parent(cells(spark, sf_dir))


@query(
    "grid_stats",
    q(
        "SELECT f.frame_id, CAST(l.level AS INTEGER) AS level, coalesce(c.cells, 0) AS cells, coalesce(c.points, 0) AS points FROM (SELECT DISTINCT frame_id FROM cells) f CROSS JOIN (SELECT unnest([0,1,2,3]) AS level) l"
        " LEFT JOIN (SELECT frame_id, level, count(*) AS cells, CAST(sum(point_count) AS BIGINT) AS points FROM cells GROUP BY frame_id, level) c ON c.frame_id = f.frame_id AND c.level = l.level",
        "cells",
    ),
)
def grid_stats(spark, sf_dir):
    return grid.grid_stats(cells(spark, sf_dir))


@query("class_histogram", q(f"SELECT frame_id, level, {CLASS} AS cell_class, count(*) AS cells FROM cells GROUP BY 1, 2, 3", "cells"))
def class_histogram(spark, sf_dir):
    return grid.class_histogram(cells(spark, sf_dir))


UNIFORM = f"SELECT frame_id, CAST(floor(x / {d('0.05')}) AS BIGINT) AS ix, CAST(floor(y / {d('0.05')}) AS BIGINT) AS iy, count(*) AS point_count, sum(z) AS z_sum FROM mapped GROUP BY 1, 2, 3"


@query("uniform_grid", q(UNIFORM, "mapped"))
def uniform_grid(spark, sf_dir):
    return grid.uniform_grid(points(spark, sf_dir))


@query(
    "storage_compare",
    q(
        "SELECT *, adaptive_cells * 40 AS adaptive_bytes, uniform_cells * 40 AS uniform_bytes, dense_cells * 40 AS dense_bytes,"
        " round((1.0 - CAST(adaptive_cells AS DOUBLE) / uniform_cells) * 100.0, 6) AS reduction_percent FROM (SELECT frame_id, a.adaptive_cells, u.uniform_cells,"
        f" CAST(ceil({d('3.141592653589793')} * {d(100)} * {d(100)} / ({d('0.05')} * {d('0.05')})) AS BIGINT) AS dense_cells FROM"
        " (SELECT frame_id, count(*) AS adaptive_cells FROM cells GROUP BY frame_id) a JOIN (SELECT frame_id, count(*) AS uniform_cells FROM uniform GROUP BY frame_id) u USING (frame_id))",
        "cells",
        uniform=UNIFORM,
    ),
)
def storage_compare(spark, sf_dir):
    p = points(spark, sf_dir)
    return grid.storage_compare(p, grid.adaptive_grid(p))


@query(
    "voxel_downsample",
    q(
        "SELECT frame_id, CAST(floor((x - x0) / 0.5) AS BIGINT) AS vx, CAST(floor((y - y0) / 0.5) AS BIGINT) AS vy, CAST(floor((z - z0) / 0.5) AS BIGINT) AS vz, count(*) AS n,"
        " round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM points JOIN low USING (frame_id) GROUP BY 1, 2, 3, 4",
        "points",
        low="SELECT frame_id, min(x) - 0.25 AS x0, min(y) - 0.25 AS y0, min(z) - 0.25 AS z0 FROM points GROUP BY frame_id",
    ),
)
def voxel_downsample(spark, sf_dir):
    return grid.voxel_downsample(points(spark, sf_dir))


@query(
    "voxel_reduction",
    q(
        "SELECT frame_id, size, points, count(*) AS voxels, round((1.0 - CAST(count(*) AS DOUBLE) / points) * 100.0, 6) AS reduction_percent FROM (SELECT DISTINCT p.frame_id, s.size, l.points,"
        " floor((x - (x0 - s.size / 2)) / s.size) AS vx, floor((y - (y0 - s.size / 2)) / s.size) AS vy, floor((z - (z0 - s.size / 2)) / s.size) AS vz FROM points p JOIN low l ON l.frame_id = p.frame_id"
        f" CROSS JOIN (SELECT unnest([{d('0.05')}, {d('0.1')}, {d('0.25')}, {d('0.5')}]) AS size) s) GROUP BY frame_id, size, points",
        "points",
        low="SELECT frame_id, count(*) AS points, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM points GROUP BY frame_id",
    ),
)
def voxel_reduction(spark, sf_dir):
    return grid.voxel_reduction(points(spark, sf_dir))


SHOWN = f"SELECT {KEY}, coalesce(obstacle_elevation, ground_elevation, z_mean, {d(0)}) AS viewer_z, coalesce(ground_elevation, z_mean, (z_min + z_max) / 2, z_min, z_max, obstacle_elevation) AS web_z FROM stats"


@query("display_elevation", q(SHOWN, "stats"))
def display_elevation(spark, sf_dir):
    return grid.display_elevation(cells(spark, sf_dir))


@query("elevation_range", q("SELECT frame_id, min(web_z) AS z_low, max(web_z) AS z_high FROM shown GROUP BY frame_id", "stats", shown=SHOWN))
def elevation_range(spark, sf_dir):
    return grid.elevation_range(cells(spark, sf_dir))


@query(
    "traversability",
    q(f"SELECT {KEY}, CASE cell_class WHEN 'GROUND' THEN 0 WHEN 'MIXED' THEN 1 ELSE 2 END AS traversability, CASE WHEN cell_class = 'GROUND' THEN 0 ELSE 1 END AS terrain FROM stats", "stats"),
)
def traversability(spark, sf_dir):
    return grid.traversability(cells(spark, sf_dir))


@query(
    "focus_box",
    q("SELECT frame_id, min(center_x - resolution / 2) AS min_x, max(center_x + resolution / 2) AS max_x, min(center_y - resolution / 2) AS min_y, max(center_y + resolution / 2) AS max_y FROM stats GROUP BY frame_id", "stats"),
)
def focus_box(spark, sf_dir):
    return grid.focus_box(cells(spark, sf_dir))


@query(
    "foveation",
    q(
        "SELECT frame_id, round(resolution, 4) AS resolution, count(*) AS cells, round(min(dist), 9) AS nearest, round(max(dist), 9) AS farthest"
        " FROM (SELECT *, sqrt(center_x*center_x + center_y*center_y) AS dist FROM stats) GROUP BY 1, 2",
        "stats",
    ),
)
def foveation(spark, sf_dir):
    return grid.foveation(cells(spark, sf_dir))


@query(
    "prototype_metrics",
    q(
        "SELECT frame_id, count(*) AS cells, CAST(sum(point_count) AS BIGINT) AS points, count(DISTINCT level) AS levels, min(resolution) AS finest, max(resolution) AS coarsest,"
        " round(CAST(sum(point_count) AS DOUBLE) / count(*), 9) AS points_per_cell FROM cells GROUP BY frame_id",
        "cells",
    ),
)
def prototype_metrics(spark, sf_dir):
    return grid.prototype_metrics(cells(spark, sf_dir))


@query(
    "xy_bounds",
    q(
        "SELECT frame_id, round((xl+xh)/2 - half, 9) AS min_x, round((xl+xh)/2 + half, 9) AS max_x, round((yl+yh)/2 - half, 9) AS min_y, round((yl+yh)/2 + half, 9) AS max_y FROM"
        " (SELECT *, greatest(xh - xl, yh - yl) / 2 * 1.12 AS half FROM (SELECT frame_id, quantile_cont(x, 0.02) AS xl, quantile_cont(x, 0.98) AS xh, quantile_cont(y, 0.02) AS yl, quantile_cont(y, 0.98) AS yh FROM points GROUP BY frame_id))",
        "points",
    ),
)
def xy_bounds(spark, sf_dir):
    return grid.xy_bounds(points(spark, sf_dir))


@query("elevation_patches", q(f"SELECT {KEY}, center_x - resolution / 2 AS x0, center_y - resolution / 2 AS y0, resolution, ground_elevation FROM stats WHERE ground_count > 0", "stats"))
def elevation_patches(spark, sf_dir):
    return grid.elevation_patches(cells(spark, sf_dir))


@query(
    "xyz_ranges",
    q("SELECT frame_id, count(*) AS points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points GROUP BY frame_id", "points"),
)
def xyz_ranges(spark, sf_dir):
    return points(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


@query("points_so_far", q(f"SELECT frame_id, points, CAST(sum(points) OVER (PARTITION BY frame_id // {STRIDE} ORDER BY frame_id) AS BIGINT) AS points_so_far FROM (SELECT frame_id, CAST(sum(point_count) AS BIGINT) AS points FROM cells GROUP BY frame_id)", "cells"))
def points_so_far(spark, sf_dir):
    return grid.frame_running_points(cells(spark, sf_dir), sequence_id())


@query("out_of_range", q("SELECT frame_id, count(*) AS points, count(CASE WHEN lv IS NULL THEN 1 END) AS dropped FROM (SELECT frame_id, CASE WHEN x*x+y*y < 2500 THEN 1 END AS lv FROM points) GROUP BY frame_id", "points"))
def out_of_range(spark, sf_dir):
    """Points beyond the third ring."""
    return points(spark, sf_dir).groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("points"), F.count(F.when(F.coalesce(ring_level("x", "y"), F.lit(9)) > 2, 1)).alias("dropped")
    )


del r, rounded
