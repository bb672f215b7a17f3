"""The adaptive grid and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfield.config import MAX_RANGE
from ringfield.functions import classify
from ringfield.functions.geometry import cell_index, centre, level_resolution, ring_level

KEY = ["frame_id", "level", "ix", "iy"]


def in_range(points: DataFrame, radius: float = MAX_RANGE, closed: bool = False) -> DataFrame:
    """Points nearer than radius; the detector's variant takes the circle itself too."""
    d2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    return points.where(d2 <= radius**2 if closed else d2 < radius**2)


def with_cell(points: DataFrame) -> DataFrame:
    """Adds level, resolution, ix, iy; points out of range go."""
    rows = in_range(points).withColumn("level", ring_level("x", "y")).withColumn("resolution", level_resolution("level"))
    return rows.withColumn("ix", cell_index("x", "resolution")).withColumn("iy", cell_index("y", "resolution"))


def adaptive_grid(points: DataFrame) -> DataFrame:
    """One row a cell: counts, sums, least and greatest z, apart for ground and obstacle points.
    All are algebraic, so partial sums are formed before the one shuffle, and grids of parts of a
    frame add up with merged()."""
    ground, z = F.col("is_ground"), F.col("z")
    side = lambda name, on: [
        F.count(F.when(on, 1)).alias(f"{name}_count"),
        F.sum(F.when(on, z)).alias(f"{name}_z_sum"),
        F.min(F.when(on, z)).alias(f"{name}_z_min"),
        F.max(F.when(on, z)).alias(f"{name}_z_max"),
    ]
    grouped = with_cell(points).groupBy(*KEY).agg(
        F.first("resolution").alias("resolution"), F.count(F.lit(1)).alias("point_count"), *side("ground", ground), *side("obstacle", ~ground)
    )
    return grouped.withColumns({f"{n}_z_sum": F.coalesce(f"{n}_z_sum", F.lit(0.0)) for n in ("ground", "obstacle")})


def merged(cells: DataFrame) -> DataFrame:
    """One grid from the grids of parts of the points."""
    names = [c for c in cells.columns if c not in (*KEY, "resolution")]
    how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    return cells.groupBy(*KEY).agg(F.first("resolution").alias("resolution"), *[how[n.rsplit("_", 1)[1]](n).alias(n) for n in names])


def cell_stats(cells: DataFrame) -> DataFrame:
    """Adds elevations (null without points of the kind), z_mean, z_min, z_max, class and centre."""
    g, o = F.col("ground_count"), F.col("obstacle_count")
    return cells.withColumns(
        {
            "ground_elevation": F.when(g > 0, F.col("ground_z_sum") / g),
            "obstacle_elevation": F.when(o > 0, F.col("obstacle_z_sum") / o),
            "z_mean": (F.col("ground_z_sum") + F.col("obstacle_z_sum")) / F.col("point_count"),
            "z_min": F.least("ground_z_min", "obstacle_z_min"),
            "z_max": F.greatest("ground_z_max", "obstacle_z_max"),
            "cell_class": classify.cell_class(g, o),
            "center_x": centre("ix", "resolution"),
            "center_y": centre("iy", "resolution"),
        }
    )


def cell_parent(cells: DataFrame) -> DataFrame:
    """The cell of the next level that holds the centre; the last level has none."""
    up = level_resolution(F.col("level") + 1)
    return cells.where("level < 3").select(
        *KEY,
        (F.col("level") + 1).alias("parent_level"),
        cell_index(centre("ix", "resolution"), up).alias("parent_ix"),
        cell_index(centre("iy", "resolution"), up).alias("parent_iy"),
    )


def grid_stats(cells: DataFrame) -> DataFrame:
    """Cells and points of each level, also of levels without any."""
    frames = cells.select("frame_id").distinct()
    every = frames.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    found = cells.groupBy("frame_id", "level").agg(F.count(F.lit(1)).alias("cells"), F.sum("point_count").alias("points"))
    return every.join(found, ["frame_id", "level"], "left").na.fill(0, ["cells", "points"])


def class_histogram(cells: DataFrame) -> DataFrame:
    cls = classify.cell_class(F.col("ground_count"), F.col("obstacle_count"))
    return cells.groupBy("frame_id", "level", cls.alias("cell_class")).agg(F.count(F.lit(1)).alias("cells"))


def uniform_grid(points: DataFrame, size: float = 0.05) -> DataFrame:
    rows = in_range(points).withColumn("_s", F.lit(size))
    return rows.groupBy("frame_id", cell_index("x", "_s").alias("ix"), cell_index("y", "_s").alias("iy")).agg(
        F.count(F.lit(1)).alias("point_count"), F.sum("z").alias("z_sum")
    )


def storage_compare(points: DataFrame, cells: DataFrame, bytes_a_cell: int = 40) -> DataFrame:
    """Cells and bytes of the adaptive, the sparse uniform and the dense uniform grid of a frame."""
    a = cells.groupBy("frame_id").agg(F.count(F.lit(1)).alias("adaptive_cells"))
    u = uniform_grid(points).groupBy("frame_id").agg(F.count(F.lit(1)).alias("uniform_cells"))
    dense = F.ceil(F.lit(3.141592653589793) * 100.0 * 100.0 / (F.lit(0.05) * F.lit(0.05)))
    both = a.join(u, "frame_id").withColumn("dense_cells", dense.cast("long"))
    return both.select(
        "*",
        *[(F.col(f"{k}_cells") * bytes_a_cell).alias(f"{k}_bytes") for k in ("adaptive", "uniform", "dense")],
        F.round((1.0 - F.col("adaptive_cells") / F.col("uniform_cells")) * 100.0, 6).alias("reduction_percent"),
    )


def voxel_downsample(points: DataFrame, size: float = 0.5) -> DataFrame:
    """Mean point of each voxel; the lattice starts half a voxel below the frame's least corner."""
    low = points.groupBy("frame_id").agg(*[(F.min(c) - size / 2).alias(f"_{c}0") for c in "xyz"])
    rows = points.join(low, "frame_id")
    voxel = [F.floor((F.col(c) - F.col(f"_{c}0")) / size).cast("long").alias(f"v{c}") for c in "xyz"]
    return rows.groupBy("frame_id", *voxel).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in "xyz"])


def voxel_reduction(points: DataFrame, sizes: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5)) -> DataFrame:
    """Voxels and the share of points saved, for each size: one pass with a row a size."""
    low = points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), *[F.min(c).alias(f"_{c}0") for c in "xyz"])
    rows = points.join(low, "frame_id").withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    voxel = [F.floor((F.col(c) - (F.col(f"_{c}0") - F.col("size") / 2)) / F.col("size")).cast("long").alias(f"v{c}") for c in "xyz"]
    found = rows.groupBy("frame_id", "size", "points", *voxel).agg(F.lit(1).alias("_1")).groupBy("frame_id", "size", "points").agg(F.count(F.lit(1)).alias("voxels"))
    return found.withColumn("reduction_percent", F.round((1.0 - F.col("voxels") / F.col("points")) * 100.0, 6))


def display_elevation(cells: DataFrame) -> DataFrame:
    """What the two viewers show for a cell's height, in their orders of preference."""
    c = cell_stats(cells)
    return c.select(
        *KEY,
        F.coalesce("obstacle_elevation", "ground_elevation", "z_mean", F.lit(0.0)).alias("viewer_z"),
        F.coalesce("ground_elevation", "z_mean", (F.col("z_min") + F.col("z_max")) / 2, "z_min", "z_max", "obstacle_elevation").alias("web_z"),
    )


def traversability(cells: DataFrame) -> DataFrame:
    cls = classify.cell_class(F.col("ground_count"), F.col("obstacle_count"))
    return cells.select(*KEY, classify.traversability(cls).alias("traversability"), F.when(cls == "GROUND", 0).otherwise(1).alias("terrain"))


def elevation_range(cells: DataFrame) -> DataFrame:
    z = F.col("web_z")
    shown = display_elevation(cells).groupBy("frame_id").agg(F.min(z).alias("z_low"), F.max(z).alias("z_high"))
    return shown


def focus_box(cells: DataFrame) -> DataFrame:
    """Footprint that holds all cells of a frame."""
    half, x, y = F.col("resolution") / 2, centre("ix", "resolution"), centre("iy", "resolution")
    return cells.groupBy("frame_id").agg(
        F.min(x - half).alias("min_x"), F.max(x + half).alias("max_x"), F.min(y - half).alias("min_y"), F.max(y + half).alias("max_y")
    )


def foveation(cells: DataFrame) -> DataFrame:
    """Cells of each size and how near and far from the sensor their centres lie."""
    x, y = centre("ix", "resolution"), centre("iy", "resolution")
    d = F.sqrt(x * x + y * y)
    return cells.groupBy("frame_id", F.round("resolution", 4).alias("resolution")).agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.min(d), 9).alias("nearest"), F.round(F.max(d), 9).alias("farthest")
    )


def prototype_metrics(cells: DataFrame) -> DataFrame:
    return cells.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("point_count").alias("points"),
        F.count_distinct("level").alias("levels"),
        F.min("resolution").alias("finest"),
        F.max("resolution").alias("coarsest"),
        F.round(F.sum("point_count") / F.count(F.lit(1)), 9).alias("points_per_cell"),
    )


def xy_bounds(points: DataFrame, low: float = 0.02, high: float = 0.98, pad: float = 0.12) -> DataFrame:
    """A padded square around the middle share of a frame's points."""
    q = points.groupBy("frame_id").agg(*[F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in "xy" for n, p in (("lo", low), ("hi", high))])
    half = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo")) / 2 * (1 + pad)
    mid = lambda c: (F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2
    return q.select("frame_id", *[F.round(mid(c) + s * half, 9).alias(f"{n}_{c}") for c in "xy" for n, s in (("min", -1), ("max", 1))])


def elevation_patches(cells: DataFrame) -> DataFrame:
    """Cells with ground, as squares with a height."""
    c, half = cell_stats(cells), F.col("resolution") / 2
    return c.where("ground_count > 0").select(*KEY, (F.col("center_x") - half).alias("x0"), (F.col("center_y") - half).alias("y0"), "resolution", "ground_elevation")


def frame_running_points(cells: DataFrame, sequence: Column) -> DataFrame:
    """Points mapped up to and with each frame of a sequence; sequence tells a frame's."""
    per = cells.groupBy("frame_id").agg(F.sum("point_count").alias("points"))
    return per.withColumn("points_so_far", F.sum("points").over(Window.partitionBy(sequence).orderBy("frame_id")))
