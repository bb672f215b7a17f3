"""Terrain-relative obstacle cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.config import Obstacles
from ringfield.functions.geometry import cell_id, centre
from ringfield.operators.grid import KEY, cell_stats


def local_ground(cells: DataFrame, cfg: Obstacles = Obstacles(), want: DataFrame | None = None) -> DataFrame:
    """Ground height for cells with obstacle points but no ground (or for those of `want`: KEY, resolution),
    from ground cells of the same level within cfg.radius cells on both axes, weighted by inverse distance.

    Cells meet by tiles one cell wider than the radius: a cell looks in the nine tiles around its
    own, so the join is on equal keys and the window test is left over."""
    tile = cfg.radius + 1
    if want is None:
        want = cells.where((F.col("ground_count") == 0) & (F.col("obstacle_count") >= cfg.min_points))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    want = want.select(*KEY, "resolution", around.alias("_n"))
    want = want.select(
        *KEY, "resolution",
        (F.floor(F.col("ix") / tile) + F.col("_n.i")).alias("_tx"), (F.floor(F.col("iy") / tile) + F.col("_n.j")).alias("_ty"),
    )
    have = cells.where("ground_count > 0").select(
        "frame_id", "level", F.col("ix").alias("gx"), F.col("iy").alias("gy"), (F.col("ground_z_sum") / F.col("ground_count")).alias("gz"),
        F.floor(F.col("ix") / tile).alias("_tx"), F.floor(F.col("iy") / tile).alias("_ty"),
    )
    dx, dy = F.col("gx") - F.col("ix"), F.col("gy") - F.col("iy")
    near = want.join(have, ["frame_id", "level", "_tx", "_ty"]).where((F.abs(dx) <= cfg.radius) & (F.abs(dy) <= cfg.radius))
    w = F.lit(1.0) / (F.sqrt((dx * dx + dy * dy).cast("double")) * F.col("resolution") + F.lit(cfg.softening))
    return near.groupBy(*KEY).agg((F.sum(w * F.col("gz")) / F.sum(w)).alias("local_elevation"), F.count(F.lit(1)).alias("neighbors"))


def obstacle_cells(cells: DataFrame, cfg: Obstacles = Obstacles()) -> DataFrame:
    """Cells that stand out of the terrain, with the source of their ground height: the cell
    itself or its neighbours. Cells without any ground near are left out."""
    c = cell_stats(cells).where(F.col("obstacle_count") >= cfg.min_points).join(local_ground(cells, cfg), KEY, "left")
    ground = F.coalesce("ground_elevation", "local_elevation")
    return (
        c.withColumn("ground_source", F.when(F.col("ground_count") > 0, "cell").otherwise("neighbor"))
        .withColumn("ground_elevation", ground)
        .withColumn("obstacle_height", F.col("obstacle_elevation") - F.col("ground_elevation"))
        .where(F.col("obstacle_height") >= cfg.min_height)
        .select(
            cell_id().alias("cell_id"), *KEY, "resolution", "center_x", "center_y", "ground_elevation", "obstacle_elevation",
            "obstacle_height", "obstacle_count", "ground_source",
        )
    )


def range_summary(obstacles: DataFrame) -> DataFrame:
    """Obstacle cells near (under 25 m), mid (under 50 m) and far."""
    x, y = centre("ix", "resolution"), centre("iy", "resolution")
    d = F.sqrt(x * x + y * y)
    n = lambda on, name: F.count(F.when(on, 1)).alias(name)
    return obstacles.groupBy("frame_id").agg(n(d < 25, "near"), n((d >= 25) & (d < 50), "mid"), n(d >= 50, "far"))
