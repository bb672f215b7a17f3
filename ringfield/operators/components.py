"""Linking obstacle cells into components and components into objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.functions import classify
from ringfield.functions.geometry import gap
from ringfield.operators.graph import components_within


def bucket_pairs(rows: DataFrame, by: list[str], x: str, y: str, size: float, reach: int = 1) -> DataFrame:
    """Each pair of rows with equal `by` whose buckets of `size` are at most `reach` apart, once,
    as columns a_* and b_* with a_id < b_id. One side is spread to the buckets around it, so
    equal keys meet."""
    name = lambda p: [F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in by]
    bx, by_ = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    spread = F.explode(F.array(*[F.struct((bx + i).alias("i"), (by_ + j).alias("j")) for i, j in steps]))
    left = rows.select(*by, *name("a"), spread.alias("_n")).select("*", F.col("_n.i").alias("_bx"), F.col("_n.j").alias("_by")).drop("_n")
    right = rows.select(*by, *name("b"), bx.alias("_bx"), by_.alias("_by"))
    return left.join(right, [*by, "_bx", "_by"]).where("a_id < b_id").drop("_bx", "_by")


def _box(p: str, half: Column | None = None) -> tuple[Column, Column, Column, Column]:
    if half is None:
        return tuple(F.col(f"{p}_{c}") for c in ("min_x", "max_x", "min_y", "max_y"))
    x, y = F.col(f"{p}_center_x"), F.col(f"{p}_center_y")
    return x - half, x + half, y - half, y + half


def cell_links(obstacles: DataFrame) -> DataFrame:
    """(frame_id, a, b) for obstacle cells whose footprints nearly touch and heights agree."""
    rows = obstacles.select("frame_id", F.col("cell_id").alias("id"), "center_x", "center_y", "resolution", "obstacle_height")
    pairs = bucket_pairs(rows, ["frame_id"], "center_x", "center_y", 0.5)
    ax0, ax1, ay0, ay1 = _box("a", F.col("a_resolution") / 2)
    bx0, bx1, by0, by1 = _box("b", F.col("b_resolution") / 2)
    gx, gy = gap(ax0, ax1, bx0, bx1), gap(ay0, ay1, by0, by1)
    r = F.greatest("a_resolution", "b_resolution")
    close = F.sqrt(gx * gx + gy * gy) <= F.greatest(F.lit(0.25), 0.75 * r)
    level = F.abs(F.col("a_obstacle_height") - F.col("b_obstacle_height")) <= F.greatest(F.lit(0.75), 2.0 * r)
    return pairs.where(close & level).select("frame_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def cell_components(obstacles: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """obstacles with component_id: the least cell of the component."""
    links = cell_links(obstacles) if links is None else links
    found = components_within("frame_id", obstacles.select("frame_id", F.col("cell_id").alias("id")), links).drop("frame_id")
    return obstacles.join(found.select(F.col("id").alias("cell_id"), F.col("component").alias("component_id")), "cell_id")


def component_features(cells: DataFrame) -> DataFrame:
    """cells with component_id -> one row a component."""
    half = F.col("resolution") / 2
    agg = cells.groupBy("frame_id", "component_id").agg(
        F.count(F.lit(1)).alias("cell_count"), F.sum("obstacle_count").alias("point_count"),
        F.avg("center_x").alias("center_x"), F.avg("center_y").alias("center_y"),
        F.min(F.col("center_x") - half).alias("min_x"), F.max(F.col("center_x") + half).alias("max_x"),
        F.min(F.col("center_y") - half).alias("min_y"), F.max(F.col("center_y") + half).alias("max_y"),
        F.min("ground_elevation").alias("min_z"), F.max("obstacle_elevation").alias("max_z"),
        F.max("obstacle_height").alias("max_height"), F.avg("obstacle_height").alias("mean_height"),
        F.sum("obstacle_height").alias("height_sum"), F.max("resolution").alias("resolution"),
    )
    return _dimensions(agg)


def _dimensions(df: DataFrame) -> DataFrame:
    x, y = F.col("center_x"), F.col("center_y")
    df = df.withColumns({"width": F.col("max_x") - F.col("min_x"), "length": F.col("max_y") - F.col("min_y"), "height": F.col("max_z") - F.col("min_z")})
    return df.withColumns(
        {
            "distance": F.sqrt(x * x + y * y),
            "density": F.col("point_count") / F.greatest(F.col("width") * F.col("length"), F.lit(1e-6)),
        }
    )


def component_filter(features: DataFrame, min_cells: int = 3, min_points: int = 5) -> DataFrame:
    return features.where((F.col("cell_count") >= min_cells) & (F.col("point_count") >= min_points))


def classify_components(features: DataFrame) -> DataFrame:
    height = F.greatest("height", "max_height")
    return features.withColumn("classification", classify.shape_class(F.col("width"), F.col("length"), height, F.col("point_count"), 2.5))


def component_links(features: DataFrame) -> DataFrame:
    """(frame_id, a, b) for components that are likely parts of one object: near centres of like
    height, or two thin upright ones, or close boxes. No rule reaches beyond 2 m."""
    keep = ["center_x", "center_y", "width", "length", "min_x", "max_x", "min_y", "max_y", "max_height", "resolution"]
    pairs = bucket_pairs(features.select("frame_id", F.col("component_id").alias("id"), *keep), ["frame_id"], "center_x", "center_y", 2.0)
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    dx, dy = a("center_x") - b("center_x"), a("center_y") - b("center_y")
    d = F.sqrt(dx * dx + dy * dy)
    dh = F.abs(a("max_height") - b("max_height"))
    near = (d <= F.greatest(F.lit(0.75), 4.0 * F.greatest(a("resolution"), b("resolution")))) & (dh <= 1.0)
    thin = (d <= 1.5) & (a("max_height") >= 1.2) & (b("max_height") >= 1.2)
    for c in (a("width"), a("length"), b("width"), b("length")):
        thin = thin & (c <= 1.5)
    margin = F.greatest(F.lit(0.75), 0.5 * F.greatest(a("width"), a("length"), b("width"), b("length")))
    ax0, ax1, ay0, ay1 = _box("a")
    bx0, bx1, by0, by1 = _box("b")
    boxes = (ax0 <= bx1 + margin) & (ax1 >= bx0 - margin) & (ay0 <= by1 + margin) & (ay1 >= by0 - margin)
    return pairs.where(near | thin | ((d <= 2.0) & boxes & (dh <= 1.25))).select("frame_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def group_members(features: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """features with object_id: the least component of the object."""
    links = component_links(features) if links is None else links
    found = components_within("frame_id", features.select("frame_id", F.col("component_id").alias("id")), links).drop("frame_id")
    return features.join(found.select(F.col("id").alias("component_id"), F.col("component").alias("object_id")), "component_id")


def object_groups(members: DataFrame) -> DataFrame:
    """One row an object: centre weighted by points, joint box, mean height over all cells."""
    w = F.greatest(F.col("point_count"), F.lit(1)).cast("double")
    agg = members.groupBy("frame_id", "object_id").agg(
        F.count(F.lit(1)).alias("component_count"), F.sum("cell_count").alias("cell_count"),
        (F.sum(F.col("center_x") * w) / F.sum(w)).alias("center_x"), (F.sum(F.col("center_y") * w) / F.sum(w)).alias("center_y"),
        F.sum("point_count").alias("point_count"),
        *[F.min(f"min_{c}").alias(f"min_{c}") for c in "xyz"], *[F.max(f"max_{c}").alias(f"max_{c}") for c in "xyz"],
        F.max("max_height").alias("max_height"), (F.sum("height_sum") / F.sum("cell_count")).alias("mean_height"),
    )
    return _dimensions(agg)


def proposals(groups: DataFrame) -> DataFrame:
    """Objects with class and confidence, numbered by distance inside their frame."""
    c = F.col
    return groups.select(
        "frame_id", "object_id", "center_x", "center_y", "width", "length", "height", "min_x", "max_x", "min_y", "max_y",
        classify.shape_class(c("width"), c("length"), c("height"), c("point_count"), 2.0).alias("classification"),
        classify.confidence(c("point_count"), c("cell_count"), c("max_height"), c("mean_height"), c("density")).alias("confidence"),
        "distance", "point_count", "cell_count", "max_height", "mean_height", "density", "component_count",
    )
