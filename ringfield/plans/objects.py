"""Queries from obstacle cells to object proposals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ringfield.functions import classify
from ringfield.operators import components as c
from ringfield.operators import obstacles as o
from ringfield.operators.graph import cut
from ringfield.plans.grid import cells
from ringfield.plans.registry import query, rounded
from ringfield.plans.sql import bucket, shape
from ringfield.plans.sql import query as q
from ringfield.plans.sql import rounded as r

KEY = "frame_id, level, ix, iy"
HEIGHTS = "ground_elevation obstacle_height"


def obstacles(spark, sf_dir):
    """Written once: each later step reads them twice or more, and they are few beside the points."""
    return cut(o.obstacle_cells(cut(cells(spark, sf_dir))))


def features(spark, sf_dir):
    return cut(c.component_features(c.cell_components(obstacles(spark, sf_dir))))


def groups(spark, sf_dir):
    return c.object_groups(c.group_members(c.component_filter(features(spark, sf_dir))))


@query("local_ground", q(f"SELECT {KEY}, round(local_elevation, 9) AS local_elevation, neighbors FROM local", "local"))
def local_ground(spark, sf_dir):
    return rounded(o.local_ground(cut(cells(spark, sf_dir))), "local_elevation")


@query("obstacle_cells", q(f"SELECT cell_id, {KEY}, resolution, center_x, center_y, obstacle_elevation, obstacle_count, ground_source, {r(HEIGHTS)} FROM obstacles", "obstacles"))
def obstacle_cells(spark, sf_dir):
    return rounded(obstacles(spark, sf_dir), HEIGHTS)


@query(
    "topk_obstacles",
    q(f"SELECT cell_id, frame_id, round(obstacle_height, 9) AS obstacle_height, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY round(obstacle_height, 9) DESC, cell_id) AS INTEGER) AS rank FROM obstacles) WHERE rank <= 15", "obstacles"),
)
def topk_obstacles(spark, sf_dir):
    """The 15 highest cells of each frame."""
    w = Window.partitionBy("frame_id").orderBy(F.desc("obstacle_height"), "cell_id")
    rows = rounded(obstacles(spark, sf_dir), "obstacle_height").withColumn("rank", F.row_number().over(w))
    return rows.where("rank <= 15").select("cell_id", "frame_id", "obstacle_height", "rank")


@query(
    "obstacle_range_summary",
    q(
        "SELECT frame_id, count(CASE WHEN t < 25 THEN 1 END) AS near, count(CASE WHEN t >= 25 AND t < 50 THEN 1 END) AS mid, count(CASE WHEN t >= 50 THEN 1 END) AS far"
        " FROM (SELECT frame_id, sqrt(center_x*center_x + center_y*center_y) AS t FROM obstacles) GROUP BY frame_id",
        "obstacles",
    ),
)
def obstacle_range_summary(spark, sf_dir):
    return o.range_summary(obstacles(spark, sf_dir))


@query("cell_links", q("SELECT frame_id, a, b FROM links", "links"))
def cell_links(spark, sf_dir):
    return c.cell_links(obstacles(spark, sf_dir))


@query("cell_components", q("SELECT cell_id, frame_id, component_id FROM component_cells", "component_cells"))
def cell_components(spark, sf_dir):
    return c.cell_components(obstacles(spark, sf_dir)).select("cell_id", "frame_id", "component_id")


FEATURES = "center_x center_y min_x max_x min_y max_y min_z max_z max_height mean_height width length height distance density"


@query("component_features", q(f"SELECT frame_id, component_id, cell_count, point_count, resolution, {r(FEATURES, 6)} FROM features", "features"))
def component_features(spark, sf_dir):
    return rounded(features(spark, sf_dir).drop("height_sum"), FEATURES, 6)


@query("component_filter", q("SELECT frame_id, component_id, cell_count, point_count FROM kept", "kept"))
def component_filter(spark, sf_dir):
    return c.component_filter(features(spark, sf_dir)).select("frame_id", "component_id", "cell_count", "point_count")


@query("classify_component", q(f"SELECT frame_id, component_id, {shape('greatest(height, max_height)', 2.5)} AS classification FROM features", "features"))
def classify_component(spark, sf_dir):
    return c.classify_components(features(spark, sf_dir)).select("frame_id", "component_id", "classification")


@query("component_links", q("SELECT frame_id, a, b FROM object_links", "object_links"))
def component_links(spark, sf_dir):
    return c.component_links(c.component_filter(features(spark, sf_dir)))


@query("associate_components", q("SELECT frame_id, component_id, object_id FROM members", "members"))
def associate_components(spark, sf_dir):
    return c.group_members(c.component_filter(features(spark, sf_dir))).select("frame_id", "component_id", "object_id")


@query("object_groups", q(f"SELECT frame_id, object_id, component_count, cell_count, point_count, {r(FEATURES, 6)} FROM groups", "groups"))
def object_groups(spark, sf_dir):
    return rounded(groups(spark, sf_dir), FEATURES, 6)


@query("classify_group", q(f"SELECT frame_id, object_id, {shape('height', 2.0)} AS classification FROM groups", "groups"))
def classify_group(spark, sf_dir):
    return c.proposals(groups(spark, sf_dir)).select("frame_id", "object_id", "classification")


@query("proposal_confidence", q("SELECT frame_id, object_id, round(confidence, 6) AS confidence FROM proposals", "proposals"))
def proposal_confidence(spark, sf_dir):
    return rounded(c.proposals(groups(spark, sf_dir)), "confidence", 6).select("frame_id", "object_id", "confidence")


PROPOSAL = "center_x center_y width length height confidence distance max_height mean_height density"


@query("proposals", q(f"SELECT frame_id, object_id, classification, point_count, cell_count, component_count, {r(PROPOSAL, 6)} FROM proposals", "proposals"))
def proposals(spark, sf_dir):
    return rounded(c.proposals(groups(spark, sf_dir)), PROPOSAL, 6).drop("min_x", "max_x", "min_y", "max_y")


@query(
    "rank_by_distance",
    q("SELECT frame_id, object_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY round(distance, 6), object_id) AS INTEGER) AS rank, round(distance, 6) AS distance FROM groups", "groups"),
)
def rank_by_distance(spark, sf_dir):
    rows = rounded(groups(spark, sf_dir).select("frame_id", "object_id", "distance"), "distance", 6)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy("distance", "object_id")))


@query("distance_bucket", q(f"SELECT frame_id, {bucket('distance')} AS bucket, classification, count(*) AS objects FROM proposals GROUP BY 1, 2, 3", "proposals"))
def distance_bucket(spark, sf_dir):
    return c.proposals(groups(spark, sf_dir)).groupBy("frame_id", classify.distance_bucket(F.col("distance")).alias("bucket"), "classification").agg(F.count(F.lit(1)).alias("objects"))


@query(
    "proposal_labels",
    q("SELECT frame_id, object_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY round(confidence, 6) DESC, round(distance, 6), object_id) AS INTEGER) AS rank FROM proposals) WHERE rank <= 4", "proposals"),
)
def proposal_labels(spark, sf_dir):
    """The four most certain, then nearest proposals of a frame."""
    rows = rounded(c.proposals(groups(spark, sf_dir)), "confidence distance", 6)
    w = Window.partitionBy("frame_id").orderBy(F.desc("confidence"), "distance", "object_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("frame_id", "object_id", "rank")


@query(
    "frame_metrics",
    q(
        "SELECT p.frame_id, p.points, coalesce(c.cells, 0) AS cells, coalesce(o.obstacle_cells, 0) AS obstacle_cells, coalesce(k.components, 0) AS components, coalesce(g.objects, 0) AS objects"
        " FROM (SELECT frame_id, count(*) AS points FROM points GROUP BY frame_id) p LEFT JOIN (SELECT frame_id, count(*) AS cells FROM cells GROUP BY frame_id) c USING (frame_id)"
        " LEFT JOIN (SELECT frame_id, count(*) AS obstacle_cells FROM obstacles GROUP BY frame_id) o USING (frame_id) LEFT JOIN (SELECT frame_id, count(*) AS components FROM kept GROUP BY frame_id) k USING (frame_id)"
        " LEFT JOIN (SELECT frame_id, count(*) AS objects FROM groups GROUP BY frame_id) g USING (frame_id)",
        "groups",
    ),
)
def frame_metrics(spark, sf_dir):
    from ringfield.sources.derived import points

    p = points(spark, sf_dir)
    n = lambda df, name: df.groupBy("frame_id").agg(F.count(F.lit(1)).alias(name))
    grid = cut(cells(spark, sf_dir))
    found = cut(o.obstacle_cells(grid))
    kept = cut(c.component_filter(c.component_features(c.cell_components(found))))
    out = n(p, "points")
    for df, name in ((grid, "cells"), (found, "obstacle_cells"), (kept, "components"), (c.object_groups(c.group_members(kept)), "objects")):
        out = out.join(n(df, name), "frame_id", "left")
    return out.na.fill(0)
