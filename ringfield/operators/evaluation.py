"""Object-level evaluation of proposals against labelled points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfield.config import GT_IDS
from ringfield.functions import classify
from ringfield.functions.geometry import centre, level_resolution, ring_level
from ringfield.operators.grid import KEY, with_cell
from ringfield.operators.semantic import unpack


def gt_points(points: DataFrame) -> DataFrame:
    rows = unpack(points).where(F.col("semantic_id").isin(*GT_IDS) & (F.col("instance_id") > 0))
    return rows.withColumn("gt_id", F.col("label"))


def gt_objects(points: DataFrame, least: int = 5) -> DataFrame:
    """Instances of object classes with enough points: centroid, distance, rank by distance."""
    g = gt_points(points).groupBy("frame_id", "gt_id", "semantic_id", "instance_id").agg(
        F.count(F.lit(1)).alias("points"), *[F.round(F.avg(c), 9).alias(f"center_{c}") for c in "xyz"]
    )
    g = g.where(F.col("points") >= least).withColumn("distance", F.round(F.sqrt(F.col("center_x") ** 2 + F.col("center_y") ** 2), 6))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy("distance", "gt_id")))


def proposal_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points in range inside the cells of each proposal, edges included, with their label if they have one; cells: KEY with
    object_id. A point on an edge may lie in cells of two proposals, and in a cell of another ring. Cells are
    spread to the tiles they touch, four at most, so points and cells meet on equal keys; a point has one tile, so
    its hits are told apart where they were found, without another shuffle."""
    tile, size = 0.5, level_resolution("level")
    lo, hi = (lambda c: centre(c, size) - size / 2), (lambda c: centre(c, size) + size / 2)
    box = cells.select("frame_id", "object_id", lo("ix").alias("_x0"), hi("ix").alias("_x1"), lo("iy").alias("_y0"), hi("iy").alias("_y1"))
    at = lambda c: F.floor(F.col(c) / tile)
    tiles = box.select("*", F.explode(F.sequence(at("_x0"), at("_x1"))).alias("_tx")).select("*", F.explode(F.sequence(at("_y0"), at("_y1"))).alias("_ty"))
    near = points.where(ring_level("x", "y").isNotNull()).select("frame_id", "point_id", "x", "y", *_label(points), at("x").alias("_tx"), at("y").alias("_ty"))
    hit = near.join(tiles, ["frame_id", "_tx", "_ty"]).where(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")))
    return hit.select("frame_id", "_tx", "_ty", "object_id", "point_id", *_label(points)).distinct().drop("_tx", "_ty")


def _label(points: DataFrame) -> list[str]:
    return ["label"] if "label" in points.columns else []


def overlaps(inside: DataFrame, truth: DataFrame) -> DataFrame:
    """(frame, proposal, gt): shared points, coverage of the gt, purity of the proposal, IoU. truth: gt_points(). Where
    the points inside carry their label, it names their gt, and one aggregation counts both sides."""
    if "label" in inside.columns:
        from ringfield.operators.graph import cut

        counts = cut(inside.groupBy("frame_id", "object_id", F.col("label").alias("gt_id")).agg(F.count(F.lit(1)).alias("overlap")))
        p = counts.groupBy("frame_id", "object_id").agg(F.sum("overlap").alias("proposal_points"))
        both = counts  # labels that are no gt's meet none below
    else:
        both = inside.join(truth.select("frame_id", "point_id", "gt_id"), ["frame_id", "point_id"]).groupBy("frame_id", "object_id", "gt_id").agg(F.count(F.lit(1)).alias("overlap"))
        p = inside.groupBy("frame_id", "object_id").agg(F.count(F.lit(1)).alias("proposal_points"))
    g = truth.groupBy("frame_id", "gt_id").agg(F.count(F.lit(1)).alias("gt_points"))
    o = both.join(p, ["frame_id", "object_id"]).join(g, ["frame_id", "gt_id"])
    n = F.col("overlap")
    return o.withColumns(
        {"coverage": n / F.col("gt_points"), "purity": n / F.col("proposal_points"), "iou": n / (F.col("gt_points") + F.col("proposal_points") - n)}
    )


def best_overlap(o: DataFrame) -> DataFrame:
    """The gt that shares most points with each proposal, the smaller id on ties."""
    w = Window.partitionBy("frame_id", "object_id").orderBy(F.desc("overlap"), "gt_id")
    return o.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def match_one_to_one(o: DataFrame, least: float = 0.2) -> DataFrame:
    """Greedy matching by (coverage, iou, purity, overlap), best first: in each round the pairs
    that are best for both of their sides are taken, which under a total order is the same."""
    from ringfield.operators.graph import cut

    order = [F.desc("coverage"), F.desc("iou"), F.desc("purity"), F.desc("overlap"), "object_id", "gt_id"]
    left = cut(o.where(F.col("coverage") >= least))
    out = None
    while True:
        ranked = left.withColumn("_p", F.row_number().over(Window.partitionBy("frame_id", "object_id").orderBy(*order))).withColumn(
            "_g", F.row_number().over(Window.partitionBy("frame_id", "gt_id").orderBy(*order))
        )
        best = cut(ranked.where("_p = 1 AND _g = 1").drop("_p", "_g"))
        out = best if out is None else out.unionByName(best)
        left = cut(left.join(best.select("frame_id", "object_id"), ["frame_id", "object_id"], "left_anti").join(best.select("frame_id", "gt_id"), ["frame_id", "gt_id"], "left_anti"))
        if left.isEmpty():
            return out


def detection_prf(o: DataFrame, proposals: DataFrame, gts: DataFrame, least: float = 0.2) -> DataFrame:
    """Recall over gts with coverage, precision over proposals with purity, and F1, by frame."""
    hit_g = o.where(F.col("coverage") >= least).select("frame_id", "gt_id").distinct().groupBy("frame_id").agg(F.count(F.lit(1)).alias("found"))
    hit_p = o.where(F.col("purity") >= least).select("frame_id", "object_id").distinct().groupBy("frame_id").agg(F.count(F.lit(1)).alias("right"))
    g, p = gts.groupBy("frame_id").agg(F.count(F.lit(1)).alias("gts")), proposals.groupBy("frame_id").agg(F.count(F.lit(1)).alias("proposals"))
    f = g.join(p, "frame_id", "full").join(hit_g, "frame_id", "left").join(hit_p, "frame_id", "left").na.fill(0)
    recall, precision = F.when(F.col("gts") > 0, F.col("found") / F.col("gts")).otherwise(0.0), F.when(F.col("proposals") > 0, F.col("right") / F.col("proposals")).otherwise(0.0)
    f = f.withColumns({"recall": recall, "precision": precision})
    return f.withColumn("f1", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0))


def recall_by_bucket(o: DataFrame, gts: DataFrame, least: float = 0.2) -> DataFrame:
    found = o.where(F.col("coverage") >= least).select("frame_id", "gt_id").distinct().withColumn("_f", F.lit(1))
    rows = gts.join(found, ["frame_id", "gt_id"], "left")
    return rows.groupBy(classify.distance_bucket(F.col("distance")).alias("bucket"), "semantic_id").agg(
        F.count(F.lit(1)).alias("gts"), F.count("_f").alias("found"), F.round(F.count("_f") / F.count(F.lit(1)), 9).alias("recall")
    )


def fragmentation(o: DataFrame, least: float = 0.2) -> DataFrame:
    """Proposals beyond the first that cover part of each gt."""
    per = o.where(F.col("purity") >= least).groupBy("frame_id", "gt_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("frame_id").agg(F.count(F.lit(1)).alias("covered"), F.sum(F.col("n") - 1).alias("fragments"))


def contested(o: DataFrame, least: float = 0.2) -> DataFrame:
    """Proposals that qualify, by coverage and purity, for more than one gt."""
    return o.where((F.col("coverage") >= least) & (F.col("purity") >= least)).groupBy("frame_id", "object_id").agg(F.count(F.lit(1)).alias("gts")).where("gts > 1")


def confusion(best: DataFrame, proposals: DataFrame) -> DataFrame:
    rows = best.join(proposals.select("frame_id", "object_id", "classification"), ["frame_id", "object_id"])
    return rows.groupBy("classification", F.col("gt_id").bitwiseAND(65535).alias("semantic_id")).agg(F.count(F.lit(1)).alias("objects"))


def cell_instances(points: DataFrame) -> DataFrame:
    """Distinct instances of each cell, as a sorted array."""
    rows = unpack(with_cell(points)).where("instance_id > 0")
    return rows.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set("instance_id")), ",").alias("instances"))


def stage_funnel(points: DataFrame, obstacles: DataFrame, kept_cells: DataFrame) -> DataFrame:
    """Points of gt objects that survive each stage: in range, not ground, in an obstacle cell, in a kept component."""
    truth = with_cell(gt_points(points)).join(obstacles.select(*KEY, F.lit(1).alias("_o")), KEY, "left").join(kept_cells.select(*KEY, F.lit(1).alias("_k")), KEY, "left")
    up = ~F.col("is_ground")
    return truth.groupBy("frame_id", "gt_id").agg(
        F.count(F.lit(1)).alias("in_range"), F.count(F.when(up, 1)).alias("not_ground"),
        F.count(F.when(up, F.col("_o"))).alias("obstacle"), F.count(F.when(up, F.col("_k"))).alias("component"),
    )


def batch_eval(prf: DataFrame) -> DataFrame:
    """All frames together: micro from sums, macro from means."""
    s = lambda c: F.sum(c)
    f1 = lambda r, p: F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0)
    return prf.agg(
        F.count(F.lit(1)).alias("frames"), s("gts").alias("gts"), s("proposals").alias("proposals"),
        F.round(s("found") / s("gts"), 9).alias("micro_recall"), F.round(s("right") / s("proposals"), 9).alias("micro_precision"),
        F.round(F.avg("recall"), 9).alias("macro_recall"), F.round(F.avg("precision"), 9).alias("macro_precision"),
        F.round(f1(s("found") / s("gts"), s("right") / s("proposals")), 9).alias("micro_f1"), F.round(F.avg("f1"), 9).alias("macro_f1"),
    )
