"""What went wrong with proposals: purity, merges, matches over time, loss by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.config import OBSTACLE_LABELS, PREFERRED, SURFACE_LABELS


def proposal_purity(inside: DataFrame, labelled: DataFrame) -> DataFrame:
    """The most frequent class among each proposal's points (smallest id on ties) and its share."""
    n = inside.select("frame_id", "object_id", "point_id").join(labelled.select("frame_id", "point_id", "semantic_id"), ["frame_id", "point_id"]).groupBy("frame_id", "object_id", "semantic_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("frame_id", "object_id").agg(
        F.max_by("semantic_id", F.struct("n", -F.col("semantic_id"))).alias("semantic_id"), F.sum("n").alias("points"), F.round(F.max("n") / F.sum("n"), 9).alias("purity")
    )


def box_instances(boxes: DataFrame, labelled: DataFrame, tile: float = 4.0) -> DataFrame:
    """Distinct instances with a point inside each box, edges included. Boxes are spread to the
    tiles they touch, so points and boxes meet on equal keys."""
    at = lambda c: F.floor(F.col(c) / tile)
    tiles = boxes.select("frame_id", "object_id", "min_x", "max_x", "min_y", "max_y", F.explode(F.sequence(at("min_x"), at("max_x"))).alias("_tx"))
    tiles = tiles.select("*", F.explode(F.sequence(at("min_y"), at("max_y"))).alias("_ty"))
    p = labelled.where("instance_id > 0").select("frame_id", "x", "y", "instance_id", at("x").alias("_tx"), at("y").alias("_ty"))
    hit = p.join(tiles, ["frame_id", "_tx", "_ty"]).where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))
    return hit.select("frame_id", "object_id", "instance_id").distinct()


def merge_events(members: DataFrame, cells: DataFrame, instances: DataFrame) -> DataFrame:
    """Objects of several components, the instances in their cells, and whether these are several.
    cells: KEY with component_id; instances: KEY with instance_id, distinct."""
    many = members.groupBy("frame_id", "object_id").agg(F.count(F.lit(1)).alias("components")).where("components > 1")
    key = ["frame_id", "level", "ix", "iy"]
    seen = members.select("component_id", "object_id").join(cells.select(*key, "component_id"), "component_id").join(instances, key, "left")
    found = seen.groupBy("frame_id", "object_id").agg(F.count_distinct("instance_id").alias("instances"))
    return many.join(found, ["frame_id", "object_id"]).withColumn("overmerged", F.col("instances") > 1)


def semantic_match(classification: Column, semantic_id: Column) -> Column:
    """How a geometric class agrees with the label below it."""
    good = F.lit(False)
    for name, ids in PREFERRED.items():
        good = good | ((classification == name) & semantic_id.isin(*ids))
    generic = (classification == "OBSTACLE") & semantic_id.isin(*OBSTACLE_LABELS)
    return F.when(semantic_id.isNull(), "UNKNOWN").when(good, "PREFERRED MATCH").when(generic, "GENERIC OBSTACLE").otherwise("MISMATCH")


def obstacle_consistency(semantic_id: Column) -> Column:
    """Whether the label below a proposal is one of obstacles."""
    return F.when(semantic_id.isin(*OBSTACLE_LABELS), "OBSTACLE").when(semantic_id.isin(*SURFACE_LABELS), "NON-OBSTACLE").otherwise("UNKNOWN")


def merge_analysis(frames: DataFrame, events: DataFrame, parts: DataFrame, source: str) -> DataFrame:
    """(frame_id, json): the record of a frame's merges: how many objects, those of several parts, and how many of these mix
    instances. frames (frame_id, objects); events of merge_events(); parts (frame_id, object_id, component_id)."""
    members = parts.groupBy("frame_id", "object_id").agg(F.sort_array(F.collect_list("component_id")).alias("component_ids"))
    rows = events.join(members, ["frame_id", "object_id"]).groupBy("frame_id").agg(
        F.sort_array(F.collect_list(F.struct("object_id", "components", "component_ids", "instances", "overmerged"))).alias("events"), F.count_if("overmerged").alias("overmerged")
    )
    out = frames.join(rows, "frame_id", "left").withColumns({"events": F.coalesce("events", F.array().cast(rows.schema["events"].dataType)), "overmerged": F.coalesce("overmerged", F.lit(0))})
    record = F.struct(F.lit(source).alias("source"), F.col("frame_id").alias("frame"), "objects", F.size("events").alias("merges"), "overmerged", "events")
    return out.select("frame_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def match_candidates(proposals: DataFrame, max_distance: float = 3.0, max_size: float = 4.0) -> DataFrame:
    """Pairs of proposals of one class in frames that follow each other, near enough in place and size, with their score."""
    keep = ["object_id", "classification", "center_x", "center_y", "width", "length", "confidence"]
    a = proposals.select((F.col("frame_id") + 1).alias("frame_id"), *[F.col(c).alias(f"a_{c}") for c in keep])
    b = proposals.select("frame_id", *[F.col(c).alias(f"b_{c}") for c in keep])
    d = lambda x, y: F.sqrt((F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2 + (F.col(f"a_{y}") - F.col(f"b_{y}")) ** 2)
    # places of b stand in one bucket as wide as the distance, those of a look into the nine around theirs
    at = lambda c: F.floor(F.col(c) / max_distance)
    around = F.explode(F.array(*[F.struct((at("a_center_x") + i).alias("i"), (at("a_center_y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = a.select("*", around.alias("_n")).select("*", F.col("_n.i").alias("_bx"), F.col("_n.j").alias("_by"), F.col("a_classification").alias("_c")).drop("_n")
    b = b.withColumns({"_bx": at("b_center_x"), "_by": at("b_center_y"), "_c": F.col("b_classification")})
    rows = a.join(b, ["frame_id", "_c", "_bx", "_by"])
    rows = rows.withColumns({"distance": d("center_x", "center_y"), "size": d("width", "length")}).where((F.col("distance") <= max_distance) & (F.col("size") <= max_size))
    score = 0.65 * F.col("distance") / max_distance + 0.25 * F.col("size") / max_size + 0.1 * (1 - F.col("b_confidence"))
    return rows.select("frame_id", F.col("a_object_id").alias("before"), F.col("b_object_id").alias("after"), F.round("distance", 6).alias("distance"), F.round(score, 6).alias("score"))


def compact_count(n: Column) -> Column:
    """1234 as 1.2k, 2500000 as 2.5M."""
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
        .when(n >= 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k")))
        .otherwise(n.cast("string"))
    )
