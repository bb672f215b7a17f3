"""The detector's path: cells that touch, components, closest-first merges, shape features and classes.

Its rules differ from those of components.py on purpose: both variants are kept apart."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfield.operators.components import bucket_pairs, component_filter
from ringfield.operators.graph import components_within

# Box gap in metres up to which parts are one object, by distance below which it holds; then beyond.
GAPS = ((15.0, 0.50), (30.0, 0.60), (60.0, 0.90))
FAR_GAP = 1.25
# Most difference of mean heights, largest merged extent and height, and the thin shape that is refused.
MAX_STEP, MAX_EXTENT, MAX_RISE, THIN, THIN_LENGTH = 0.75, 8.0, 4.5, 0.10, 6.0

BOX = ["min_x", "max_x", "min_y", "max_y", "min_z", "max_z"]


def links(obstacles: DataFrame) -> DataFrame:
    """(frame_id, a, b) for obstacle cells whose footprints touch, up to a twentieth of the larger cell, and heights agree."""
    rows = obstacles.select("frame_id", F.col("cell_id").alias("id"), "center_x", "center_y", "resolution", "obstacle_height")
    pairs = bucket_pairs(rows, ["frame_id"], "center_x", "center_y", 0.5)
    r = F.greatest("a_resolution", "b_resolution")
    ok = F.abs(F.col("a_obstacle_height") - F.col("b_obstacle_height")) <= F.greatest(F.lit(0.75), 2.0 * r)
    for c in ("center_x", "center_y"):
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        ha, hb = F.col("a_resolution") / 2, F.col("b_resolution") / 2
        ok = ok & (a - ha <= b + hb + r * 0.05) & (a + ha >= b - hb - r * 0.05)
    return pairs.where(ok).select("frame_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def components(obstacles: DataFrame) -> DataFrame:
    """obstacles with component_id, the least cell of the component."""
    found = components_within("frame_id", obstacles.select("frame_id", F.col("cell_id").alias("id")), links(obstacles)).drop("frame_id")
    return obstacles.join(found.select(F.col("id").alias("cell_id"), F.col("component").alias("component_id")), "cell_id")


def extents(cells: DataFrame, by: str = "component_id") -> DataFrame:
    """cells with `by` -> box, sums and counts of each; these add up, so merged parts need no second pass over cells."""
    half = F.col("resolution") / 2
    return cells.groupBy("frame_id", by).agg(
        F.count(F.lit(1)).alias("cell_count"), F.sum("obstacle_count").alias("point_count"),
        F.min(F.col("center_x") - half).alias("min_x"), F.max(F.col("center_x") + half).alias("max_x"),
        F.min(F.col("center_y") - half).alias("min_y"), F.max(F.col("center_y") + half).alias("max_y"),
        F.min("ground_elevation").alias("min_z"), F.max("obstacle_elevation").alias("max_z"),
        F.max("obstacle_height").alias("max_height"), F.sum("obstacle_height").alias("height_sum"),
    )


def features(rows: DataFrame) -> DataFrame:
    """extents with the shape that classes go by: all from the box, whose middle is the centre."""
    c = F.col
    rows = rows.withColumns(
        {
            "center_x": (c("min_x") + c("max_x")) / 2, "center_y": (c("min_y") + c("max_y")) / 2, "center_z": (c("min_z") + c("max_z")) / 2,
            "width": c("max_x") - c("min_x"), "length": c("max_y") - c("min_y"), "height": c("max_z") - c("min_z"),
            "mean_height": c("height_sum") / c("cell_count"),
        }
    )
    narrow = F.greatest(F.least("width", "length"), F.lit(0.05))
    rows = rows.withColumns(
        {
            "distance": F.sqrt(c("center_x") * c("center_x") + c("center_y") * c("center_y")), "footprint": F.greatest(c("width") * c("length"), F.lit(0.01)),
            "aspect_ratio": F.greatest("width", "length") / narrow, "verticality": c("max_height") / narrow,
        }
    )
    return rows.withColumn("density", c("point_count") / c("footprint"))


def classify() -> Column:
    """The class of a row of features; the first rule that holds."""
    wide, narrow, high, points = F.greatest("width", "length"), F.least("width", "length"), F.col("max_height"), F.col("point_count")
    slim = (wide <= 1.2) & (narrow <= 1.0)
    return (
        F.when((high >= 1.2) & slim & (F.col("verticality") >= 2.0) & (points >= 10), "POLE")
        .when((high >= 1.0) & (wide >= 4.0) & (narrow <= 2.5) & (F.col("aspect_ratio") >= 2.0), "WALL")
        .when(wide.between(1.5, 8.0) & narrow.between(0.8, 3.5) & high.between(0.7, 3.2) & (F.col("footprint") >= 1.2) & (points >= 50), "VEHICLE-LIKE")
        .when(high.between(1.2, 2.3) & slim & (points >= 15), "PERSON-LIKE")
        .otherwise("OBSTACLE")
    )


def _gaps(box: np.ndarray, mean: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Gap between part i and each of the others, infinite where they must stay apart."""
    a, b = box[i], box[others]
    gx = np.maximum(0.0, np.maximum(b[:, 0] - a[1], a[0] - b[:, 1]))
    gy = np.maximum(0.0, np.maximum(b[:, 2] - a[3], a[2] - b[:, 3]))
    gap = np.hypot(gx, gy)
    far = lambda p: np.hypot((p[..., 0] + p[..., 1]) / 2, (p[..., 2] + p[..., 3]) / 2)
    d = np.minimum(far(a), far(b))
    limit = np.select([d < hi for hi, _ in GAPS], [g for _, g in GAPS], FAR_GAP)
    size = np.maximum(a[1::2], b[:, 1::2]) - np.minimum(a[0::2], b[:, 0::2])
    wide, narrow = size[:, :2].max(1), size[:, :2].min(1)
    ok = (gap <= limit) & (np.abs(mean[i] - mean[others]) <= MAX_STEP) & (wide <= MAX_EXTENT) & (size[:, 2] <= MAX_RISE) & ~((narrow < THIN) & (wide > THIN_LENGTH))
    return np.where(ok, gap, np.inf)


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Closest pair first, ties to the parts that came first; a merged part comes last."""
    pdf = pdf.sort_values("component_id")
    n = len(pdf)
    box, total, count = np.zeros((2 * n, 6)), np.zeros(2 * n), np.zeros(2 * n)
    box[:n], total[:n], count[:n] = pdf[BOX], pdf["height_sum"], pdf["cell_count"]
    mean = total / np.maximum(count, 1)
    live, parts, heap = np.zeros(2 * n, bool), [[i] for i in range(n)], []
    for i in range(n):
        before = np.arange(i)
        gap = _gaps(box, mean, i, before)
        heap += [(float(gap[j]), int(j), i) for j in np.flatnonzero(np.isfinite(gap))]
        live[i] = True
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        if not (live[i] and live[j]):
            continue
        new = len(parts)
        live[[i, j]] = False
        box[new, 0::2], box[new, 1::2] = np.minimum(box[i, 0::2], box[j, 0::2]), np.maximum(box[i, 1::2], box[j, 1::2])
        total[new], count[new] = total[i] + total[j], count[i] + count[j]
        mean[new] = total[new] / count[new]
        parts.append(parts[i] + parts[j])
        others = np.flatnonzero(live[:new])
        gap = _gaps(box, mean, new, others)
        for k in np.flatnonzero(np.isfinite(gap)):
            heapq.heappush(heap, (float(gap[k]), int(others[k]), new))
        live[new] = True
    ids = pdf["component_id"].to_numpy()
    out = np.zeros(n, np.int64)
    for p in np.flatnonzero(live):
        out[parts[p]] = ids[parts[p]].min()
    return pd.DataFrame({"frame_id": pdf["frame_id"].to_numpy(), "component_id": ids, "object_id": out})


def merges(rows: DataFrame) -> DataFrame:
    """extents of components -> (frame_id, component_id, object_id), the least component of each object.
    Each merge changes the box that the next one is judged by, so a scan's parts (hundreds, not its cells) are merged in one task."""
    return rows.select("frame_id", "component_id", "cell_count", "height_sum", *BOX).groupBy("frame_id").applyInPandas(
        lambda pdf: _merged(pdf), "frame_id bigint, component_id bigint, object_id bigint"
    )


def proposals(parts: DataFrame, members: DataFrame) -> DataFrame:
    """extents of the kept components, merged as in members: one row an object, with features, class and rank by distance."""
    low, high, add = ("min_x", "min_y", "min_z"), ("max_x", "max_y", "max_z", "max_height"), ("cell_count", "point_count", "height_sum")
    rows = parts.join(members, ["frame_id", "component_id"]).groupBy("frame_id", "object_id").agg(
        F.count(F.lit(1)).alias("component_count"), *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high], *[F.sum(c).alias(c) for c in add]
    )
    return features(rows).withColumn("classification", classify())


def detect(obstacles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """obstacle cells -> cells with component_id, kept components with object_id, proposals. Obstacles are
    read several times and should be written before."""
    from ringfield.operators.graph import cut

    cells = cut(components(obstacles))
    kept = cut(component_filter(extents(cells)))
    members = cut(merges(kept))
    return cells, members, proposals(kept, members)
