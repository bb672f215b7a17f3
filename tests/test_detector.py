"""The detector's path, ground planes and failure reasons, against brute force and made cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from ringfield.operators import detector, failures, ground, tracking


def _apart(a, b):
    """Gap of two parts (x0, x1, y0, y1, z0, z1, height_sum, cells, ids), or None where they must stay apart."""
    gap = math.hypot(*[max(0.0, b[i] - a[i + 1], a[i] - b[i + 1]) for i in (0, 2)])
    d = min(math.hypot((p[0] + p[1]) / 2, (p[2] + p[3]) / 2) for p in (a, b))
    size = sorted(max(a[i + 1], b[i + 1]) - min(a[i], b[i]) for i in (0, 2))
    rise = max(a[5], b[5]) - min(a[4], b[4])
    if gap > (0.5 if d < 15 else 0.6 if d < 30 else 0.9 if d < 60 else 1.25) or abs(a[6] / a[7] - b[6] / b[7]) > 0.75:
        return None
    return None if size[1] > 8 or rise > 4.5 or (size[0] < 0.1 and size[1] > 6) else gap


def _slowly(parts):
    while True:
        best = None
        for i in range(len(parts)):
            for j in range(i + 1, len(parts)):
                g = _apart(parts[i], parts[j])
                if g is not None and (best is None or g < best[0]):
                    best = (g, i, j)
        if best is None:
            return parts
        b, a = parts.pop(best[2]), parts.pop(best[1])
        parts.append([f(a[k], b[k]) for k, f in enumerate([min, max] * 3)] + [a[6] + b[6], a[7] + b[7], a[8] + b[8]])


def test_merges_are_closest_first(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for frame in range(3):
        parts = []
        for i in range(70):
            x, y = np.round(rng.uniform(-12, 12, 2) * (1 + 2 * frame) * 4) / 4
            w, h = np.round(rng.uniform(0.05, 2.5, 2) * 20) / 20
            n = int(rng.integers(3, 9))
            parts.append([x, x + w, y, y + h, 0.0, 2.0, float(n * round(rng.uniform(0.3, 1.8), 2)), n, [frame * 1000 + i]])
        rows += [(frame, p[8][0], p[7], p[6], *map(float, p[:6])) for p in parts]
        for p in _slowly(parts):
            want |= {k: min(p[8]) for k in p[8]}
    df = spark.createDataFrame(rows, "frame_id bigint, component_id bigint, cell_count bigint, height_sum double, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    got = {r.component_id: r.object_id for r in detector.merges(df).collect()}
    assert got == want and len(set(got.values())) < len(got)
    assert detector.merges(df.limit(0)).count() == 0


def test_ground_plane(spark):
    i = F.col("id")
    x, y = (i % 41 - 20).cast("double") / 2, (F.floor(i / 41) % 41 - 20).cast("double") / 2
    rows = spark.range(1600).select(
        F.lit(1).cast("bigint").alias("frame_id"), i.alias("point_id"), x.alias("x"), y.alias("y"), F.when(i % 4 == 0, 1.0 + i % 7).otherwise(x * 0.1 - y * 0.05 + 0.5).alias("z")
    )
    few = rows.where("point_id < 2").withColumn("frame_id", F.lit(2).cast("bigint"))
    found = ground.ransac_ground(rows.unionAll(few)).collect()
    assert [r.frame_id for r in found] == [1] and found[0].points == 1600 and found[0].inliers >= 1200
    assert abs(found[0].a / found[0].c + 0.1) < 1e-9 and abs(found[0].b / found[0].c - 0.05) < 1e-9 and found[0].c > 0
    marked = ground.with_ground(rows.unionAll(few), ground.ransac_ground(rows.unionAll(few)))
    assert {r.frame_id: r.n for r in marked.groupBy("frame_id").agg(F.count_if("is_ground").alias("n")).collect()} == {1: found[0].inliers, 2: 0}


def test_failure_reasons(spark):
    names = "obstacle_cell_points obstacle_eligible too_few_points unresolved_reference height_failed no_obstacle_elevation final_points".split()
    base = dict.fromkeys(names, 0) | {"accepted": False, "coverage": None, "purity": None, "best_coverage": 0.0, "ground_share": 0.0}
    cases = [
        ("DETECTED", {"accepted": True, "coverage": 0.9, "purity": 0.1}), ("MERGED_OR_LOW_PURITY", {"coverage": 0.2, "purity": 0.19}), ("MATCHING_FAILURE", {"coverage": 0.5, "purity": 0.2}),
        ("LOW_COMPONENT_COVERAGE", {"coverage": 0.1, "purity": 0.9, "best_coverage": 0.1}), ("SPARSE_OBSTACLE_POINTS", {"too_few_points": 3, "unresolved_reference": 1}),
        ("GROUND_OVERREJECTION_FLAG", {"ground_share": 0.2, "unresolved_reference": 1}), ("NO_TERRAIN_REFERENCE", {"unresolved_reference": 1, "height_failed": 2}), ("HEIGHT_THRESHOLD", {"height_failed": 2, "no_obstacle_elevation": 1}),
        ("NO_OBSTACLE_ELEVATION", {"no_obstacle_elevation": 1}), ("COMPONENT_FILTERED_OUT", {"obstacle_cell_points": 4, "obstacle_eligible": 4}), ("NO_OBSTACLE_CELLS", {}),
    ]
    rows = [(k, *(base | c).values()) for k, (_, c) in enumerate(cases)]
    types = ["bigint"] * len(names) + ["boolean"] + ["double"] * 4
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} {t}" for n, t in zip(base, types, strict=True)))
    assert [r.reason for r in df.orderBy("k").select(failures.reason(F.col("accepted")).alias("reason")).collect()] == [n for n, _ in cases]


def test_contained_boxes(spark):
    s = "frame_id bigint, semantic_id bigint, id bigint, min_x double, max_x double, min_y double, max_y double"
    before = spark.createDataFrame([(0, 50, 1, 0.0, 1.0, 0.0, 1.0), (0, 50, 2, 7.0, 9.0, 0.0, 1.0), (0, 50, 3, 20.0, 21.0, 0.0, 1.0), (0, 10, 4, 2.0, 3.0, 0.0, 1.0), (1, 50, 5, 0.0, 1.0, 0.0, 1.0)], s)
    after = spark.createDataFrame([(0, 50, 1, 0.0, 9.0, 0.0, 1.0), (0, 50, 3, -1.0, 21.0, -1.0, 2.0)], s)
    assert [(r.after_id, r.parts, r.part_ids) for r in failures.contained(before, after).collect()] == [(1, 2, "1,2")]


def test_contested_pairs(spark):
    p = spark.createDataFrame([(0, 1, 10, 0.9, 0.3), (0, 1, 11, 0.9, 0.3), (0, 1, 12, 0.2, 0.2), (0, 1, 13, 0.9, 0.1), (0, 2, 10, 0.9, 0.9)], "frame_id bigint, object_id bigint, gt_id bigint, coverage double, purity double")
    assert sorted((r.gt_a, r.gt_b) for r in failures.contested_pairs(p).collect()) == [(10, 11), (10, 12), (11, 12)]


def test_track_lists(spark):
    rows = [(0, f, t, c, x, 0.0, h, k) for f, t, c, x, h, k in ((0, 1, "POLE", 5.0, 1, False), (0, 2, "BUS", 3.0, 1, False), (1, 1, "POLE", 5.0, 2, True), (1, 2, "BUS", 3.0, 1, False), (1, 3, "WALL", 1.0, 2, True), (1, 4, "BUS", 9.0, 1, False))]
    df = spark.createDataFrame(rows, "sequence_id bigint, frame_id bigint, track_id bigint, classification string, x float, y float, hits bigint, confirmed boolean")
    assert [(r.frame_id, r.track_id) for r in tracking.track_labels(df).orderBy("frame_id", "rank").collect()] == [(0, 2), (0, 1), (1, 3), (1, 1)]
    assert [(r.classification, r.tracks) for r in tracking.class_counts(df).where("frame_id = 1").orderBy("rank").collect()] == [("POLE", 1), ("WALL", 1), ("BUS", 2)]
