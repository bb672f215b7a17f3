"""Fates of labelled points, ground planes that are fitted, fragments, the world without pruning, samples."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ringfield.config import MERGE_GAP, MERGE_GAP_DEFAULT
from ringfield.operators import evaluation, failures, ground, sampling, semantic, tracking
from ringfield.operators.grid import adaptive_grid

POINTS = "frame_id bigint, point_id bigint, x double, y double, z double, is_ground boolean, label bigint"


def cloud():
    """One labelled object for each fate; cells of 5 cm, so a step of 2 m lies out of the neighbours' reach."""
    rows = []

    def put(at, heights, car=True, flat=False):
        for z in heights:
            rows.append((0, len(rows), at[0], at[1], z, flat, (7 << 16 | 10) if car else 40))

    put((1.01, 1.01), [0.5, 0.6])  # two points, no ground anywhere: no reference, before too few
    put((5.01, 1.01), [0.0], car=False, flat=True)
    put((5.06, 1.01), [0.07, 0.07, 0.07])  # ground of the neighbour, too low
    put((5.11, 1.01), [0.9, 0.9])  # ground of the neighbour, too few
    put((1.01, 5.01), [0.0], car=True, flat=True)  # only ground
    put((5.01, 5.01), [0.0], car=False, flat=True)
    put((5.01, 5.01), [0.8, 0.9, 1.0])  # passes
    put((-5.01, 5.01), [0.0], car=False, flat=True)
    put((-5.01, 5.01), [-0.2, -0.2, -0.2, -0.2])  # below its ground
    return rows


def test_fates_of_points(spark):
    p = spark.createDataFrame(cloud(), POINTS)
    states = failures.cell_states(failures.gt_cells(p), adaptive_grid(p)).cache()
    got = {r["reason"]: r["points"] for r in failures.gt_loss(states).collect()}
    assert got == {"NO_GROUND_REFERENCE": 2, "HEIGHT_BELOW_THRESHOLD": 7, "TOO_FEW_OBSTACLE_POINTS": 2, "NO_OBSTACLE_ELEVATION": 1, "PASSED": 3}
    bins = {r["bin"]: (r["points"], r["cells"]) for r in failures.loss_heights(states).collect()}
    assert bins == {"0.05-0.10": (3, 1), "below": (4, 1)}
    assert {r["ground_source"] for r in states.collect()} == {"UNRESOLVED", "RECOVERED", "SAME-CELL"}
    elsewhere = adaptive_grid(p.where("x < 0"))
    assert {r["reason"] for r in failures.gt_loss(failures.cell_states(failures.gt_cells(p), elsewhere)).collect()} >= {"MISSING_CELL"}


def test_contested_pairs_need_purity(spark):
    rows = [(0, 1, 5, 0.9, 0.5), (0, 1, 6, 0.9, 0.1), (0, 2, 5, 0.3, 0.4), (0, 2, 6, 0.3, 0.4), (0, 3, 5, 0.1, 0.9), (0, 3, 6, 0.9, 0.9)]
    pairs = spark.createDataFrame(rows, "frame_id bigint, object_id bigint, gt_id bigint, coverage double, purity double")
    assert [(r["object_id"], r["gts"]) for r in evaluation.contested(pairs).collect()] == [(2, 2)]


def tilted(spark, normal, seed):
    rnd = np.random.default_rng(seed)
    a, b, c = np.array(normal) / np.linalg.norm(normal)
    rows = []
    for i in range(900):
        x, y = rnd.uniform(-30, 30, 2)
        flat = i % 5 < 3
        rows.append((1, i, float(x), float(y), float(-(a * x + b * y - 1.5) / c) if flat else float(rnd.uniform(40, 50)), False))
    return spark.createDataFrame(rows, "frame_id bigint, point_id bigint, x double, y double, z double, is_ground boolean"), (a, b, c, -1.5)


def test_planes_are_fitted_to_their_inliers(spark):
    for normal in ((0.05, -0.1, 1.0), (0.9, 0.1, 1.0)):
        p, want = tilted(spark, normal, 3)
        noisy = p.withColumn("z", F.col("z") + F.sin(F.col("point_id") * 12.9898) * 0.01)
        drawn = ground.confident_ground(p)
        assert drawn.first()["inliers"] >= 540
        got = ground.refitted(p, drawn).first()
        assert np.allclose([got[k] for k in "abcd"], want, atol=1e-6)
        rough = ground.refitted(noisy, ground.confident_ground(noisy)).first()
        assert np.allclose([rough[k] for k in "abcd"], want, atol=0.02)
    marked = ground.with_ground(p, drawn)
    assert adaptive_grid(marked).agg(F.sum("ground_count")).first()[0] == drawn.first()["inliers"]


def test_draws_grow_until_they_suffice(spark):
    """A tenth of the points is ground: 64 draws of three seldom meet it."""
    rnd = np.random.default_rng(11)
    rows = [(1, i, *map(float, rnd.uniform(-20, 20, 2)), 0.0 if i % 6 == 0 else float(rnd.uniform(-40, 40))) for i in range(600)]
    p = spark.createDataFrame(rows, "frame_id bigint, point_id bigint, x double, y double, z double")
    found = ground.confident_ground(p, most=2048).first()
    assert found["inliers"] >= 100 and abs(found["c"]) > 0.999


def merged(boxes):
    """One pair at a time, until no two boxes are near."""
    boxes = [dict(b) for b in boxes]
    while True:
        for i, a in enumerate(boxes):
            j = next((j for j, b in enumerate(boxes) if j > i and a["c"] == b["c"] and math.hypot(max(b["x0"] - a["x1"], a["x0"] - b["x1"], 0), max(b["y0"] - a["y1"], a["y0"] - b["y1"], 0)) <= MERGE_GAP.get(a["c"], MERGE_GAP_DEFAULT)), None)
            if j is not None:
                b = boxes.pop(j)
                boxes[i] = {"c": a["c"], "n": a["n"] + b["n"], **{k: min(a[k], b[k]) for k in ("x0", "y0")}, **{k: max(a[k], b[k]) for k in ("x1", "y1")}}
                break
        else:
            return sorted((b["c"], b["n"], b["x0"], b["x1"], b["y0"], b["y1"]) for b in boxes)


def test_fragments_against_brute_force(spark):
    rnd = random.Random(7)
    boxes = []
    for i in range(160):
        x, y, long = rnd.uniform(-25, 25), rnd.uniform(-25, 25), rnd.choice((0.3, 0.5, 6.0))
        boxes.append({"c": rnd.choice((10, 50, 71, 80)), "n": rnd.randint(1, 9), "x0": x, "x1": x + long, "y0": y, "y1": y + 0.4})
    rows = [(0, b["c"], i, b["x0"], b["x1"], b["y0"], b["y1"], 1, b["n"], 0.0, 0.0, 1.0, 0.0) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "frame_id bigint, semantic_id bigint, hypothesis_id bigint, min_x double, max_x double, min_y double, max_y double, cells bigint, points bigint, center_x double, center_y double, confidence double, entropy double")
    got = sorted((r["semantic_id"], r["points"], r["min_x"], r["max_x"], r["min_y"], r["max_y"]) for r in semantic.merged_fragments(df).collect())
    assert got == merged(boxes) and len(got) < len(boxes) - 10
    plan = semantic.near_boxes(df.withColumn("gap", F.lit(1.0)), df.withColumn("gap", F.lit(1.0)))._jdf.queryExecution().toString()
    assert "_tx" in plan and "Cartesian" not in plan


def test_ghosts_outlive_their_tracks(spark):
    rows = [(1, f, t, "POLE", float(f), 0.0, 0, "STATIC", f + 1, f + 1, f, True) for t, frames in ((1, (0, 1, 2, 3)), (2, (0, 1)), (3, (1, 3))) for f in frames]
    found = spark.createDataFrame(rows, "sequence_id bigint, frame_id bigint, track_id bigint, classification string, x float, y float, missed bigint, motion string, hits bigint, age bigint, last_frame bigint, confirmed boolean")
    got = {(r["frame_id"], r["track_id"]): r for r in tracking.ghosts(found).collect()}
    assert set(got) == {(f, 1) for f in range(4)} | {(f, 2) for f in range(4)} | {(f, 3) for f in range(1, 4)}
    assert [got[f, 2]["motion_state"] for f in range(4)] == ["STATIC", "STATIC", "UNCERTAIN", "UNCERTAIN"] and got[3, 2]["x"] == 1.0 and not got[3, 2]["live"]
    assert [got[f, 3]["live"] for f in (1, 2, 3)] == [True, False, True] and got[2, 3]["x"] == 1.0 and got[3, 3]["motion_state"] == "STATIC"
    pruned = {(r["frame_id"], r["track_id"]) for r in found.collect()}
    assert {k for k, r in got.items() if r["live"]} == pruned
    lost = {r["frame_id"]: r["retired_ids"] for r in tracking.retired_ids(found).collect()}
    assert lost == {0: [], 1: [], 2: [2, 3], 3: []}
    assert tracking.only(tracking.ghosts(found), "POLE", "UNCERTAIN", True).count() == 3


def test_hash_samples_are_full(spark):
    rows = [("a", i) for i in range(3000)] + [("b", 7)] * 900 + [("c", i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, k bigint")
    got = {r["g"]: r["n"] for r in sampling.hash_sample(df, ["g"], "k", 50).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a": 50, "b": 50, "c": 20}
    low = {r["k"] for r in sampling.hash_sample(df.where("g = 'a'"), ["g"], "k", 50).collect()}
    want = [r["k"] for r in df.where("g = 'a'").orderBy(F.pmod(F.xxhash64(F.lit(0), "k"), F.lit(1 << 40))).limit(50).collect()]
    assert low == set(want)


def test_agreement_with_labels(spark):
    from ringfield.operators import diagnosis

    rows = [("POLE", 71), ("POLE", 30), ("PERSON-LIKE", 30), ("VEHICLE-LIKE", 16), ("WALL", 52), ("OBSTACLE", 70), ("OBSTACLE", 40), ("OBSTACLE", 252), ("WALL", None), ("WALL", 0)]
    df = spark.createDataFrame(rows, "c string, s bigint").select("c", "s", diagnosis.semantic_match(F.col("c"), F.col("s")).alias("m"), diagnosis.obstacle_consistency(F.col("s")).alias("o"))
    assert [(r["m"], r["o"]) for r in df.collect()] == [
        ("PREFERRED MATCH", "OBSTACLE"), ("MISMATCH", "OBSTACLE"), ("PREFERRED MATCH", "OBSTACLE"), ("PREFERRED MATCH", "OBSTACLE"), ("PREFERRED MATCH", "OBSTACLE"),
        ("GENERIC OBSTACLE", "OBSTACLE"), ("MISMATCH", "NON-OBSTACLE"), ("MISMATCH", "UNKNOWN"), ("UNKNOWN", "UNKNOWN"), ("MISMATCH", "NON-OBSTACLE"),
    ]


def test_record_of_merges(spark):
    import json

    from ringfield.operators import diagnosis

    frames = spark.createDataFrame([(0, 3), (1, 2)], "frame_id bigint, objects bigint")
    events = spark.createDataFrame([(0, 7, 2, 1, False), (0, 9, 3, 2, True)], "frame_id bigint, object_id bigint, components bigint, instances bigint, overmerged boolean")
    parts = spark.createDataFrame([(0, 7, 8), (0, 7, 7), (0, 9, 9), (0, 9, 10), (0, 9, 11), (0, 5, 5)], "frame_id bigint, object_id bigint, component_id bigint")
    got = {r["frame_id"]: json.loads(r["json"]) for r in diagnosis.merge_analysis(frames, events, parts, "unit").collect()}
    assert got[1] == {"source": "unit", "frame": 1, "objects": 2, "merges": 0, "overmerged": 0, "events": []}
    assert got[0]["merges"] == 2 and got[0]["overmerged"] == 1 and got[0]["events"][0]["component_ids"] == [7, 8]


def test_pose_files_of_many_sequences(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException

    from ringfield.sources import files

    for s, n in ((3, 2), (4, 1)):
        (tmp_path / f"sequence_id={s}").mkdir()
        (tmp_path / f"sequence_id={s}/poses.txt").write_text("\n\n".join(" ".join(str(12 * i + k) for k in range(12)) for i in range(n)) + "\n")
    got = {(r["sequence_id"], r["frame_id"]): (r["r00"], r["t2"]) for r in files.pose_lines(spark, str(tmp_path)).collect()}
    assert got == {(3, 0): (0.0, 11.0), (3, 1): (12.0, 23.0), (4, 0): (0.0, 11.0)}
    (tmp_path / "sequence_id=4/poses.txt").write_text("1 2 3\n")
    with pytest.raises(PySparkException, match="no 12 numbers"):
        files.pose_lines(spark, str(tmp_path)).collect()
