"""Documents, chains of samples, nested values, files that lack something."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ringfield.operators import chains, tracking
from ringfield.sources import files, normalize


def normalized(spark, *docs):
    rows = [(i, d if isinstance(d, (str, type(None))) else json.dumps(d)) for i, d in enumerate(docs)]
    return normalize.normalized(spark.createDataFrame(rows, "id int, text string")).orderBy("id")


def test_errors_of_documents(spark):
    pose = {"ego_xy": [1, 2]}
    docs = ["<!doctype html>", "\n <html><body>", '{"pose":', "", None, {}, {"pose": None}, {"pose": {"ego_xy": [1]}}, {"pose": {"ego_xy": ["a", 2]}}, {"pose": {"ego_xy": "12"}}, [1, 2], 3, {"pose": pose}]
    got = [r["error"] for r in normalized(spark, *docs).collect()]
    assert got == ["not JSON", "not JSON", "invalid JSON", "invalid JSON", "invalid JSON", *["no valid pose"] * 7, None]


def test_fields_of_documents(spark):
    cells = [{"center": [1, 2.5], "resolution": 0.5}, {"center": [1], "resolution": 1}, {"center": ["1", 2], "resolution": 1}, {"center": [1, 2], "resolution": 0}, {"center": [1, 2], "resolution": "1"}, None, 3]
    good = {"frame_index": 4, "pose": {"ego_xy": ["1.5", -2, 9], "heading_rad": 0.5, "pose_source": "own"}, "adaptive_cells": cells, "obstacle_cells": {"a": 1}, "points": [[1, 2, 3]], "tracks": "x", "ground": {}}
    bare = {"frame_index": "7", "pose": {"ego_xy": [None, ""], "heading_rad": "0.5", "pose_source": ""}}
    a, b = normalized(spark, good, bare).withColumn("cells", F.size("adaptive_cells")).withColumn("c0", normalize.number(F.get("adaptive_cells", F.lit(0)), "$.center[1]")).collect()
    assert (a["frame_index"], a["ego_x"], a["ego_y"], a["heading_rad"], a["pose_source"], a["cells"], a["c0"]) == (4.0, 1.5, -2.0, 0.5, "own", 1, 2.5)
    assert len(a["points"]) == 1 and a["tracks"] == [] and a["obstacle_cells"] == []
    assert a["has_points"] and a["has_adaptive_grid"] and a["has_ground_data"] and not a["has_tracks"] and not a["has_path_data"]
    assert (b["frame_index"], b["ego_x"], b["ego_y"], b["heading_rad"], b["pose_source"]) == (0.0, 0.0, 0.0, 0.0, "unknown") and b["points"] == [] and not b["has_points"]


def test_strict_documents_fail(spark):
    assert normalize.strict(normalized(spark, {"pose": {"ego_xy": [1, 2]}})).count() == 1
    with pytest.raises(PySparkException, match="no valid pose"):
        normalize.strict(normalized(spark, {"pose": {"ego_xy": [1, 2]}}, {})).collect()


def test_first_readable_candidate(spark):
    rows = [("a", 0, "<html>"), ("a", 1, '{"v":1}'), ("a", 2, '{"v":2}'), ("b", 0, "{"), ("b", 1, None), ("c", 5, "[]")]
    got = {r["k"]: (r["n"], r["error"]) for r in normalize.first_readable(spark.createDataFrame(rows, "k string, n int, text string"), "k", "n").collect()}
    assert got == {"a": (1, None), "b": (None, "missing"), "c": (5, None)}


def test_walks(spark):
    links = [("a0", "a1"), ("a1", "a2"), ("a2", "a3"), ("a3", ""), ("b0", "b1"), ("b1", "b2"), ("b2", "b0"), ("c0", "c1"), ("c1", "gone"), ("d0", None)]
    scenes = [("whole", "a0", "a3"), ("part", "a0", "a2"), ("open", "a1", "zz"), ("loop", "b0", "zz"), ("loop with end", "b0", "b1"), ("lost", "c0", "c9"), ("lost after end", "c0", "c1"), ("one", "d0", "d0")]
    frames, errors = chains.walked(spark.createDataFrame(links, "token string, next string"), spark.createDataFrame(scenes, "scene string, first string, last string"))
    found = {}
    for r in frames.collect():
        found.setdefault(r["scene"], {})[r["frame_id"]] = r["token"]
    bad = {r["scene"]: r["error"] for r in errors.collect()}
    assert bad == {"loop": "cycle", "lost": "missing sample"}
    order = {s: [t for _, t in sorted(v.items())] for s, v in found.items() if s not in bad}
    assert order == {"whole": ["a0", "a1", "a2", "a3"], "part": ["a0", "a1", "a2"], "open": ["a1", "a2", "a3"], "loop with end": ["b0", "b1"], "lost after end": ["c0", "c1"], "one": ["d0"]}
    with pytest.raises(PySparkException, match="cycle"):
        chains.strict(frames, errors.where("scene = 'loop'")).collect()


def test_a_long_walk(spark):
    n = 700
    samples = spark.createDataFrame([(f"t{i}", f"t{i + 1}" if i < n - 1 else "") for i in range(n)], "token string, next string")
    frames, errors = chains.walked(samples, spark.createDataFrame([(1, "t0", f"t{n - 1}")], "scene int, first string, last string"))
    assert errors.isEmpty() and frames.where(F.concat(F.lit("t"), "frame_id") == F.col("token")).count() == n


def test_keyframes(spark):
    frames = spark.createDataFrame([("s", 0, "samp0"), ("s", 1, "samp1"), ("s", 2, "samp2")], "scene string, frame_id bigint, token string")
    data = [("samp0", "cal", "e0", 2_000_000, "late.bin", True), ("samp0", "cal", "e0", 1_000_000, "early.bin", True), ("samp0", "cal", "e0", 500_000, "sweep.bin", False), ("samp1", "cam", "e1", 1, "img.jpg", True), ("samp1", "cal", "e1", 1_500_000, "sd1.bin", True)]
    sample_data = spark.createDataFrame(data, "sample_token string, calibrated_sensor_token string, ego_pose_token string, timestamp bigint, filename string, is_key_frame boolean")
    calibrated = spark.createDataFrame([("cal", "lid"), ("cam", "front")], "token string, sensor_token string")
    sensors = spark.createDataFrame([("lid", "LIDAR_TOP"), ("front", "CAM_FRONT")], "token string, channel string")
    picks = chains.picked(frames, sample_data, calibrated, sensors, "LIDAR_TOP")
    assert {r["frame_id"]: r["filename"] for r in picks.collect()} == {0: "early.bin", 1: "sd1.bin", 2: None}
    assert {r["frame_id"]: r["ts_s"] for r in chains.timestamps(picks).collect()} == {0: 1.0, 1: 1.5}
    info = chains.scene_info(spark.createDataFrame([("s", "samp0"), ("t", "x")], "scene string, first string"), frames, picks)
    assert {r["scene"]: (r["n_samples"], r["n_keyframes"]) for r in info.collect()} == {"s": (3, 2), "t": (0, 0)}


def test_values_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, [1.0, inf, None], [(nan, "a"), (2.0, "b")])], "i int, d double, a array<double>, s array<struct<v:double,n:string>>")
    r = files.finite(df).first()
    assert r["d"] is None and r["a"] == [1.0, None, None] and [(x["v"], x["n"]) for x in r["s"]] == [(None, "a"), (2.0, "b")]
    assert "NaN" not in files.frame_documents(spark.range(1).select(F.col("id").alias("frame_id")), {"p": df.select(F.lit(0).cast("bigint").alias("frame_id"), "a", "s")}).first()["json"]


def test_labels_that_differ_in_number_and_calibration_lines(spark, tmp_path):
    points = spark.createDataFrame([("f", i) for i in range(3)] + [("g", 0)], "frame string, point_id bigint")
    marks = spark.createDataFrame([("f", i, 9) for i in range(3)], "frame string, point_id bigint, label bigint")
    assert files.labelled(points, marks).where("label IS NULL").count() == 1
    with pytest.raises(PySparkException, match="differ in number"):
        files.labelled(points, marks.where("point_id < 2")).collect()
    (tmp_path / "calib.txt").write_text("P0: 1 2 3\nTr: " + " ".join(map(str, range(12))) + "\n")
    assert files.calibration(spark, str(tmp_path / "calib.txt")).first()["t2"] == 11.0
    (tmp_path / "short.txt").write_text("Tr: 1 2 3\n")
    for name in ("short.txt",):
        with pytest.raises(PySparkException, match="no line of 12 numbers"):
            files.calibration(spark, str(tmp_path / name)).collect()


def test_times_of_frames(spark):
    d = spark.createDataFrame([(1, 0, 7), (1, 1, 8)], "sequence_id bigint, frame_id bigint, object_id bigint")
    times = spark.createDataFrame([(1, 0, 0.5)], "sequence_id bigint, frame_id bigint, ts_s double")
    assert {r["frame_id"]: r["ts_s"] for r in tracking.stamped(d, times).collect()} == {0: 0.5, 1: None}
    assert tracking.stamped(d, None).where("ts_s IS NOT NULL").isEmpty() and tracking.stamped(d, times.limit(0)).count() == 2
    with pytest.raises(PySparkException, match="not finite"):
        tracking.stamped(d, times.withColumn("ts_s", F.lit(float("inf")))).collect()
