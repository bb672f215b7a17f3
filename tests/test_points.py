"""The point-cloud operators on fixtures with known results, and against SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfield import catalog
from ringfield.functions.geometry import ring_level
from ringfield.operators import components, evaluation, grid, obstacles, planning, poses, sampling, tracking
from ringfield.sources import files

SF = "/root/testdata/sf0.001"
POINTS = "frame_id bigint, point_id bigint, x double, y double, z double, is_ground boolean"


def cloud(spark, rows):
    return spark.createDataFrame([(0, i, float(x), float(y), float(z), bool(g)) for i, (x, y, z, g) in enumerate(rows)], POINTS)


def test_ring_bounds(spark):
    rows = [(2.0, 0), (9.9, 0), (10.0, 1), (24.9, 1), (25.0, 2), (49.9, 2), (50.0, 3), (99.9, 3), (100.0, None)]
    df = spark.createDataFrame([(x,) for x, _ in rows], "x double").select(ring_level("x", F.lit(0.0)).alias("l"))
    assert [r.l for r in df.collect()] == [level for _, level in rows]


def test_cells(spark):
    p = cloud(spark, [(2, 0, 0, True), (2.01, 0.01, 1, False), (12, 0, 0, True), (35, 0, 0, True), (60, 0, 0, True), (101, 0, 0, True)])
    cells = grid.adaptive_grid(p)
    assert cells.count() == 4
    c = grid.cell_stats(cells).where("level = 0").first()
    assert (c.point_count, c.z_min, c.z_mean, c.z_max, c.cell_class) == (2, 0.0, 0.5, 1.0, "MIXED")
    c = grid.with_cell(cloud(spark, [(1.0, 2.0, 0, True)])).first()
    assert (c.level, c.ix, c.iy) == (0, 20, 40)
    assert grid.cell_parent(cells).where("level = 0").first().parent_level == 1
    half = [grid.adaptive_grid(p.where(F.col("point_id") % 2 == k)) for k in (0, 1)]
    assert sorted(map(tuple, grid.merged(half[0].union(half[1])).select(*cells.columns).collect())) == sorted(map(tuple, cells.collect()))


def test_ground_from_neighbours(spark):
    lattice = [(x, y, 0.0, True) for x in np.linspace(-1, 1, 40) for y in np.linspace(-1, 1, 40) if not (abs(x) < 0.12 and abs(y) < 0.12)]
    found = obstacles.obstacle_cells(grid.adaptive_grid(cloud(spark, lattice + [(0.02, 0.02, 1.2, False)] * 30))).collect()
    assert len(found) == 1 and found[0].ground_source == "neighbor" and found[0].obstacle_height > 0.5


def cells_of(spark, rows):
    return spark.createDataFrame(
        [(i, 0, 0, ix, iy, 0.05, ix * 0.05 + 0.025, iy * 0.05 + 0.025, 0.0, h, h, n, "cell") for i, (ix, iy, h, n) in enumerate(rows)],
        "cell_id bigint, frame_id bigint, level int, ix bigint, iy bigint, resolution double, center_x double, center_y double, ground_elevation double, obstacle_elevation double, obstacle_height double, obstacle_count bigint, ground_source string",
    )


def test_components_and_groups(spark):
    cells = cells_of(spark, [(0, 0, 2.0, 20), (1, 0, 2.0, 20), (2, 0, 2.0, 20), (20, 0, 2.0, 20), (21, 0, 2.0, 20), (22, 0, 2.0, 20), (300, 0, 2.0, 1)])
    comp = components.cell_components(cells)
    assert {r.cell_id: r.component_id for r in comp.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    kept = components.component_filter(components.component_features(comp))
    assert kept.count() == 2
    g = components.object_groups(components.group_members(kept)).collect()
    assert len(g) == 1 and g[0].component_count == 2 and g[0].cell_count == 6


def test_matching_is_greedy(spark):
    rows = [(0, 1, 10, 0.9, 0.5, 0.5, 9), (0, 1, 11, 0.8, 0.5, 0.5, 8), (0, 2, 10, 0.85, 0.5, 0.5, 8), (0, 2, 11, 0.3, 0.5, 0.5, 3), (0, 3, 11, 0.1, 0.5, 0.5, 1)]
    df = spark.createDataFrame(rows, "frame_id bigint, object_id bigint, gt_id bigint, coverage double, iou double, purity double, overlap bigint")
    assert {(r.object_id, r.gt_id) for r in evaluation.match_one_to_one(df).collect()} == {(1, 10), (2, 11)}


def test_tracks_keep_ids_and_retire(spark):
    rows = [(0, f, f * 0.1, 1, "VEHICLE-LIKE", 3.0 + 0.25 * f, 0.0, 2.0, 2.0, 0.9) for f in range(2)]
    rows += [(0, f, f * 0.1, None, None, None, None, None, None, None) for f in range(2, 6)]
    df = spark.createDataFrame(rows, "sequence_id bigint, frame_id bigint, ts_s double, object_id bigint, classification string, x double, y double, width double, length double, confidence double")
    found = tracking.tracks(df)
    seen = {r.frame_id: r for r in found.collect()}
    assert sorted(seen) == [0, 1, 2, 3] and all(r.track_id == 1 for r in seen.values())
    assert seen[1].confirmed and seen[1].hits == 2 and seen[3].missed == 2
    assert tracking.world_objects(found).where("frame_id = 3").first().motion_state == "UNCERTAIN"


def test_poses(spark):
    p = spark.createDataFrame([(float(np.sqrt(0.5)), 0.0, 0.0, float(np.sqrt(0.5)))], "w double, x double, y double, z double")
    r = p.select(*poses.rotation_of(*[F.col(c) for c in "wxyz"])).first()
    assert (round(r.r00, 9), round(r.r01, 9), round(r.r10, 9)) == (0, -1, 1)
    path = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 0.0, 4.5), (0, 2, -0.01, 9.3), (1, 0, 3.0, 4.0)], "s bigint, k bigint, x double, y double")
    got = {r.s: r.metres for r in poses.travel_metres(path, "s", "k").collect()}
    assert got[0] == pytest.approx(9.3, abs=1e-3) and got[1] == 5.0


def test_even_sample(spark):
    got = sorted(r.id for r in sampling.even_sample(spark.range(10_000).withColumn("g", F.lit(1)), ["g"], "id", 500).collect())
    assert got == sorted(set(np.round(np.linspace(0, 9999, 500)).astype(int)))


def test_paths(spark):
    free = [(x, y) for x in range(8) for y in range(8) if not (x == 4 and y < 7)]
    nodes = spark.createDataFrame([(0, x * 8 + y, float(x), float(y), 1.0, False) for x, y in free], "frame_id bigint, id bigint, center_x double, center_y double, resolution double, blocked boolean")
    r = planning.plan_path(nodes, planning.plan_edges(nodes), (0.0, 0.0), (7.0, 0.0)).first()
    assert r.status == "FOUND" and r.length == pytest.approx(6 * math.sqrt(2) + 7 + 0, abs=3) and len(r.path) == r.cells
    assert planning.plan_path(nodes, planning.plan_edges(nodes), (0.0, 0.0), (90.0, 0.0)).first().status == "NO_GOAL"


def test_files(spark, tmp_path):
    (tmp_path / "scans").mkdir()
    for name, n in (("000000", 3), ("000001", 2), ("._000002", 1)):
        np.arange(4 * n, dtype="<f4").tofile(tmp_path / "scans" / f"{name}.bin")
        (np.arange(n, dtype="<u4") | (7 << 16)).astype("<u4").tofile(tmp_path / "scans" / f"{name}.label")
    p = files.labelled(files.scans(spark, str(tmp_path / "scans")), files.labels(spark, str(tmp_path / "scans")))
    got = p.orderBy("frame", "point_id").collect()
    assert [(r.frame, r.point_id, r.x, r.label & 65535, r.label >> 16) for r in got] == [("000000", i, 4.0 * i, i, 7) for i in range(3)] + [("000001", i, 4.0 * i, i, 7) for i in range(2)]
    (tmp_path / "poses.txt").write_text("1 0 0 5 0 1 0 6 0 0 1 7\n")
    r = files.poses(spark, str(tmp_path / "poses.txt")).first()
    assert (r.frame_id, r.r00, r.t0, r.t2) == (0, 1.0, 5.0, 7.0)
    (tmp_path / "calib.txt").write_text("P0: 1 2\nTr_velo_to_cam: 0 0 0 1 0 0 0 2 0 0 0 3\nTr: 0 0 0 4 0 0 0 5 0 0 0 6\n")
    assert files.calibration(spark, str(tmp_path / "calib.txt")).first().t0 == 4.0
    (tmp_path / "a.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    assert [r.z for r in files.ply(spark, str(tmp_path)).orderBy("point_id").collect()] == [3.0, 6.0]


def test_keyframes(spark):
    samples = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", ""), ("z", "")], "token string, next string")
    assert {r.token: r.frame_id for r in files.keyframe_chain(samples, "a", "c").collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        files.keyframe_chain(samples, "a", "z")


def test_frame_json(spark, tmp_path):
    frames = spark.createDataFrame([(0, float("nan")), (1, 2.0)], "frame_id bigint, latency double")
    cells = spark.createDataFrame([(0, 2, 0.5), (0, 1, float("inf"))], "frame_id bigint, ix bigint, z double")
    got = {r.frame_id: r.json for r in files.frame_documents(frames, {"cells": cells}).collect()}
    assert got[0] == '{"frame_id":0,"latency":null,"cells":[{"ix":1,"z":null},{"ix":2,"z":0.5}]}' and '"cells":[]' in got[1]
    names = spark.createDataFrame([("--a b/c--",), ("***",)], "n string").select(files.slug(F.col("n")).alias("s"))
    assert [r.s for r in names.collect()] == ["a-b-c", "source"]


SQL = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(names: list[str], rows: list) -> list[tuple]:
    """Rows with columns by name; nulls and whole numbers as they are, not as pandas would have them beside nulls."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", SQL)
def test_same_rows_as_sql(spark, base, name):
    got, want = catalog.queries()[name](spark, SF), base.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _plain(got.columns, got.collect()) == _plain(names, want.fetchall())
