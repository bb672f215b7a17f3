"""Drives of the derived cloud are sequences that do not touch each other."""

import json
import os
import random
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ringfield.operators import poses, tracking
from ringfield.plans import exports, motion
from ringfield.sources.derived import DRIVE, POINT, STRIDE, points, sequence_id, slices

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_frames_grow_in_number(spark):
    n = points(spark, LARGER).groupBy(sequence_id().alias("s")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame_id").alias("frames"))
    lines = spark.read.parquet(f"{LARGER}/lineitem.parquet").groupBy(F.floor(F.col("l_orderkey") / DRIVE).alias("s")).count()
    got = {r.s: r.n for r in n.collect()}
    assert got == {r.s: r["count"] for r in lines.collect()} and len(got) == 2
    assert {r.frames for r in n.collect()} == {7}


def test_tracks_of_a_sequence_do_not_depend_on_others(spark):
    seen = spark.createDataFrame(motion.detections(spark, SF).toPandas())
    later = seen.withColumns({"sequence_id": F.lit(1).cast("bigint"), "frame_id": F.col("frame_id") + STRIDE, "ts_s": F.col("ts_s") + 0.1 * STRIDE})
    rows = tracking.tracks(seen.unionByName(later)).select("sequence_id", "frame_id", "track_id", "classification", "x", "y", "hits", "missed", "confirmed").collect()
    first = sorted(tuple(r)[1:] for r in rows if r.sequence_id == 0)
    second = sorted((r.frame_id - STRIDE, *tuple(r)[2:]) for r in rows if r.sequence_id == 1)
    assert first and first == second


def test_paths_begin_anew_in_each_sequence(spark):
    p = motion.drives(spark, LARGER)
    rows = poses.trajectory(p).collect()
    assert {r.sequence_id for r in rows} == {0, 1}
    assert all((r.travelled == 0) == (r.frame_id % STRIDE == 0) for r in rows)
    assert poses.displacement(p).count() == len(rows) - 2


def test_slices_are_whole_drives_and_all_lines(spark, tmp_path):
    """Lines in any order, numbers beyond a drive's seven frames, drives of unlike size, null keys."""
    rnd = random.Random(5)
    rows = [(rnd.choice((0, 1, 2, 3, 40, 41, 500)) * DRIVE + rnd.randrange(DRIVE), rnd.choice((0, 1, 4, 7, 8, 9)), i) for i in range(3000)]
    rows += [(DRIVE * 3 + i, 2, i) for i in range(2000)] + [(None, 1, -1)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint")
    lines.repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    for size, least in ((10_000, 1), (1700, 2), (600, 4), (50, 5)):
        got = [s.selectExpr("*", f"{POINT['frame_id']} AS frame_id").collect() for s in slices(spark, str(tmp_path), size)]
        assert len(got) >= least and sorted((r.l_orderkey, r.l_linenumber, r.l_partkey) for s in got for r in s if r.l_orderkey is not None) == sorted(r for r in rows if r[0] is not None)
        drives = [d for s in got for d in {r.frame_id // STRIDE for r in s if r.frame_id is not None}]
        assert len(set(drives)) == len(drives)


def test_export_of_frames_in_slices(spark, monkeypatch):
    """Each drive exported by itself gives the documents of all together, and takes little of the disk that they would."""
    def exported(size):
        monkeypatch.setattr(exports, "SLICE", size)
        found = exports.frame_export(spark, LARGER)
        files = found.inputFiles()
        return {r.frame_id: r.json for r in found.collect()}, sum(os.path.getsize(urlparse(f).path) for f in files)

    digits = lambda x: json.loads(x, parse_float=lambda v: round(float(v), 6))
    (whole, _), (sliced, disk) = exported(1 << 23), exported(30_000)
    assert len(sliced) == 14 and sliced.keys() == whole.keys() and all(digits(sliced[k]) == digits(whole[k]) for k in whole)
    assert disk < sum(map(len, sliced.values())) / 4
