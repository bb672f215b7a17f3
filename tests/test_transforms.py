"""Matrix columns against numpy; chains of transforms."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ringfield.functions import matrix
from ringfield.operators import poses


def test_products_and_inverses(spark):
    rnd = np.random.default_rng(1)
    ms = [rnd.standard_normal((4, 4)) for _ in range(20)]
    rows = [(i, [float(v) for v in a.ravel()], [float(v) for v in b.ravel()]) for i, (a, b) in enumerate(zip(ms, ms[1:]))]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").select("i", matrix.product(F.col("a"), F.col("b")).alias("p"), matrix.inverse(F.col("a")).alias("v"))
    for r in df.collect():
        assert np.allclose(np.reshape(r["p"], (4, 4)), ms[r["i"]] @ ms[r["i"] + 1])
        assert np.allclose(np.reshape(r["v"], (4, 4)), np.linalg.inv(ms[r["i"]]))
    with pytest.raises(PySparkException, match="singular"):
        spark.createDataFrame([([0.0] * 16,)], "a array<double>").select(matrix.inverse(F.col("a"))).collect()


def test_sensor_chain(spark):
    """A carrier that moves 5 m a frame, with the sensor 1 m ahead and 2 m up."""
    one = {"r00": 1.0, "r01": 0.0, "r02": 0.0, "r10": 0.0, "r11": 1.0, "r12": 0.0, "r20": 0.0, "r21": 0.0, "r22": 1.0}
    pose = spark.createDataFrame([{"sequence_id": 1, "frame_id": i, **one, "t0": 5.0 * i, "t1": 0.0, "t2": 0.0} for i in range(3)])
    sensor = spark.createDataFrame([{"sequence_id": 1, **one, "t0": 1.0, "t1": 0.0, "t2": 2.0}])
    worlds = poses.calibrated(pose, sensor)
    at = {r["frame_id"]: np.reshape(r["world"], (4, 4))[:3, 3].tolist() for r in worlds.collect()}
    assert at[0] == [1.0, 0.0, 2.0] and at[1] == [6.0, 0.0, 2.0]
    pairs = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "sequence_id bigint, source bigint, target bigint")
    found = {r["source"]: np.reshape(r["transform"], (4, 4))[:3, 3].tolist() for r in poses.between(worlds, pairs).collect()}
    assert found == {1: [5.0, 0.0, 0.0], 2: [10.0, 0.0, 0.0]}


def test_quaternion_turns(spark):
    h = float(np.sqrt(0.5))
    m = matrix.of_quaternion(F.lit(h), F.lit(0.0), F.lit(0.0), F.lit(h), (F.lit(0.0), F.lit(0.0), F.lit(3.0)))
    got = spark.range(1).select(*[c.alias(n) for c, n in zip(matrix.applied(m, F.lit(1.0), F.lit(0.0), F.lit(0.0)), "xyz")]).first()
    assert np.allclose(list(got), [0.0, 1.0, 3.0])


def test_pose_source(spark):
    some = spark.range(1)
    assert poses.pose_source(False) == "identity_no_odometry"
    assert poses.pose_source(True, "own", some) == "own"
    assert poses.pose_source(True, None, some.limit(0)) == "identity_empty_poses"
    assert poses.pose_source(True, None, some) == "kitti_poses_lidar_to_frame0"
