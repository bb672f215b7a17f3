"""Streams against the batch operators: late, split and repeated frames, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from ringfield.operators import tracking
from ringfield.operators.grid import with_cell
from ringfield.streaming import tracker
from ringfield.streaming.replay import Replay, replayed

SCHEMA = "sequence_id bigint, frame_id bigint, ts_s double, object_id bigint, classification string, x double, y double, width double, length double, confidence double"


def drives():
    """Two sequences: movers, one that vanishes, one that comes late, frames without detections."""
    rnd, rows = random.Random(2), []
    for s in (1, 2):
        for f in range(12):
            at = (s, f, f * 0.1 + (s - 1) * 0.01)
            if f == 7:
                rows.append((*at, None, None, None, None, None, None, None))
                continue
            for o in range(4):
                if (o == 2 and f > 5) or (o == 3 and f < 4):
                    continue
                rows.append((*at, o, ("VEHICLE-LIKE", "POLE")[o % 2], 8.0 * o + 0.3 * f * (o == 0) + rnd.random() / 8, 5.0 * o, 1.0 + o / 4, 2.0, 0.5 + o / 10))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_set(df):
    return sorted(map(str, df.select(*[c.split()[0] for c in tracking.TRACKS.split(", ")]).collect()))


END = (0, None, 60.0, None, None, None, None, None, None, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_after_restarts(spark, seed):
    """Rows are dealt to five deliveries at random around their time, a fifth of them twice."""
    rnd, rows = random.Random(seed), drives()
    dealt = [[] for _ in range(5)]
    for r in rows:
        first = min(4, max(0, int(r[1] / 3) + rnd.choice((0, 0, 1))))
        dealt[first].append(r)
        if rnd.random() < 0.2:
            dealt[min(4, first + 1)].append(r)
    for d in dealt:
        rnd.shuffle(d)
    dealt.append([END])
    found = replayed(spark, (table(spark, d) for d in dealt), lambda s: tracker.tracks(s, "700 milliseconds"))
    assert as_set(found) == as_set(tracking.tracks(table(spark, rows)))


def test_frames_behind_the_watermark_are_dropped(spark):
    rows = [r for r in drives() if r[0] == 1]
    stream = Replay(spark, lambda s: tracker.tracks(s, "0 seconds"))
    late = [r for r in rows if r[1] == 3]
    for part in ([r for r in rows if r[1] < 6 and r[1] != 3], [r for r in rows if r[1] >= 6], late, [END]):
        stream.deliver(table(spark, part))
        stream.run()
    assert as_set(stream.result(spark)) == as_set(tracking.tracks(table(spark, [r for r in rows if r[1] != 3])))


def test_grid_counts_by_window(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 29), rnd.uniform(-20, 20), rnd.uniform(-20, 20), rnd.randint(0, 64) / 64) for i in range(400)]
    p = spark.createDataFrame(rows, "point_id bigint, frame_id bigint, x double, y double, z double").withColumn("ts", tracker.event_time(F.col("frame_id") * 0.1))
    end = spark.createDataFrame([(None, None, 0.0, 0.0, 0.0)], "point_id bigint, frame_id bigint, x double, y double, z double").withColumn("ts", tracker.event_time(F.lit(600.0)))
    parts = [p.where("frame_id < 12 AND point_id % 5 > 0"), p.where("frame_id >= 12 OR point_id % 5 = 0"), end]
    found = replayed(spark, parts, lambda s: tracker.grid_counts(s, "20 seconds"))
    key = [F.floor(F.col("frame_id") / 10).alias("w"), "level", "ix", "iy"]
    want = with_cell(p).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("z"))
    got = found.select((F.floor(F.unix_millis("window.start") / 1000) - tracker.EPOCH).alias("w"), "level", "ix", "iy", "point_count", F.round("z_mean", 9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.withColumn("z", F.round("z", 9)).collect()))
