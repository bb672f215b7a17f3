"""Linked lists of samples, walked for all scenes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.operators.graph import cut

CYCLE, MISSING = "cycle", "missing sample"


def walked(samples: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """samples (token, next), scenes (scene, first, last) -> frames (scene, frame_id, token) and scenes that fail (scene, error).

    A scene goes from its first sample along `next` up to its last one, or to where `next` ends. The walk doubles its
    step each round, so a chain of n samples takes log n joins; a sample is known by the first place that it has in
    its scene. A walk that comes back to a sample is a cycle, unless the scene's last sample stands before."""
    hop = cut(samples.select("token", F.nullif(F.col("next"), F.lit("")).alias("to")))
    one = hop
    known = cut(scenes.select("scene", F.col("first").alias("token"), F.lit(0).cast("bigint").alias("frame_id")))
    step, count = 1, known.count()
    while True:
        ahead = known.join(hop, "token").where("to IS NOT NULL").select("scene", F.col("to").alias("token"), (F.col("frame_id") + step).alias("frame_id"))
        known = cut(known.unionByName(ahead).groupBy("scene", "token").agg(F.min("frame_id").alias("frame_id")))
        now = known.count()
        if now == count:
            break
        hop = cut(hop.alias("a").join(hop.alias("b"), F.col("a.to") == F.col("b.token")).where("b.to IS NOT NULL").select(F.col("a.token").alias("token"), F.col("b.to").alias("to")))
        step, count = 2 * step, now
    ends = known.join(scenes.select("scene", F.col("last").alias("token")), ["scene", "token"]).select("scene", F.col("frame_id").alias("_end"))
    frames = cut(known.join(ends, "scene", "left").where("_end IS NULL OR frame_id <= _end"))
    placed = frames.join(one.withColumn("_found", F.lit(True)), "token", "left")
    there = frames.select("scene", F.col("token").alias("to"), F.col("frame_id").alias("_again"))
    onward = placed.where("_end IS NULL OR frame_id < _end").join(there, ["scene", "to"], "left").withColumn("_back", F.col("_again") <= F.col("frame_id"))
    lost = placed.where("_found IS NULL").select("scene", F.lit(MISSING).alias("error"))
    errors = onward.where("_back").select("scene", F.lit(CYCLE).alias("error")).unionByName(lost).groupBy("scene").agg(F.min("error").alias("error"))
    return frames.select("scene", "frame_id", "token"), errors


def strict(frames: DataFrame, errors: DataFrame) -> DataFrame:
    """frames; a scene that fails fails the job, when its rows are read."""
    rows = frames.join(errors, "scene", "left")
    fine = F.assert_true(F.col("error").isNull(), F.concat(F.lit("scene "), F.col("scene").cast("string"), F.lit(": "), F.coalesce("error", F.lit("")))).isNull()
    return rows.where(fine).drop("error")


def picked(frames: DataFrame, sample_data: DataFrame, calibrated: DataFrame, sensors: DataFrame, channel: str) -> DataFrame:
    """For each frame the earliest key row of the channel's sensor (by timestamp, then file name). sample_data: sample_token,
    calibrated_sensor_token, ego_pose_token, timestamp, filename, is_key_frame. A frame without one is a row of nulls."""
    on = calibrated.select(F.col("token").alias("calibrated_sensor_token"), "sensor_token").join(sensors.select(F.col("token").alias("sensor_token"), "channel"), "sensor_token")
    keys = sample_data.where("is_key_frame").join(on.where(F.col("channel") == channel), "calibrated_sensor_token")
    best = keys.groupBy("sample_token").agg(F.min(F.struct("timestamp", "filename", "ego_pose_token", "calibrated_sensor_token")).alias("_b"))
    return frames.join(best.withColumnRenamed("sample_token", "token"), "token", "left").select("scene", "frame_id", "token", "_b.timestamp", "_b.filename", "_b.ego_pose_token", "_b.calibrated_sensor_token")


def scene_info(scenes: DataFrame, frames: DataFrame, picks: DataFrame) -> DataFrame:
    """scenes with the number of samples of their chain and of those with a key row."""
    n = frames.groupBy("scene").agg(F.count(F.lit(1)).alias("n_samples"))
    k = picks.where("filename IS NOT NULL").groupBy("scene").agg(F.count(F.lit(1)).alias("n_keyframes"))
    return scenes.join(n, "scene", "left").join(k, "scene", "left").na.fill(0, ["n_samples", "n_keyframes"])


def timestamps(picks: DataFrame) -> DataFrame:
    """(scene, frame_id, ts_s) of the frames that have a key row."""
    return picks.where("timestamp IS NOT NULL").select("scene", "frame_id", (F.col("timestamp") / 1e6).alias("ts_s"))
