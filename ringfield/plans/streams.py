"""Queries that run as streams: the tables arrive in deliveries, some rows late and some twice."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfield.operators.graph import cut
from ringfield.plans.motion import detections
from ringfield.plans.registry import query
from ringfield.plans.sql import query as q
from ringfield.sources.derived import points
from ringfield.streaming import tracker
from ringfield.streaming.replay import replayed

DELIVERIES = 3


def dealt(rows: DataFrame, key: str, again: bool) -> tuple[list[DataFrame], str]:
    """Deliveries in the order of frames, and the watermark's delay. A tenth of the rows comes one delivery
    late and, with `again`, another tenth a second time; an empty row at the end closes all frames."""
    n = (rows.agg(F.max("frame_id")).first()[0] or 0) + 1
    per = math.ceil(n / DELIVERIES)
    due, lot = F.floor(F.col("frame_id") / per), F.pmod(F.xxhash64(key), F.lit(10))
    first = rows.withColumn("_due", due + (lot == 0).cast("int"))
    if again:
        first = first.unionByName(rows.where(lot == 1).withColumn("_due", due + 1))
    end = rows.sparkSession.createDataFrame([(float(n + 8 * per) / 10 + 3600,)], "ts_s double").select(*[F.col(c) if c == "ts_s" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    return [*[first.where(F.col("_due") == i).drop("_due") for i in range(DELIVERIES + 1)], end], f"{per * 100 + 1000} milliseconds"


@query("stream_tracks")
def stream_tracks(spark, sf_dir):
    """The rows of `tracks`, from a stream of detections."""
    rows = cut(detections(spark, sf_dir))
    parts, delay = dealt(rows, "object_id", again=True)
    return replayed(spark, parts, lambda s: tracker.tracks(s, delay))


@query("stream_grid", q("SELECT frame_id // 10 AS second, level, ix, iy, count(*) AS point_count, avg(z) AS z_mean FROM mapped GROUP BY ALL", "mapped"))
def stream_grid(spark, sf_dir):
    """Cells of each second of a stream of points, ten frames a second."""
    rows = points(spark, sf_dir).select("frame_id", "point_id", "x", "y", "z", (F.col("frame_id") * 0.1).alias("ts_s"))
    parts, delay = dealt(rows, "point_id", again=False)
    timed = [p.withColumn("ts", tracker.event_time(F.col("ts_s"))).na.fill(0.0, ["x", "y"]) for p in parts]  # the closing row must be in range
    found = replayed(spark, timed, lambda s: tracker.grid_counts(s, delay))
    return found.select((F.floor(F.unix_millis("window.start") / 1000) - tracker.EPOCH).alias("second"), "level", "ix", "iy", "point_count", "z_mean")
