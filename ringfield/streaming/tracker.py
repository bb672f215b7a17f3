"""The tracker and the grid on streams.

A sequence is a state; the step is the batch tracker's own. Detections of a frame wait in the
state until the watermark has passed the frame's time. Then the frame's timer fires, and the
frames that are due are taken in order. So frames may arrive in any order and in parts, rows may
arrive twice, and a query that restarts from its checkpoint goes on where it was.

Event times are `ts_s`, in seconds, and must not run against frame ids. Rows without a time, rows
of a frame that was taken already, and rows behind the watermark are dropped. A row without a
frame_id belongs to no frame: it only moves the watermark, as the end of a recording must."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ringfield.config import Tracking
from ringfield.operators.tracking import TRACKS, Track, rows_of, seconds_between, step

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = 86_400  # seconds before a recording's 0: Spark's first watermark is the time 0, and rows at it count as late
NOTHING = -1  # the object_id of a frame without detections
SEEN = "ts_s double, classification string, x float, y float, width float, length float, confidence double"
LIVE = (
    "track_id bigint, classification string, x float, y float, width float, length float, confidence double, first bigint, last bigint, last_s double,"
    " vx float, vy float, hits bigint, missed bigint, age bigint, moving bigint, resting bigint, motion string, confirmed boolean, dt double"
)
COLUMNS = [c.split()[0] for c in TRACKS.split(", ")]


def saved(t: Track, last_s: float) -> tuple:
    pair = lambda v: (float(v[0]), float(v[1]))
    return (
        t.track_id, t.classification, *pair(t.at), *pair(t.size), float(t.confidence), t.frame, t.last, last_s,
        *pair(t.speed), t.hits, t.missed, t.age, t.moving, t.resting, t.motion, t.confirmed, t.dt,
    )


def restored(r: tuple) -> tuple[Track, float]:
    track_id, name, x, y, width, length, confidence, first, last, last_s, vx, vy, hits, missed, age, moving, resting, motion, confirmed, dt = r
    pair = lambda a, b: np.array([a, b], np.float32)
    return Track(track_id, name, pair(x, y), pair(width, length), confidence, first, last, pair(vx, vy), hits, missed, age, moving, resting, motion, confirmed, dt), last_s


class Following(StatefulProcessor):
    """State of a sequence: rows that wait for their frame's time, live tracks, next id and last frame."""

    def __init__(self, cfg: Tracking):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame_id bigint, object_id bigint", SEEN)
        self.live = handle.getListState("live", LIVE)
        self.reached = handle.getValueState("reached", "next_id bigint, frame_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.reached.get()[1] if self.reached.exists() else None
        due = set()
        for b in rows:
            for r in b[b["frame_id"].notna() & b["ts_s"].notna()].to_dict("records"):
                frame = int(r["frame_id"])
                if last is not None and frame <= last:
                    continue
                known = not pd.isna(r["object_id"])
                body = (r["classification"], *(float(r[c]) for c in ("x", "y", "width", "length", "confidence"))) if known else (None,) * 6
                self.waiting.updateValue((frame, int(r["object_id"]) if known else NOTHING), (float(r["ts_s"]), *body))
                due.add(millis(r["ts_s"]))
        for t in due:
            self.handle.registerTimer(t)
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = [(*k, *v) for k, v in self.waiting.iterator() if millis(v[0]) <= now]
        next_id = self.reached.get()[0] if self.reached.exists() else 1
        held = [restored(r) for r in self.live.get()] if self.live.exists() else []
        tracks, times = [t for t, _ in held], {t.last: s for t, s in held}
        out: list[tuple] = []
        seen = pd.DataFrame(rows, columns=["frame_id", "object_id", *[c.split()[0] for c in SEEN.split(", ")]])
        for frame, part in seen.sort_values(["frame_id", "object_id"]).groupby("frame_id"):
            times[int(frame)] = float(part["ts_s"].iloc[0])
            tracks, next_id = step(tracks, next_id, int(frame), part[part["object_id"] != NOTHING], lambda a, b: seconds_between(times.get(a), times.get(b), a, b, self.cfg), self.cfg)
            out += rows_of(int(key[0]), int(frame), tracks)
            self.reached.update((next_id, int(frame)))
        for k in rows:
            self.waiting.removeKey((k[0], k[1]))
        if rows:
            self.live.put([saved(t, times[t.last]) for t in tracks]) if tracks else self.live.clear()
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def event_time(ts_s: Column) -> Column:
    return F.timestamp_micros(F.round((ts_s + EPOCH) * 1_000_000).cast("long"))


def millis(ts_s: float) -> int:
    return int(round((ts_s + EPOCH) * 1_000_000)) // 1000


def tracks(detections: DataFrame, watermark: str = "2 seconds", cfg: Tracking = Tracking()) -> DataFrame:
    """A streaming DataFrame of detections, as tracking.tracks() takes them -> the same rows in append
    mode. The session's state store must be ROCKS."""
    rows = detections.withColumn("ts", event_time(F.col("ts_s"))).withWatermark("ts", watermark)
    rows = rows.withColumn("object_id", F.col("object_id").cast("string"))  # pandas would round ids beside nulls
    return rows.groupBy("sequence_id").transformWithStateInPandas(Following(cfg), TRACKS, "append", "eventTime")


def grid_counts(points: DataFrame, watermark: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """Cells of a point stream with an event time `ts`, by windows; late points beyond the watermark are dropped. Points out
    of range are dropped before they can move the watermark."""
    from ringfield.operators.grid import with_cell

    rows = with_cell(points.withWatermark("ts", watermark))
    return rows.groupBy(F.window("ts", window).alias("window"), "level", "ix", "iy").agg(F.count(F.lit(1)).alias("point_count"), F.avg("z").alias("z_mean"))
