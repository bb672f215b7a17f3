"""Free cells as a graph, and paths over it."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfield.functions.geometry import cell_id
from ringfield.operators.components import bucket_pairs
from ringfield.operators.grid import KEY, cell_stats

PATH = "frame_id bigint, status string, length double, cells bigint, path array<bigint>"


def plan_nodes(cells: DataFrame) -> DataFrame:
    """Cells with blocked: an obstacle or mixed cell, or one whose square an obstacle cell overlaps."""
    c = cell_stats(cells).select(cell_id().alias("id"), *KEY, "center_x", "center_y", "resolution", (F.col("cell_class") != "GROUND").alias("_own"))
    o = c.where("_own").select("frame_id", F.col("center_x").alias("ox"), F.col("center_y").alias("oy"), F.col("resolution").alias("orr"), F.floor("center_x").alias("_bx"), F.floor("center_y").alias("_by"))
    around = F.explode(F.array(*[F.struct((F.floor("center_x") + i).alias("i"), (F.floor("center_y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    free = c.where("NOT _own").select("id", "frame_id", "center_x", "center_y", "resolution", around.alias("_n")).select("*", F.col("_n.i").alias("_bx"), F.col("_n.j").alias("_by"))
    limit = (F.col("resolution") + F.col("orr")) / 2 + 1e-4
    hit = free.join(o, ["frame_id", "_bx", "_by"]).where((F.abs(F.col("center_x") - F.col("ox")) < limit) & (F.abs(F.col("center_y") - F.col("oy")) < limit)).select("id").distinct()
    return c.join(hit.withColumn("_hit", F.lit(True)), "id", "left").withColumn("blocked", F.col("_own") | F.coalesce("_hit", F.lit(False))).drop("_own", "_hit")


def plan_edges(nodes: DataFrame) -> DataFrame:
    """(frame_id, a, b, length) for free cells whose squares touch."""
    free = nodes.where("NOT blocked").select("frame_id", "id", "center_x", "center_y", "resolution")
    pairs = bucket_pairs(free, ["frame_id"], "center_x", "center_y", 1.0)
    limit = (F.col("a_resolution") + F.col("b_resolution")) / 2 + 1e-3
    dx, dy = F.col("a_center_x") - F.col("b_center_x"), F.col("a_center_y") - F.col("b_center_y")
    return pairs.where((F.abs(dx) <= limit) & (F.abs(dy) <= limit)).select("frame_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.sqrt(dx * dx + dy * dy).alias("length"))


def _path(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame, start: tuple[float, float], goal: tuple[float, float], reach: float) -> pd.DataFrame:
    """A* inside one frame; both ends snap to the nearest free cell within reach."""
    at = {r.id: (r.center_x, r.center_y) for r in nodes.itertuples()}

    def snap(p: tuple[float, float]) -> int | None:
        d, i = min(((math.hypot(x - p[0], y - p[1]), i) for i, (x, y) in at.items()), default=(math.inf, None))
        return i if d <= reach else None

    a, b = snap(start), snap(goal)
    none = lambda why: pd.DataFrame([(key[0], why, float("nan"), 0, [])], columns=["frame_id", "status", "length", "cells", "path"])
    if a is None or b is None:
        return none("NO_START" if a is None else "NO_GOAL")
    beside: dict[int, list[tuple[int, float]]] = {}
    for e in edges.itertuples() if len(edges) else ():
        beside.setdefault(e.a, []).append((e.b, e.length))
        beside.setdefault(e.b, []).append((e.a, e.length))
    rest = lambda i: math.hypot(at[i][0] - at[b][0], at[i][1] - at[b][1])
    best, back, heap, done = {a: 0.0}, {}, [(rest(a), a)], set()
    while heap:
        _, i = heapq.heappop(heap)
        if i == b:
            path = [b]
            while path[-1] in back:
                path.append(back[path[-1]])
            return pd.DataFrame([(key[0], "FOUND", best[b], len(path), path[::-1])], columns=["frame_id", "status", "length", "cells", "path"])
        if i in done:
            continue
        done.add(i)
        for j, d in beside.get(i, ()):
            if best[i] + d < best.get(j, math.inf) - 1e-12:
                best[j], back[j] = best[i] + d, i
                heapq.heappush(heap, (best[j] + rest(j), j))
    return none("NO_PATH")


def plan_path(nodes: DataFrame, edges: DataFrame, start: tuple[float, float], goal: tuple[float, float], reach: float = 1.5) -> DataFrame:
    """The shortest path over free cells in each frame: PATH."""

    def call(key, left, right):
        return _path(key, left, right, start, goal, reach)

    free = nodes.where("NOT blocked").select(F.col("frame_id").alias("_f"), F.col("id").alias("id"), F.col("center_x").alias("center_x"), F.col("center_y").alias("center_y"))
    links = edges.select(F.col("frame_id").alias("_f"), F.col("a").alias("a"), F.col("b").alias("b"), F.col("length").alias("length"))
    return free.groupBy("_f").cogroup(links.groupBy("_f")).applyInPandas(call, PATH)


def point_along(steps: DataFrame, by: str, order: str, share: float) -> DataFrame:
    """The point at a share of each polyline's length. steps: by, order, x, y."""
    w = Window.partitionBy(by).orderBy(order)
    s = steps.withColumns({"_x": F.lag("x").over(w), "_y": F.lag("y").over(w)}).withColumn("_d", F.coalesce(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")), F.lit(0.0)))
    s = s.withColumns({"_at": F.sum("_d").over(w), "_all": F.sum("_d").over(Window.partitionBy(by))})
    want = F.col("_all") * share
    hit = s.where((F.col("_at") >= want) & ((F.col("_at") - F.col("_d") < want) | F.col("_x").isNull()))
    first = hit.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    t = F.when(F.col("_d") > 0, (want - (F.col("_at") - F.col("_d"))) / F.col("_d")).otherwise(0.0)
    mix = lambda c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * t)
    return first.select(by, mix("x").alias("x"), mix("y").alias("y"))
