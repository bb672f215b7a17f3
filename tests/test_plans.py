"""The registered path queries over all rings, against brute force on the smallest tables."""

import heapq
import math

import numpy as np
from pyspark.sql import functions as F

from ringfield.functions.geometry import cell_id
from ringfield.operators.grid import cell_stats
from ringfield.plans import motion
from ringfield.plans.grid import cells

SF = "/root/testdata/sf0.001"
START, GOAL, REACH = (-30.0, -20.0), (-26.0, -24.0), 1.5


def test_plans_cover_all_rings(spark):
    c = cell_stats(cells(spark, SF)).select("frame_id", "level", cell_id().alias("id"), "center_x", "center_y", "resolution", (F.col("cell_class") != "GROUND").alias("own")).toPandas()
    assert set(c["level"]) == {0, 1, 2, 3}
    blocked, edges, paths = {}, {}, {}
    for frame, f in c.groupby("frame_id"):
        x, y, r, own, ids = (f[k].to_numpy() for k in ("center_x", "center_y", "resolution", "own", "id"))
        dx, dy, rr = np.abs(x[:, None] - x), np.abs(y[:, None] - y), (r[:, None] + r) / 2
        hit = own | (((dx < rr + 1e-4) & (dy < rr + 1e-4))[:, own]).any(1)
        blocked |= {(frame, int(i)): bool(h) for i, h in zip(ids, hit, strict=True)}
        touch = (dx <= rr + 1e-3) & (dy <= rr + 1e-3) & ~hit[:, None] & ~hit & (ids[:, None] < ids)
        beside = {}
        for a, b in np.argwhere(touch):
            edges[frame, int(ids[a]), int(ids[b])] = d = math.hypot(dx[a, b], dy[a, b])
            beside.setdefault(a, []).append((b, d))
            beside.setdefault(b, []).append((a, d))
        free = np.flatnonzero(~hit)
        ends = []
        for p in (START, GOAL):
            far = np.hypot(x[free] - p[0], y[free] - p[1])
            ends.append(free[far.argmin()] if len(free) and far.min() <= REACH else None)
        if None in ends:
            paths[frame] = ("NO_START" if ends[0] is None else "NO_GOAL", None)
            continue
        best, heap = {}, [(0.0, ends[0])]
        while heap:
            d, i = heapq.heappop(heap)
            if i not in best:
                best[i] = d
                for j, e in beside.get(i, ()):
                    heapq.heappush(heap, (d + e, j))
        paths[frame] = ("FOUND", best[ends[1]]) if ends[1] in best else ("NO_PATH", None)

    assert {(r.frame_id, r.id): r.blocked for r in motion.plan_blocked_all(spark, SF).collect()} == blocked
    found = {(r.frame_id, r.a, r.b): r.length for r in motion.plan_edges(spark, SF).collect()}
    assert found.keys() == edges.keys() and all(abs(found[k] - edges[k]) < 1e-9 for k in edges)
    got = {r.frame_id: (r.status, r.length) for r in motion.plan_path(spark, SF).collect()}
    for frame, (status, length) in paths.items():
        if frame in got or status not in ("NO_START", "NO_GOAL"):
            assert got[frame][0] == status and (length is None or abs(got[frame][1] - length) < 1e-6)
