"""Common table expressions that restate the operators in plain SQL."""

from __future__ import annotations

from ringfield.sources.derived import POINTS_SQL, POSES_SQL


def d(x: float | int | str) -> str:
    return f"CAST({x} AS DOUBLE)"


LEVEL = f"CASE WHEN x*x+y*y < {d(100)} THEN 0 WHEN x*x+y*y < {d(625)} THEN 1 WHEN x*x+y*y < {d(2500)} THEN 2 WHEN x*x+y*y < {d(10000)} THEN 3 END"


def size_of(level: str) -> str:
    return f"CASE {level} WHEN 0 THEN {d('0.05')} WHEN 1 THEN {d('0.10')} WHEN 2 THEN {d('0.25')} WHEN 3 THEN {d('0.50')} END"


CELL_ID = "((frame_id * 4 + level) * 67108864 + (ix + 4096) * 8192 + (iy + 4096))"
CLASS = "CASE WHEN ground_count = 0 THEN 'OBSTACLE' WHEN obstacle_count = 0 THEN 'GROUND' ELSE 'MIXED' END"


def bucket(x: str) -> str:
    return f"CASE WHEN {x} < 10 THEN '0-10' WHEN {x} < 25 THEN '10-25' WHEN {x} < 50 THEN '25-50' ELSE '50-100' END"


def shape(height: str, upright: float) -> str:
    wide = "greatest(width, length)"
    return (
        f"CASE WHEN {height} >= 1.5 AND {height} / greatest({wide}, {d('0.000001')}) >= {upright} AND width <= 1.5 AND length <= 1.5 THEN 'POLE'"
        f" WHEN {height} >= 1.0 AND {wide} >= 2.0 AND least(width, length) <= 2.5 THEN 'WALL'"
        f" WHEN {height} BETWEEN 1.0 AND 3.5 AND width <= 5.0 AND length <= 8.0 AND point_count >= 20 THEN 'VEHICLE-LIKE' ELSE 'OBSTACLE' END"
    )


CONFIDENCE = (
    "least(CAST(CASE WHEN point_count >= 20 THEN 0.25 WHEN point_count >= 10 THEN 0.15 ELSE 0.05 END AS DOUBLE)"
    " + CAST(CASE WHEN cell_count >= 10 THEN 0.25 WHEN cell_count >= 5 THEN 0.15 ELSE 0.05 END AS DOUBLE)"
    f" + CASE WHEN max_height > 0 THEN {d('0.25')} * least(mean_height / max_height, {d(1)}) ELSE {d(0)} END"
    f" + CAST(CASE WHEN density > 50 THEN 0.25 WHEN density > 10 THEN 0.15 ELSE 0.05 END AS DOUBLE), {d(1)})"
)

DIMENSIONS = (
    "SELECT *, sqrt(center_x*center_x + center_y*center_y) AS distance,"
    f" CAST(point_count AS DOUBLE) / greatest(width * length, {d('0.000001')}) AS density"
    " FROM (SELECT *, max_x - min_x AS width, max_y - min_y AS length, max_z - min_z AS height FROM {})"
)


def reach(nodes: str, links: str) -> str:
    """Recursive reachability of links (a, b) both ways; the least id reached names the component."""
    return (
        f"_both AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),"
        " _reach(id, dest) AS (SELECT a, b FROM _both UNION SELECT r.id, e.b FROM _reach r JOIN _both e ON r.dest = e.a),"
        f" _component AS (SELECT n.id, least(n.id, coalesce(min(r.dest), n.id)) AS component FROM (SELECT id FROM {nodes}) n LEFT JOIN _reach r ON r.id = n.id GROUP BY n.id)"
    )


PARTS: dict[str, str] = {
    "points": POINTS_SQL,
    "poses": POSES_SQL,
    "mapped": f"SELECT *, CAST(floor(x / resolution) AS BIGINT) AS ix, CAST(floor(y / resolution) AS BIGINT) AS iy FROM (SELECT *, {size_of('level')} AS resolution FROM (SELECT *, {LEVEL} AS level FROM points WHERE x*x+y*y < {d(10000)}))",
    "cells": "SELECT frame_id, level, ix, iy, min(resolution) AS resolution, count(*) AS point_count, "
    + ", ".join(
        f"count(CASE WHEN {on} THEN 1 END) AS {n}_count, coalesce(sum(CASE WHEN {on} THEN z END), {d(0)}) AS {n}_z_sum, min(CASE WHEN {on} THEN z END) AS {n}_z_min, max(CASE WHEN {on} THEN z END) AS {n}_z_max"
        for n, on in (("ground", "is_ground"), ("obstacle", "NOT is_ground"))
    )
    + " FROM mapped GROUP BY frame_id, level, ix, iy",
    "stats": "SELECT *, CASE WHEN ground_count > 0 THEN ground_z_sum / ground_count END AS ground_elevation, CASE WHEN obstacle_count > 0 THEN obstacle_z_sum / obstacle_count END AS obstacle_elevation,"
    f" (ground_z_sum + obstacle_z_sum) / point_count AS z_mean, least(ground_z_min, obstacle_z_min) AS z_min, greatest(ground_z_max, obstacle_z_max) AS z_max, {CLASS} AS cell_class,"
    " ix * resolution + resolution / 2 AS center_x, iy * resolution + resolution / 2 AS center_y FROM cells",
    "local": "SELECT frame_id, level, ix, iy, sum(w * gz) / sum(w) AS local_elevation, count(*) AS neighbors FROM (SELECT c.frame_id, c.level, c.ix, c.iy,"
    " g.ground_elevation AS gz, 1.0 / (sqrt(CAST((g.ix-c.ix)*(g.ix-c.ix)+(g.iy-c.iy)*(g.iy-c.iy) AS DOUBLE)) * c.resolution + CAST(0.001 AS DOUBLE)) AS w"
    " FROM stats c JOIN stats g ON g.frame_id = c.frame_id AND g.level = c.level AND abs(g.ix-c.ix) <= 20 AND abs(g.iy-c.iy) <= 20"
    " WHERE c.ground_count = 0 AND c.obstacle_count >= 3 AND g.ground_count > 0) GROUP BY frame_id, level, ix, iy",
    "obstacles": f"SELECT {CELL_ID} AS cell_id, frame_id, level, ix, iy, resolution, center_x, center_y, ground AS ground_elevation, obstacle_elevation, obstacle_elevation - ground AS obstacle_height, obstacle_count, ground_source"
    " FROM (SELECT s.*, coalesce(s.ground_elevation, l.local_elevation) AS ground, CASE WHEN s.ground_count > 0 THEN 'cell' ELSE 'neighbor' END AS ground_source FROM stats s"
    " LEFT JOIN local l ON l.frame_id = s.frame_id AND l.level = s.level AND l.ix = s.ix AND l.iy = s.iy WHERE s.obstacle_count >= 3) WHERE obstacle_elevation - ground >= CAST(0.15 AS DOUBLE)",
    "links": "SELECT a.frame_id, a.cell_id AS a, b.cell_id AS b FROM obstacles a JOIN obstacles b ON a.frame_id = b.frame_id AND a.cell_id < b.cell_id"
    " AND abs(a.center_x - b.center_x) <= 1 AND abs(a.center_y - b.center_y) <= 1 WHERE sqrt("
    + " + ".join(
        f"greatest((b.center_{c} - b.resolution / 2) - (a.center_{c} + a.resolution / 2), (a.center_{c} - a.resolution / 2) - (b.center_{c} + b.resolution / 2), {d(0)})"
        f" * greatest((b.center_{c} - b.resolution / 2) - (a.center_{c} + a.resolution / 2), (a.center_{c} - a.resolution / 2) - (b.center_{c} + b.resolution / 2), {d(0)})"
        for c in "xy"
    )
    + f") <= greatest({d('0.25')}, {d('0.75')} * greatest(a.resolution, b.resolution)) AND abs(a.obstacle_height - b.obstacle_height) <= greatest({d('0.75')}, {d(2)} * greatest(a.resolution, b.resolution))",
    "component_cells": "SELECT o.*, c.component AS component_id FROM obstacles o JOIN cell_component c ON c.id = o.cell_id",
    "_features": "SELECT frame_id, component_id, count(*) AS cell_count, CAST(sum(obstacle_count) AS BIGINT) AS point_count, avg(center_x) AS center_x, avg(center_y) AS center_y,"
    " min(center_x - resolution / 2) AS min_x, max(center_x + resolution / 2) AS max_x, min(center_y - resolution / 2) AS min_y, max(center_y + resolution / 2) AS max_y,"
    " min(ground_elevation) AS min_z, max(obstacle_elevation) AS max_z, max(obstacle_height) AS max_height, avg(obstacle_height) AS mean_height, sum(obstacle_height) AS height_sum, max(resolution) AS resolution"
    " FROM component_cells GROUP BY frame_id, component_id",
    "features": DIMENSIONS.format("_features"),
    "kept": "SELECT * FROM features WHERE cell_count >= 3 AND point_count >= 5",
    "object_links": "SELECT frame_id, a, b FROM (SELECT a.frame_id, a.component_id AS a, b.component_id AS b, sqrt((a.center_x-b.center_x)*(a.center_x-b.center_x)+(a.center_y-b.center_y)*(a.center_y-b.center_y)) AS dd,"
    f" abs(a.max_height - b.max_height) AS dh, greatest({d('0.75')}, {d(4)} * greatest(a.resolution, b.resolution)) AS near, least(a.max_height, b.max_height) AS low,"
    f" greatest(a.width, a.length, b.width, b.length) AS wide, greatest({d('0.75')}, {d('0.5')} * greatest(a.width, a.length, b.width, b.length)) AS margin,"
    " a.min_x AS ax0, a.max_x AS ax1, a.min_y AS ay0, a.max_y AS ay1, b.min_x AS bx0, b.max_x AS bx1, b.min_y AS by0, b.max_y AS by1"
    " FROM kept a JOIN kept b ON a.frame_id = b.frame_id AND a.component_id < b.component_id)"
    " WHERE (dd <= near AND dh <= 1.0) OR (dd <= 1.5 AND low >= 1.2 AND wide <= 1.5)"
    " OR (dd <= 2.0 AND dh <= 1.25 AND ax0 <= bx1 + margin AND ax1 >= bx0 - margin AND ay0 <= by1 + margin AND ay1 >= by0 - margin)",
    "members": "SELECT f.*, c.component AS object_id FROM kept f JOIN object_component c ON c.id = f.component_id",
    "_groups": "SELECT frame_id, object_id, count(*) AS component_count, CAST(sum(cell_count) AS BIGINT) AS cell_count, sum(center_x * greatest(point_count, 1)) / sum(greatest(point_count, 1)) AS center_x,"
    " sum(center_y * greatest(point_count, 1)) / sum(greatest(point_count, 1)) AS center_y, CAST(sum(point_count) AS BIGINT) AS point_count, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y,"
    " min(min_z) AS min_z, max(max_z) AS max_z, max(max_height) AS max_height, sum(height_sum) / sum(cell_count) AS mean_height FROM members GROUP BY frame_id, object_id",
    "groups": DIMENSIONS.format("_groups"),
    "proposals": "SELECT frame_id, object_id, center_x, center_y, width, length, height, min_x, max_x, min_y, max_y, "
    + shape("height", 2.0) + " AS classification, " + CONFIDENCE + " AS confidence, distance, point_count, cell_count, max_height, mean_height, density, component_count FROM groups",
    "labelled": "SELECT *, label % 65536 AS semantic_id, label // 65536 AS instance_id FROM points",
    "cell_labels": "SELECT frame_id, level, ix, iy, label % 65536 AS semantic_id, count(*) AS n FROM mapped GROUP BY frame_id, level, ix, iy, label % 65536",
}

NEEDS = {
    "mapped": ["points"], "cells": ["mapped"], "stats": ["cells"], "local": ["stats"], "obstacles": ["stats", "local"], "links": ["obstacles"],
    "component_cells": ["cell_component"], "_features": ["component_cells"], "features": ["_features"], "kept": ["features"],
    "object_links": ["kept"], "members": ["object_component"], "_groups": ["members"], "groups": ["_groups"], "proposals": ["groups"],
    "labelled": ["points"], "cell_labels": ["mapped"],
}


def query(select: str, *parts: str, **own: str) -> str:
    """WITH all parts that `parts` need, then those in `own` in order, then select."""
    order: list[str] = []
    recursive = False

    def add(name: str) -> None:
        if name in order:
            return
        if name in ("cell_component", "object_component"):
            add("links" if name == "cell_component" else "object_links")
            order.append(name)
            return
        for n in NEEDS.get(name, []):
            add(n)
        order.append(name)

    for p in parts:
        add(p)
    text = []
    for name in order:
        if name in ("cell_component", "object_component"):
            recursive = True
            tag = "c" if name == "cell_component" else "o"
            nodes, links = ("(SELECT cell_id AS id FROM obstacles)", "links") if tag == "c" else ("(SELECT component_id AS id FROM kept)", "object_links")
            chain = reach(nodes, links)
            for x in ("_both", "_reach", "_component"):
                chain = chain.replace(x, f"{tag}{x}")
            text.append(chain.replace(f"{tag}_component AS", f"{name} AS"))
        else:
            text.append(f"{name} AS ({PARTS[name]})")
    text += [f"{n} AS ({s})" for n, s in own.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(text)} {select}" if text else select


def rounded(columns: str, places: int = 9) -> str:
    """round(c, places) AS c for each of the columns."""
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns.split())
