"""Queries that explain proposals, and the export of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield.config import OBSTACLE_LABELS, PREFERRED, SURFACE_LABELS
from ringfield.operators import components as c
from ringfield.operators import diagnosis as d
from ringfield.operators import evaluation as e
from ringfield.operators import semantic as s
from ringfield.operators.graph import cut
from ringfield.operators.grid import KEY, with_cell
from ringfield.plans.evaluation import EVAL, stages
from ringfield.plans.registry import query
from ringfield.plans.sql import query as q
from ringfield.sources import files
from ringfield.sources.derived import points, poses

PURE = (
    "SELECT frame_id, object_id, semantic_id, CAST(total AS BIGINT) AS points, round(CAST(n AS DOUBLE) / total, 9) AS purity FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, object_id ORDER BY n DESC, semantic_id) AS rk, sum(n) OVER (PARTITION BY frame_id, object_id) AS total"
    " FROM (SELECT i.frame_id, i.object_id, l.semantic_id, count(*) AS n FROM inside i JOIN labelled l ON l.frame_id = i.frame_id AND l.point_id = i.point_id GROUP BY 1, 2, 3)) WHERE rk = 1"
)
MATCH = (
    "CASE WHEN semantic_id IS NULL THEN 'UNKNOWN' WHEN " + " OR ".join(f"(classification = '{n}' AND semantic_id IN {ids})" for n, ids in PREFERRED.items())
    + f" THEN 'PREFERRED MATCH' WHEN classification = 'OBSTACLE' AND semantic_id IN {OBSTACLE_LABELS} THEN 'GENERIC OBSTACLE' ELSE 'MISMATCH' END"
)


def _pure(spark, sf_dir):
    p, _, _, cells, members, groups = stages(spark, sf_dir)
    owned = cells.join(members.select("component_id", "object_id"), "component_id")
    return d.proposal_purity(e.proposal_points(p, owned), s.unpack(p)), groups


@query("proposal_purity", q("SELECT * FROM pure", "groups", "labelled", **EVAL, pure=PURE))
def proposal_purity(spark, sf_dir):
    return _pure(spark, sf_dir)[0]


@query("semantic_match", q(f"SELECT frame_id, object_id, {MATCH} AS agreement FROM pure JOIN proposals USING (frame_id, object_id)", "proposals", "labelled", **EVAL, pure=PURE))
def semantic_match(spark, sf_dir):
    pure, groups = _pure(spark, sf_dir)
    rows = pure.join(c.proposals(groups).select("frame_id", "object_id", "classification"), ["frame_id", "object_id"])
    return rows.select("frame_id", "object_id", d.semantic_match(F.col("classification"), F.col("semantic_id")).alias("agreement"))


@query("obstacle_consistency", q(f"SELECT frame_id, object_id, CASE WHEN semantic_id IN {OBSTACLE_LABELS} THEN 'OBSTACLE' WHEN semantic_id IN {SURFACE_LABELS} THEN 'NON-OBSTACLE' ELSE 'UNKNOWN' END AS consistency FROM groups LEFT JOIN pure USING (frame_id, object_id)", "groups", "labelled", **EVAL, pure=PURE))
def obstacle_consistency(spark, sf_dir):
    pure, groups = _pure(spark, sf_dir)
    rows = groups.select("frame_id", "object_id").join(pure, ["frame_id", "object_id"], "left")
    return rows.select("frame_id", "object_id", d.obstacle_consistency(F.col("semantic_id")).alias("consistency"))


@query("box_instances", q("SELECT DISTINCT g.frame_id, g.object_id, l.instance_id FROM groups g JOIN labelled l ON l.frame_id = g.frame_id AND l.x BETWEEN g.min_x AND g.max_x AND l.y BETWEEN g.min_y AND g.max_y WHERE l.instance_id > 0", "groups", "labelled"))
def box_instances(spark, sf_dir):
    p, *_, groups = stages(spark, sf_dir)
    return d.box_instances(groups, s.unpack(p))


@query(
    "merge_events",
    q(
        "SELECT frame_id, object_id, components, instances, instances > 1 AS overmerged FROM (SELECT frame_id, object_id, count(*) AS components FROM members GROUP BY 1, 2 HAVING count(*) > 1)"
        " JOIN (SELECT m.frame_id, m.object_id, count(DISTINCT i.instance_id) AS instances FROM members m JOIN component_cells c ON c.component_id = m.component_id LEFT JOIN (SELECT DISTINCT frame_id, level, ix, iy, label // 65536 AS instance_id FROM mapped WHERE label // 65536 > 0) i"
        " ON i.frame_id = c.frame_id AND i.level = c.level AND i.ix = c.ix AND i.iy = c.iy GROUP BY 1, 2) USING (frame_id, object_id)",
        "members",
    ),
)
def merge_events(spark, sf_dir):
    p, _, _, cells, members, _ = stages(spark, sf_dir)
    return d.merge_events(members, cells, s.unpack(with_cell(p)).where("instance_id > 0").select(*KEY, "instance_id").distinct())


@query("merge_analysis")
def merge_analysis(spark, sf_dir):
    """A record of each frame's merges, as JSON."""
    p, _, _, cells, members, groups = stages(spark, sf_dir)
    events = d.merge_events(members, cells, s.unpack(with_cell(p)).where("instance_id > 0").select(*KEY, "instance_id").distinct())
    return d.merge_analysis(groups.groupBy("frame_id").agg(F.count(F.lit(1)).alias("objects")), events, members.select("frame_id", "object_id", "component_id"), "derived drives")


@query(
    "match_candidates",
    q(
        "SELECT frame_id, before, after, round(distance, 6) AS distance, round(CAST(0.65 AS DOUBLE) * distance / 3.0 + CAST(0.25 AS DOUBLE) * size / 4.0 + CAST(0.1 AS DOUBLE) * (1 - confidence), 6) AS score FROM (SELECT b.frame_id, a.object_id AS before, b.object_id AS after, b.confidence,"
        " sqrt((a.center_x-b.center_x)*(a.center_x-b.center_x) + (a.center_y-b.center_y)*(a.center_y-b.center_y)) AS distance, sqrt((a.width-b.width)*(a.width-b.width) + (a.length-b.length)*(a.length-b.length)) AS size"
        " FROM proposals a JOIN proposals b ON b.frame_id = a.frame_id + 1 AND a.classification = b.classification) WHERE distance <= 3.0 AND size <= 4.0",
        "proposals",
    ),
)
def match_candidates(spark, sf_dir):
    return d.match_candidates(cut(c.proposals(stages(spark, sf_dir)[-1])))


@query(
    "compact_counts",
    q("SELECT frame_id, CASE WHEN n >= 1000000 THEN format('{:.1f}M', n / 1e6) WHEN n >= 1000 THEN format('{:.1f}k', n / 1e3) ELSE CAST(n AS VARCHAR) END AS points FROM (SELECT frame_id, count(*) AS n FROM points GROUP BY frame_id)", "points"),
)
def compact_counts(spark, sf_dir):
    n = points(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("frame_id", d.compact_count(F.col("n")).alias("points"))


@query("frame_json")
def frame_json(spark, sf_dir):
    """One JSON document a frame: pose, obstacle cells and proposals."""
    _, _, found, _, _, groups = stages(spark, sf_dir)
    cells = found.drop("cell_id")
    return files.frame_documents(poses(spark, sf_dir), {"obstacle_cells": cells, "proposals": c.proposals(groups)})
