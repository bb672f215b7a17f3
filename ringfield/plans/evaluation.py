"""Queries on labels and on the quality of proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield.config import COMPATIBLE, GT_IDS, OBJECT_IDS, QUALITY, QUALITY_DEFAULT, SEMANTIC_NAMES
from ringfield.operators import components as c
from ringfield.operators import evaluation as e
from ringfield.operators import obstacles as o
from ringfield.operators import semantic as s
from ringfield.operators.graph import cut
from ringfield.operators.grid import adaptive_grid
from ringfield.plans.registry import query, rounded
from ringfield.plans.sql import CELL_ID, bucket, reach, size_of
from ringfield.plans.sql import query as q
from ringfield.plans.sql import rounded as r
from ringfield.sources.derived import points

K = "frame_id, level, ix, iy"
THINGS = f"({', '.join(map(str, GT_IDS))})"
OBJECTS = f"({', '.join(map(str, OBJECT_IDS))})"
NAME = "CASE semantic_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in SEMANTIC_NAMES.items()) + " ELSE 'class-' || semantic_id END"
GROUP = "CASE " + " ".join(f"WHEN semantic_id IN {ids} THEN '{n}'" for n, ids in COMPATIBLE.items()) + " ELSE 'class-' || semantic_id END"

DOMINANT = f"SELECT {K}, semantic_id, CAST(n AS DOUBLE) / total AS confidence, CAST(total AS BIGINT) AS points FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY n DESC, semantic_id) AS rk, sum(n) OVER (PARTITION BY {K}) AS total FROM cell_labels) WHERE rk = 1"
ENTROPY = f"SELECT {K}, -sum(p * log2(p)) AS entropy FROM (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY {K}) AS p FROM cell_labels) GROUP BY {K}"
THING_CELLS = (
    f"SELECT {CELL_ID} AS cell_id, d.*, e.entropy, (d.ix + 0.5) * c.resolution AS center_x, (d.iy + 0.5) * c.resolution AS center_y, c.resolution, {GROUP} AS grp FROM dominant d"
    f" JOIN entropy e USING ({K}) JOIN cells c USING ({K}) WHERE d.semantic_id IN {OBJECTS}"
)
SLINKS = (
    "SELECT a.frame_id, a.cell_id AS a, b.cell_id AS b FROM tcells a JOIN tcells b ON a.frame_id = b.frame_id AND a.grp = b.grp AND a.cell_id < b.cell_id"
    " WHERE abs(a.center_x - b.center_x) <= greatest(a.resolution, b.resolution) * CAST(1.75 AS DOUBLE) + CAST(0.02 AS DOUBLE) AND abs(a.center_y - b.center_y) <= greatest(a.resolution, b.resolution) * CAST(1.75 AS DOUBLE) + CAST(0.02 AS DOUBLE)"
)
TRUTH = f"SELECT *, label AS gt_id FROM labelled WHERE semantic_id IN {THINGS} AND instance_id > 0"
GTS = (
    "SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY distance, gt_id) AS INTEGER) AS rank FROM (SELECT *, round(sqrt(center_x*center_x + center_y*center_y), 6) AS distance FROM (SELECT frame_id, gt_id, semantic_id, instance_id, count(*) AS points,"
    " round(avg(x), 9) AS center_x, round(avg(y), 9) AS center_y, round(avg(z), 9) AS center_z FROM truth GROUP BY frame_id, gt_id, semantic_id, instance_id) WHERE points >= 5)"
)
OCELLS = "SELECT c.frame_id, c.level, c.ix, c.iy, m.object_id FROM component_cells c JOIN members m ON m.component_id = c.component_id"
INSIDE = (
    "SELECT DISTINCT p.frame_id, o.object_id, p.point_id FROM mapped p JOIN (SELECT frame_id, object_id, ix * s + s / 2 - s / 2 AS x0, ix * s + s / 2 + s / 2 AS x1, iy * s + s / 2 - s / 2 AS y0, iy * s + s / 2 + s / 2 AS y1"
    f" FROM (SELECT *, {size_of('level')} AS s FROM ocells)) o ON o.frame_id = p.frame_id AND p.x BETWEEN o.x0 AND o.x1 AND p.y BETWEEN o.y0 AND o.y1"
)
OVER = (
    "SELECT *, CAST(overlap AS DOUBLE) / gt_points AS coverage, CAST(overlap AS DOUBLE) / proposal_points AS purity, CAST(overlap AS DOUBLE) / (gt_points + proposal_points - overlap) AS iou FROM"
    " (SELECT i.frame_id, i.object_id, t.gt_id, count(*) AS overlap FROM inside i JOIN truth t ON t.frame_id = i.frame_id AND t.point_id = i.point_id GROUP BY 1, 2, 3)"
    " JOIN (SELECT frame_id, object_id, count(*) AS proposal_points FROM inside GROUP BY 1, 2) USING (frame_id, object_id) JOIN (SELECT frame_id, gt_id, count(*) AS gt_points FROM truth GROUP BY 1, 2) USING (frame_id, gt_id)"
)
PRF = (
    "SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0.0 END AS f1 FROM (SELECT frame_id, gts, coalesce(proposals, 0) AS proposals, coalesce(found, 0) AS found, coalesce(\"right\", 0) AS \"right\","
    " CASE WHEN gts > 0 THEN CAST(coalesce(found, 0) AS DOUBLE) / gts ELSE 0.0 END AS recall, CASE WHEN coalesce(proposals, 0) > 0 THEN CAST(coalesce(\"right\", 0) AS DOUBLE) / proposals ELSE 0.0 END AS precision"
    " FROM (SELECT frame_id, count(*) AS gts FROM gts GROUP BY frame_id) LEFT JOIN (SELECT frame_id, count(*) AS proposals FROM groups GROUP BY frame_id) USING (frame_id)"
    " LEFT JOIN (SELECT frame_id, count(DISTINCT gt_id) AS found FROM pairs WHERE coverage >= 0.2 GROUP BY frame_id) USING (frame_id)"
    " LEFT JOIN (SELECT frame_id, count(DISTINCT object_id) AS \"right\" FROM pairs WHERE purity >= 0.2 GROUP BY frame_id) USING (frame_id))"
)
EVAL = {"truth": TRUTH, "gts": GTS, "ocells": OCELLS, "inside": INSIDE, "pairs": OVER}
BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, object_id ORDER BY overlap DESC, gt_id) AS rk FROM pairs) WHERE rk = 1"


def stages(spark, sf_dir):
    """Points, grid, obstacle cells, cells with components, kept members and objects of all frames."""
    p = cut(points(spark, sf_dir))
    return p, *stages_of(p)


def stages_of(p):
    grid = cut(adaptive_grid(p))
    found = cut(o.obstacle_cells(grid))
    cells = cut(c.cell_components(found))
    members = cut(c.group_members(cut(c.component_filter(c.component_features(cells)))))
    return grid, found, cells, members, c.object_groups(members)


def pairs(spark, sf_dir):
    p, _, _, cells, members, groups = stages(spark, sf_dir)
    owned = cells.join(members.select("component_id", "object_id"), "component_id")
    return cut(e.overlaps(e.proposal_points(p, owned), e.gt_points(p))), groups, e.gt_objects(p)


@query("label_unpack", q("SELECT frame_id, point_id, semantic_id, instance_id FROM labelled", "labelled"))
def label_unpack(spark, sf_dir):
    return s.unpack(points(spark, sf_dir)).select("frame_id", "point_id", "semantic_id", "instance_id")


@query("semantic_counts", q(f"SELECT {K}, semantic_id, n FROM cell_labels", "cell_labels"))
def semantic_counts(spark, sf_dir):
    return s.semantic_counts(points(spark, sf_dir)).drop("resolution")


@query("dominant_class", q("SELECT * FROM dominant", "cell_labels", dominant=DOMINANT))
def dominant_class(spark, sf_dir):
    return s.dominant_class(s.semantic_counts(points(spark, sf_dir))).drop("resolution")


@query("cell_entropy", q(f"SELECT {K}, round(entropy, 9) + 0.0 AS entropy FROM entropy", "cell_labels", entropy=ENTROPY))
def cell_entropy(spark, sf_dir):
    return rounded(s.cell_entropy(s.semantic_counts(points(spark, sf_dir))), "entropy").withColumn("entropy", F.col("entropy") + 0.0)


@query("semantic_stats", q(f"SELECT frame_id, count(DISTINCT ({K})) AS cells, CAST(sum(n) AS BIGINT) AS points, count(DISTINCT semantic_id) AS classes FROM cell_labels GROUP BY frame_id", "cell_labels"))
def semantic_stats(spark, sf_dir):
    return s.semantic_stats(s.semantic_counts(points(spark, sf_dir)))


@query("semantic_totals", q(f"SELECT frame_id, semantic_id, {NAME} AS semantic_name, CAST(sum(n) AS BIGINT) AS points, count(*) AS cells FROM cell_labels GROUP BY 1, 2", "cell_labels"))
def semantic_totals(spark, sf_dir):
    """Labelled points and cells of each class, over the grid of a frame."""
    n = s.semantic_counts(points(spark, sf_dir)).groupBy("frame_id", "semantic_id").agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("cells"))
    return n.select("frame_id", "semantic_id", s.semantic_name(F.col("semantic_id")).alias("semantic_name"), "points", "cells")


@query("label_histogram", q(f"SELECT frame_id, semantic_id, {NAME} AS semantic_name, count(*) AS points, round(count(*) * 100.0 / CAST(sum(count(*)) OVER (PARTITION BY frame_id) AS DOUBLE), 6) AS percent FROM labelled GROUP BY frame_id, semantic_id", "labelled"))
def label_histogram(spark, sf_dir):
    return s.label_histogram(points(spark, sf_dir))


@query("semantic_links", q("SELECT * FROM slinks", "cell_labels", "cells", dominant=DOMINANT, entropy=ENTROPY, tcells=THING_CELLS, slinks=SLINKS))
def semantic_links(spark, sf_dir):
    return s.semantic_links(s.thing_cells(cut(s.semantic_counts(points(spark, sf_dir)))))


_THINGS = q("", "cell_labels", "cells", dominant=DOMINANT, entropy=ENTROPY, tcells=THING_CELLS, slinks=SLINKS).strip().removeprefix("WITH ")
_MEAN = lambda c: f"sum({c} * CAST(points AS DOUBLE)) / sum(CAST(points AS DOUBLE))"
HYPOTHESES = {
    "hrows": "SELECT t.*, c.component AS hypothesis_id FROM tcells t JOIN _component c ON c.id = t.cell_id",
    "htop": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY p DESC, semantic_id) AS rk, CAST(p AS DOUBLE) / sum(p) OVER (PARTITION BY hypothesis_id) AS share FROM (SELECT hypothesis_id, semantic_id, sum(points) AS p FROM hrows GROUP BY 1, 2)) WHERE rk = 1",
    "hbox": f"SELECT frame_id, hypothesis_id, count(*) AS cells, CAST(sum(points) AS BIGINT) AS points, {_MEAN('center_x')} AS center_x, {_MEAN('center_y')} AS center_y, {_MEAN('confidence')} AS conf, {_MEAN('entropy')} AS entropy,"
    " min(center_x - resolution / 2) AS min_x, max(center_x + resolution / 2) AS max_x, min(center_y - resolution / 2) AS min_y, max(center_y + resolution / 2) AS max_y FROM hrows GROUP BY 1, 2",
    "hypotheses": "SELECT b.frame_id, hypothesis_id, cells, points, center_x, center_y, entropy, min_x, max_x, min_y, max_y, semantic_id, CAST(0.65 AS DOUBLE) * share + CAST(0.35 AS DOUBLE) * conf AS confidence FROM hbox b JOIN htop USING (hypothesis_id) WHERE cells >= 2 OR points >= 8",
    "rules": "SELECT * FROM (VALUES " + ", ".join(f"({k}, {p}, {n}, CAST({w} AS DOUBLE))" for k, (p, n, w) in QUALITY.items()) + ") t(semantic_id, least_points, least_cells, least_extent)",
    "good": f"SELECT h.* FROM hypotheses h LEFT JOIN rules r USING (semantic_id) WHERE points >= coalesce(least_points, {QUALITY_DEFAULT[0]}) AND cells >= coalesce(least_cells, {QUALITY_DEFAULT[1]}) AND greatest(max_x - min_x, max_y - min_y) >= coalesce(least_extent, CAST({QUALITY_DEFAULT[2]} AS DOUBLE))",
}
MEANS = "center_x center_y min_x max_x min_y max_y confidence entropy"


def _hypotheses(select: str) -> str:
    own = "".join(f", {n} AS ({x})" for n, x in HYPOTHESES.items())
    return f"WITH RECURSIVE {_THINGS}, {reach('(SELECT cell_id AS id FROM tcells)', 'slinks')}{own} {select}"


@query("hypotheses", _hypotheses(f"SELECT frame_id, hypothesis_id, cells, points, semantic_id, {r(MEANS, 6)} FROM hypotheses"))
def hypotheses(spark, sf_dir):
    return rounded(s.hypotheses(cut(s.thing_cells(cut(s.semantic_counts(points(spark, sf_dir)))))), MEANS, 6)


@query("semantic_quality", _hypotheses(f"SELECT frame_id, hypothesis_id, cells, points, semantic_id, {r(MEANS, 6)} FROM good"))
def semantic_quality(spark, sf_dir):
    """Hypotheses that pass the quality rules of their class."""
    return rounded(s.quality_filter(s.hypotheses(cut(s.thing_cells(cut(s.semantic_counts(points(spark, sf_dir))))))), MEANS, 6)


@query("merged_fragments")
def merged_fragments(spark, sf_dir):
    return s.merged_fragments(cut(s.hypotheses(cut(s.thing_cells(cut(s.semantic_counts(points(spark, sf_dir))))))))


@query("semantic_objects")
def semantic_objects(spark, sf_dir):
    """Hypotheses after the quality rules of their class, the merge of fragments, and the rules again."""
    return s.semantic_objects(s.thing_cells(cut(s.semantic_counts(points(spark, sf_dir)))))


@query("gt_objects", q("SELECT * FROM gts", "labelled", truth=TRUTH, gts=GTS))
def gt_objects(spark, sf_dir):
    return e.gt_objects(points(spark, sf_dir))


@query("cell_instances", q(f"SELECT {K}, array_to_string(list_sort(list(DISTINCT label // 65536)), ',') AS instances FROM mapped WHERE label // 65536 > 0 GROUP BY {K}", "mapped"))
def cell_instances(spark, sf_dir):
    return e.cell_instances(points(spark, sf_dir))


METRICS = "coverage purity iou"


@query("overlap_metrics", q(f"SELECT frame_id, object_id, gt_id, overlap, gt_points, proposal_points, {r(METRICS)} FROM pairs", "groups", "labelled", **EVAL))
def overlap_metrics(spark, sf_dir):
    return rounded(pairs(spark, sf_dir)[0], METRICS)


@query("best_overlap", q("SELECT frame_id, object_id, gt_id, overlap FROM best", "groups", "labelled", **EVAL, best=BEST))
def best_overlap(spark, sf_dir):
    return e.best_overlap(pairs(spark, sf_dir)[0]).select("frame_id", "object_id", "gt_id", "overlap")


def greedy(where: str) -> dict[str, str]:
    """One-to-one matching in SQL: each frame's pairs, best first, folded over the lists of what is taken."""
    order = "coverage DESC, iou DESC, purity DESC, overlap DESC, object_id, gt_id"
    taken = "list_contains(w.os, p.object_id) OR list_contains(w.gs, p.gt_id)"
    return {
        "queue": f"SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {order}) AS k FROM pairs WHERE {where}",
        "walk": "SELECT DISTINCT frame_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS os, CAST([] AS BIGINT[]) AS gs FROM queue UNION ALL SELECT w.frame_id, p.k,"
        f" CASE WHEN {taken} THEN w.os ELSE list_append(w.os, p.object_id) END, CASE WHEN {taken} THEN w.gs ELSE list_append(w.gs, p.gt_id) END FROM walk w JOIN queue p ON p.frame_id = w.frame_id AND p.k = w.k + 1",
        "matched": "SELECT p.* FROM queue p JOIN (SELECT frame_id, max_by(os, k) AS os, max_by(gs, k) AS gs FROM walk GROUP BY 1) w ON w.frame_id = p.frame_id"
        " WHERE list_contains(w.os, p.object_id) AND list_position(w.os, p.object_id) = list_position(w.gs, p.gt_id)",
    }


@query("match_one_to_one", q(f"SELECT frame_id, object_id, gt_id, overlap, proposal_points, gt_points, {r(METRICS)} FROM matched", "groups", "labelled", **EVAL, **greedy("coverage >= 0.2")))
def match_one_to_one(spark, sf_dir):
    return rounded(e.match_one_to_one(pairs(spark, sf_dir)[0]), METRICS)


@query("detection_prf", q(f'SELECT frame_id, gts, proposals, found, "right", {r("recall precision f1")} FROM prf', "groups", "labelled", **EVAL, prf=PRF))
def detection_prf(spark, sf_dir):
    found, groups, gts = pairs(spark, sf_dir)
    return rounded(e.detection_prf(found, groups, gts), "recall precision f1")


@query("batch_eval", q('SELECT count(*) AS frames, CAST(sum(gts) AS BIGINT) AS gts, CAST(sum(proposals) AS BIGINT) AS proposals, round(CAST(sum(found) AS DOUBLE) / sum(gts), 9) AS micro_recall, round(CAST(sum("right") AS DOUBLE) / sum(proposals), 9) AS micro_precision, round(avg(recall), 9) AS macro_recall, round(avg(precision), 9) AS macro_precision,'
    ' round(CASE WHEN sum(found) + sum("right") > 0 THEN 2 * (CAST(sum(found) AS DOUBLE) / sum(gts)) * (CAST(sum("right") AS DOUBLE) / sum(proposals)) / (CAST(sum(found) AS DOUBLE) / sum(gts) + CAST(sum("right") AS DOUBLE) / sum(proposals)) ELSE 0.0 END, 9) AS micro_f1, round(avg(f1), 9) AS macro_f1 FROM prf', "groups", "labelled", **EVAL, prf=PRF))
def batch_eval(spark, sf_dir):
    found, groups, gts = pairs(spark, sf_dir)
    return e.batch_eval(e.detection_prf(found, groups, gts))


@query("recall_by_bucket", q(f"SELECT {bucket('distance')} AS bucket, semantic_id, count(*) AS gts, count(f.gt_id) AS found, round(CAST(count(f.gt_id) AS DOUBLE) / count(*), 9) AS recall FROM gts g LEFT JOIN (SELECT DISTINCT frame_id, gt_id FROM pairs WHERE coverage >= 0.2) f ON f.frame_id = g.frame_id AND f.gt_id = g.gt_id GROUP BY 1, 2", "groups", "labelled", **EVAL))
def recall_by_bucket(spark, sf_dir):
    found, _, gts = pairs(spark, sf_dir)
    return e.recall_by_bucket(found, gts)


@query("fragmentation", q("SELECT frame_id, count(*) AS covered, CAST(sum(n - 1) AS BIGINT) AS fragments FROM (SELECT frame_id, gt_id, count(*) AS n FROM pairs WHERE purity >= 0.2 GROUP BY 1, 2) GROUP BY frame_id", "groups", "labelled", **EVAL))
def fragmentation(spark, sf_dir):
    return e.fragmentation(pairs(spark, sf_dir)[0])


@query("contested_pairs", q("SELECT frame_id, object_id, count(*) AS gts FROM pairs WHERE coverage >= 0.2 AND purity >= 0.2 GROUP BY 1, 2 HAVING count(*) > 1", "groups", "labelled", **EVAL))
def contested_pairs(spark, sf_dir):
    return e.contested(pairs(spark, sf_dir)[0])


@query("confusion", q("SELECT classification, gt_id % 65536 AS semantic_id, count(*) AS objects FROM best JOIN proposals USING (frame_id, object_id) GROUP BY 1, 2", "proposals", "labelled", **EVAL, best=BEST))
def confusion(spark, sf_dir):
    found, groups, _ = pairs(spark, sf_dir)
    return e.confusion(e.best_overlap(found), c.proposals(groups))


@query(
    "stage_funnel",
    q(
        "SELECT t.frame_id, gt_id, count(*) AS in_range, count(CASE WHEN NOT is_ground THEN 1 END) AS not_ground, count(CASE WHEN NOT is_ground AND o.cell_id IS NOT NULL THEN 1 END) AS obstacle, count(CASE WHEN NOT is_ground AND k.ix IS NOT NULL THEN 1 END) AS component"
        " FROM truth t LEFT JOIN obstacles o ON o.frame_id = t.frame_id AND o.level = t.level AND o.ix = t.ix AND o.iy = t.iy LEFT JOIN kcells k ON k.frame_id = t.frame_id AND k.level = t.level AND k.ix = t.ix AND k.iy = t.iy GROUP BY 1, 2",
        "kept",
        truth=f"SELECT *, label AS gt_id FROM mapped WHERE label % 65536 IN {THINGS} AND label // 65536 > 0",
        kcells="SELECT c.* FROM component_cells c JOIN kept k ON k.component_id = c.component_id",
    ),
)
def stage_funnel(spark, sf_dir):
    p, _, found, cells, members, _ = stages(spark, sf_dir)
    return e.stage_funnel(p, found, cells.join(members.select("component_id"), "component_id", "left_semi"))

