"""Queries on where labelled objects are lost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfield.operators import detector as det
from ringfield.operators import evaluation as e
from ringfield.operators import failures as f
from ringfield.operators import semantic as s
from ringfield.operators.graph import cut
from ringfield.operators.grid import KEY, adaptive_grid
from ringfield.plans.evaluation import EVAL, THINGS, greedy, stages
from ringfield.plans.registry import query, rounded
from ringfield.plans.sql import PARTS, bucket, d
from ringfield.plans.sql import query as q
from ringfield.plans.sql import rounded as r
from ringfield.sources.derived import points

K = "frame_id, level, ix, iy"
TCELLS = f"SELECT frame_id, gt_id, level, ix, iy, count(*) AS n, count(CASE WHEN is_ground THEN 1 END) AS ground FROM (SELECT *, label AS gt_id FROM mapped WHERE label % 65536 IN {THINGS} AND label // 65536 > 0) GROUP BY ALL"
NEAR = PARTS["local"].replace("c.obstacle_count >= 3", f"(c.frame_id, c.level, c.ix, c.iy) IN (SELECT ({K}) FROM tcells)")
STATES = ("unresolved_reference", "no_obstacle_elevation", "too_few_points", "height_failed", "obstacle_eligible")
STATE = (
    "CASE WHEN g IS NULL THEN 'unresolved_reference' WHEN top IS NULL THEN 'no_obstacle_elevation' WHEN obstacle_count < 3 THEN 'too_few_points'"
    f" WHEN top - g < {d('0.15')} THEN 'height_failed' ELSE 'obstacle_eligible' END"
)
DIAGNOSTIC = {
    "tcells": TCELLS,
    "near": NEAR,
    "checked": f"SELECT *, top - g AS height, {STATE} AS st FROM (SELECT t.*, coalesce(c.ground_elevation, l.local_elevation) AS g, CASE WHEN c.ground_elevation IS NOT NULL THEN 'SAME-CELL' WHEN l.local_elevation IS NOT NULL THEN 'RECOVERED' ELSE 'UNRESOLVED' END AS ground_source, c.obstacle_elevation AS top, c.obstacle_count, o.cell_id IS NOT NULL AS seen FROM tcells t JOIN stats c USING ({K}) LEFT JOIN near l USING ({K}) LEFT JOIN obstacles o USING ({K}))",
    "tallied": "SELECT frame_id, gt_id, CAST(sum(n) AS BIGINT) AS range_points, CAST(sum(ground) AS BIGINT) AS ground_points, count(*) AS cell_count, "
    + ", ".join(f"CAST(sum(CASE WHEN st = '{x}' THEN n ELSE 0 END) AS BIGINT) AS {x}" for x in STATES)
    + ", CAST(sum(CASE WHEN seen THEN n ELSE 0 END) AS BIGINT) AS obstacle_cell_points FROM checked GROUP BY 1, 2",
    "held": f"SELECT frame_id, gt_id, CAST(max(n) AS BIGINT) AS final_points FROM (SELECT frame_id, gt_id, object_id, sum(n) AS n FROM tcells JOIN ocells USING ({K}) GROUP BY 1, 2, 3) GROUP BY 1, 2",
}
COUNTS = ", ".join(f"coalesce({x}, 0) AS {x}" for x in ("range_points", "ground_points", "cell_count", *STATES, "obstacle_cell_points", "final_points"))
CONTESTED = (
    "SELECT a.frame_id, a.object_id, a.gt_id AS gt_a, b.gt_id AS gt_b FROM pairs a JOIN pairs b ON a.frame_id = b.frame_id AND a.object_id = b.object_id AND a.gt_id < b.gt_id"
    " WHERE a.coverage >= 0.2 AND a.purity >= 0.2 AND b.coverage >= 0.2 AND b.purity >= 0.2"
)
BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, gt_id ORDER BY coverage DESC, iou DESC, purity DESC, overlap DESC, object_id) AS rk FROM pairs) WHERE rk = 1"


class Bundle:
    """Every stage of the grouping path and the pairs with labelled objects."""

    def __init__(self, spark, sf_dir):
        self.points, self.grid, self.obstacles, self.cells, self.members, _ = stages(spark, sf_dir)
        self.owned = self.cells.join(self.members.select("component_id", "object_id"), "component_id")
        self.truth = cut(f.gt_cells(self.points))

    def pairs(self):
        return cut(e.overlaps(e.proposal_points(self.points, self.owned), e.gt_points(self.points)))

    def diagnostic(self):
        return f.gt_diagnostic(e.gt_objects(self.points), self.truth, self.grid, self.obstacles, self.owned)


DIAG = f"SELECT *, CAST(final_points AS DOUBLE) / points AS best_coverage, CASE WHEN range_points > 0 THEN CAST(ground_points AS DOUBLE) / range_points ELSE 0.0 END AS ground_share FROM (SELECT frame_id, gt_id, semantic_id, distance, points, {COUNTS} FROM gts LEFT JOIN tallied USING (frame_id, gt_id) LEFT JOIN held USING (frame_id, gt_id))"
SHARES = "best_coverage ground_share"
EVERY = ", ".join(("frame_id", "gt_id", "semantic_id", "distance", "points", "range_points", "ground_points", "cell_count", *STATES, "obstacle_cell_points", "final_points"))


@query("gt_diagnostic", q(f"SELECT {EVERY}, {r(SHARES)} FROM diag", "groups", "labelled", **EVAL, **DIAGNOSTIC, diag=DIAG))
def gt_diagnostic(spark, sf_dir):
    return rounded(Bundle(spark, sf_dir).diagnostic(), SHARES)


def _states(spark, sf_dir):
    p = points(spark, sf_dir)
    return f.cell_states(cut(f.gt_cells(p)), cut(adaptive_grid(p)))


FATE = "CASE st " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in f.FATES.items()) + " END"
CHECKED = {k: DIAGNOSTIC[k] for k in ("tcells", "near", "checked")}


@query("gt_loss", q(f"SELECT frame_id, {FATE} AS reason, CAST(sum(n) AS BIGINT) AS points FROM checked GROUP BY 1, 2", "obstacles", **CHECKED))
def gt_loss(spark, sf_dir):
    return f.gt_loss(_states(spark, sf_dir))


BIN = "CASE WHEN height < 0 THEN 'below' " + " ".join(f"WHEN height < {d(hi)} THEN '{lo:.2f}-{hi:.2f}'" for lo, hi in zip(f.BINS, f.BINS[1:], strict=False)) + " END"


@query("gt_loss_heights", q(f"SELECT frame_id, {BIN} AS bin, CAST(sum(n) AS BIGINT) AS points, count(*) AS cells, round(min(height), 9) AS min_height, round(max(height), 9) AS max_height FROM checked WHERE st = 'height_failed' GROUP BY 1, 2", "obstacles", **CHECKED))
def gt_loss_heights(spark, sf_dir):
    return rounded(f.loss_heights(_states(spark, sf_dir)), "min_height max_height")


@query(
    "gt_trace",
    q(f"SELECT {K}, t.gt_id, n, ground AS ground_n, ground_source, round(g, 9) AS ground, top AS obstacle_elevation, t.obstacle_count, round(height, 9) AS height, st AS state, c.component_id, CASE WHEN c.component_id IS NOT NULL THEN c.component_id IN (SELECT component_id FROM kept) END AS component_kept, object_id"
      f" FROM checked t LEFT JOIN (SELECT {K}, component_id FROM component_cells) c USING ({K}) LEFT JOIN ocells USING ({K})", "groups", **CHECKED, ocells=EVAL["ocells"]),
)
def gt_trace(spark, sf_dir):
    """Every cell of every labelled object, from its points to the object that holds it."""
    b = Bundle(spark, sf_dir)
    return rounded(f.gt_trace(f.cell_states(b.truth, b.grid), b.cells, b.members, b.owned), "ground height")


def _reasons(spark, sf_dir):
    b = Bundle(spark, sf_dir)
    pairs = b.pairs()
    return f.failure_reasons(b.diagnostic(), pairs, e.match_one_to_one(f.qualified(pairs)))


UNSEEN = "obstacle_cell_points = 0"
REASON = (
    "CASE WHEN accepted THEN 'DETECTED' WHEN coverage >= 0.2 AND purity < 0.2 THEN 'MERGED_OR_LOW_PURITY' WHEN coverage >= 0.2 THEN 'MATCHING_FAILURE' WHEN best_coverage > 0 AND best_coverage < 0.2 THEN 'LOW_COMPONENT_COVERAGE'"
    f" WHEN obstacle_eligible = 0 AND too_few_points > 0 THEN 'SPARSE_OBSTACLE_POINTS' WHEN ground_share >= 0.2 AND {UNSEEN} THEN 'GROUND_OVERREJECTION_FLAG' WHEN unresolved_reference > 0 THEN 'NO_TERRAIN_REFERENCE'"
    f" WHEN height_failed > 0 AND {UNSEEN} THEN 'HEIGHT_THRESHOLD' WHEN no_obstacle_elevation > 0 AND {UNSEEN} THEN 'NO_OBSTACLE_ELEVATION' WHEN obstacle_cell_points > 0 AND final_points = 0 THEN 'COMPONENT_FILTERED_OUT' ELSE 'NO_OBSTACLE_CELLS' END"
)
REASONS = {
    **EVAL, **DIAGNOSTIC, "diag": DIAG, "best": BEST, **greedy("coverage >= 0.2 AND purity >= 0.2"),
    "reasons": f"SELECT *, {REASON} AS reason FROM (SELECT g.*, b.coverage, b.purity, m.gt_id IS NOT NULL AS accepted FROM diag g LEFT JOIN best b USING (frame_id, gt_id) LEFT JOIN matched m USING (frame_id, gt_id))",
}
FOUR = f"{SHARES} coverage purity"


@query("failure_reason", q(f"SELECT {EVERY}, {r(FOUR)}, reason FROM reasons", "groups", "labelled", **REASONS))
def failure_reason(spark, sf_dir):
    return rounded(_reasons(spark, sf_dir), FOUR)


@query(
    "difficult_objects",
    q("SELECT frame_id, rank, gt_id, semantic_id, distance, round(covered, 9) AS covered, reason FROM (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY covered, distance, gt_id) AS INTEGER) AS rank FROM"
      " (SELECT *, coalesce(coverage, best_coverage) AS covered FROM reasons WHERE reason <> 'DETECTED')) WHERE rank <= 15", "groups", "labelled", **REASONS),
)
def difficult_objects(spark, sf_dir):
    return rounded(f.difficult(cut(_reasons(spark, sf_dir))), "covered")


@query("failure_histogram", q(f"SELECT reason, {bucket('distance')} AS bucket, semantic_id, count(*) AS objects FROM reasons GROUP BY 1, 2, 3", "groups", "labelled", **REASONS))
def failure_histogram(spark, sf_dir):
    return f.histogram(_reasons(spark, sf_dir))


@query("detector_failures")
def detector_failures(spark, sf_dir):
    """Failure reasons of the detector's path, whose objects are closest-first merges."""
    from ringfield.plans.objects import obstacles

    p, found = points(spark, sf_dir), obstacles(spark, sf_dir)
    cells, members, _ = det.detect(found)
    owned = cells.join(members.select("component_id", "object_id"), "component_id")
    pairs = cut(e.overlaps(e.proposal_points(p, owned), e.gt_points(p)))
    rows = f.gt_diagnostic(e.gt_objects(p), cut(f.gt_cells(p)), cut(adaptive_grid(p)), found, owned)
    return rounded(f.failure_reasons(rows, pairs, e.match_one_to_one(f.qualified(pairs))), "best_coverage ground_share coverage purity")


@query("contested_gt_pairs", q("SELECT * FROM contested", "groups", "labelled", **EVAL, contested=CONTESTED))
def contested_gt_pairs(spark, sf_dir):
    return f.contested_pairs(Bundle(spark, sf_dir).pairs())


MODES = {"xy": "true", "up": "NOT is_ground", "band": f"z BETWEEN ground_elevation - {d('0.05')} AND obstacle_elevation + {d('0.05')}"}
_ON = lambda m, e, suffix: f"count(CASE WHEN {e} THEN 1 END) AS {m}_{suffix}"
VARIANTS = {
    "best": BEST,
    "own": f"SELECT p.*, o.object_id, c.ground_elevation, c.obstacle_elevation FROM mapped p JOIN ocells o USING ({K}) JOIN component_cells c USING ({K})",
    "sizes": f"SELECT frame_id, object_id, {', '.join(_ON(m, x, 'points') for m, x in MODES.items())} FROM own GROUP BY 1, 2",
    "shares": f"SELECT frame_id, object_id, label AS gt_id, {', '.join(_ON(m, x, 'n') for m, x in MODES.items())} FROM own WHERE label % 65536 IN {THINGS} AND label // 65536 > 0 GROUP BY 1, 2, 3",
    "measured": "SELECT frame_id, gt_id, object_id, "
    + ", ".join(
        f"{m}_points, CASE WHEN gt_points > 0 THEN CAST(coalesce({m}_n, 0) AS DOUBLE) / gt_points ELSE 0.0 END AS {m}_coverage, CASE WHEN {m}_points > 0 THEN CAST(coalesce({m}_n, 0) AS DOUBLE) / {m}_points ELSE CAST(0 AS DOUBLE) END AS {m}_purity,"
        f" CASE WHEN {m}_points + gt_points - coalesce({m}_n, 0) > 0 THEN CAST(coalesce({m}_n, 0) AS DOUBLE) / ({m}_points + gt_points - coalesce({m}_n, 0)) ELSE CAST(0 AS DOUBLE) END AS {m}_iou"
        for m in MODES
    )
    + " FROM best JOIN sizes USING (frame_id, object_id) LEFT JOIN shares USING (frame_id, object_id, gt_id)",
}
RATIOS = " ".join(f"{m}_{x}" for m in MODES for x in ("coverage", "purity", "iou"))
VERDICT = (
    f"CASE WHEN (up_purity - xy_purity) * {d(100)} > 10.0 AND up_coverage >= greatest({d('0.2')}, xy_coverage - {d('0.1')}) THEN 'STRONG SUPPORT' WHEN (up_purity - xy_purity) * {d(100)} > 5.0 THEN 'PARTIAL SUPPORT' ELSE 'WEAK / NO SUPPORT' END"
)


@query("recovery_variants", q(f"SELECT frame_id, gt_id, object_id, {', '.join(f'{m}_points' for m in MODES)}, {r(RATIOS)}, {VERDICT} AS verdict FROM measured", "groups", "labelled", **EVAL, **VARIANTS))
def recovery_variants(spark, sf_dir):
    b = Bundle(spark, sf_dir)
    return rounded(f.recovery_variants(b.points, b.owned, f.best_candidates(b.pairs())), RATIOS)


WHERE = (
    "CASE WHEN obstacle_points = 0 THEN 'NO_OBSTACLE_EVIDENCE' WHEN raw_cells = 0 THEN 'OBSTACLE_CELLS_BUT_NO_RAW_COMPONENT' WHEN filtered_cells = 0 THEN 'COMPONENT_FILTERED_OUT'"
    " WHEN merged_cells = 0 THEN 'FILTERED_COMPONENT_LOST_BEFORE_MERGE' ELSE 'EVIDENCE_REACHED_COMPONENT_STAGE' END"
)


@query(
    "component_localization",
    q(f"SELECT *, {WHERE} AS classification FROM (SELECT frame_id, gt_id, count(*) AS gt_cells, count(c.cell_id) AS obstacle_cells, CAST(coalesce(sum(CASE WHEN c.cell_id IS NOT NULL THEN n END), 0) AS BIGINT) AS obstacle_points,"
      f" count(c.component_id) AS raw_cells, count(k.component_id) AS filtered_cells, count(o.object_id) AS merged_cells FROM tcells t LEFT JOIN component_cells c USING ({K})"
      f" LEFT JOIN (SELECT component_id FROM kept) k ON k.component_id = c.component_id LEFT JOIN ocells o USING ({K}) GROUP BY 1, 2)", "groups", tcells=TCELLS, ocells=EVAL["ocells"]),
)
def component_localization(spark, sf_dir):
    b = Bundle(spark, sf_dir)
    kept = b.cells.join(b.members.select("component_id"), "component_id", "left_semi")
    return f.localization(b.truth, b.obstacles, b.cells, kept, b.owned)


@query(
    "first_shared_stage",
    q(f"SELECT p.frame_id, p.gt_a, p.gt_b, CASE coalesce(min(s.k), 3) WHEN 0 THEN 'RAW' WHEN 1 THEN 'FILTERED' WHEN 2 THEN 'MERGED' ELSE 'NEVER' END AS stage FROM (SELECT DISTINCT frame_id, gt_a, gt_b FROM contested) p LEFT JOIN"
      " (SELECT DISTINCT a.frame_id, a.gt_id AS ga, b.gt_id AS gb, a.k FROM touched a JOIN touched b ON a.frame_id = b.frame_id AND a.k = b.k AND a.part = b.part) s ON s.frame_id = p.frame_id AND s.ga = p.gt_a AND s.gb = p.gt_b GROUP BY 1, 2, 3", "groups", "labelled",
      **EVAL, contested=CONTESTED, tcells=TCELLS,
      touched=f"SELECT DISTINCT frame_id, gt_id, k, part FROM tcells JOIN (SELECT {K}, 0 AS k, component_id AS part FROM component_cells UNION ALL SELECT {K}, 1, component_id FROM component_cells WHERE component_id IN (SELECT component_id FROM kept) UNION ALL SELECT {K}, 2, object_id FROM ocells) USING ({K})"),
)
def first_shared_stage(spark, sf_dir):
    b = Bundle(spark, sf_dir)
    kept = b.cells.join(b.members.select("component_id"), "component_id", "left_semi")
    part = lambda df, c: df.select(*KEY, F.col(c).alias("part"))
    return f.first_shared_stage(f.contested_pairs(b.pairs()), b.truth, [("RAW", part(b.cells, "component_id")), ("FILTERED", part(kept, "component_id")), ("MERGED", part(b.owned, "object_id"))])


@query("semantic_merge_events")
def semantic_merge_events(spark, sf_dir):
    """Semantic objects that hold two hypotheses of their class or more, by their boxes."""
    before = cut(s.quality_filter(s.hypotheses(cut(s.thing_cells(cut(s.semantic_counts(points(spark, sf_dir))))))))
    name = lambda df: df.withColumnRenamed("hypothesis_id", "id")
    return f.contained(name(before), name(s.merged_fragments(before)))
