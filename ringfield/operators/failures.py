"""Where labelled objects are lost between the points and the proposals, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfield.config import Obstacles
from ringfield.functions import classify
from ringfield.operators.evaluation import gt_points
from ringfield.operators.grid import KEY, cell_stats, with_cell
from ringfield.operators.obstacles import local_ground

# Least coverage and purity of a pair, share of ground points that is suspicious, slack of the height band.
LEAST, GROUND_SHARE, BAND = 0.20, 0.20, 0.05
GT = ["frame_id", "gt_id"]


def gt_cells(points: DataFrame) -> DataFrame:
    """Points of each labelled object by grid cell, and how many of them are ground."""
    return with_cell(gt_points(points)).groupBy("frame_id", "gt_id", "level", "ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_ground").alias("ground_n"))


def cell_states(truth: DataFrame, cells: DataFrame, cfg: Obstacles = Obstacles()) -> DataFrame:
    """truth (gt_cells) with what each cell is tested on, in the order of the tests: ground_source (SAME-CELL,
    RECOVERED from the neighbours, UNRESOLVED), ground, obstacle_elevation, obstacle_count, height and state."""
    bare = cells.where("ground_count = 0").join(truth.select(*KEY).distinct(), KEY, "left_semi")
    near = local_ground(cells, cfg, bare.select(*KEY, "resolution")).select(*KEY, "local_elevation")
    stats = cell_stats(cells).select(*KEY, "ground_elevation", "obstacle_elevation", "obstacle_count")
    rows = truth.join(stats, KEY, "left").join(near, KEY, "left")
    ground, top = F.coalesce("ground_elevation", "local_elevation"), F.col("obstacle_elevation")
    source = F.when(F.col("ground_elevation").isNotNull(), "SAME-CELL").when(F.col("local_elevation").isNotNull(), "RECOVERED").otherwise("UNRESOLVED")
    rows = rows.select(*truth.columns, source.alias("ground_source"), ground.alias("ground"), "obstacle_elevation", "obstacle_count", (top - ground).alias("height"))
    state = (
        F.when(F.col("obstacle_count").isNull(), "missing_cell").when(F.col("ground").isNull(), "unresolved_reference").when(F.col("obstacle_elevation").isNull(), "no_obstacle_elevation")
        .when(F.col("obstacle_count") < cfg.min_points, "too_few_points").when(F.col("height") < cfg.min_height, "height_failed").otherwise("obstacle_eligible")
    )
    return rows.withColumn("state", state)


# Names of a point's fate, by the state of its cell.
FATES = {
    "missing_cell": "MISSING_CELL", "unresolved_reference": "NO_GROUND_REFERENCE", "no_obstacle_elevation": "NO_OBSTACLE_ELEVATION",
    "too_few_points": "TOO_FEW_OBSTACLE_POINTS", "height_failed": "HEIGHT_BELOW_THRESHOLD", "obstacle_eligible": "PASSED",
}
# Bins of heights below the threshold, in metres.
BINS = (0.0, 0.05, 0.10, 0.15)


def gt_loss(states: DataFrame) -> DataFrame:
    """Why points of gt objects do not reach an obstacle cell, by frame."""
    name = F.create_map(*[F.lit(x) for pair in FATES.items() for x in pair])
    return states.groupBy("frame_id", F.try_element_at(name, F.col("state")).alias("reason")).agg(F.sum("n").alias("points"))


def loss_heights(states: DataFrame) -> DataFrame:
    """Points of gt objects in cells that are too low, by frame and bin of height; those below the ground are a bin of their own."""
    h = F.col("height")
    bin_of = F.when(h < BINS[0], "below")
    for lo, hi in zip(BINS, BINS[1:], strict=False):
        bin_of = bin_of.when(h < hi, f"{lo:.2f}-{hi:.2f}")
    rows = states.where("state = 'height_failed'").withColumn("bin", bin_of)
    return rows.groupBy("frame_id", "bin").agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("cells"), F.min("height").alias("min_height"), F.max("height").alias("max_height"))


def gt_trace(states: DataFrame, components: DataFrame, kept: DataFrame, owned: DataFrame) -> DataFrame:
    """Every cell of every labelled object on its way: points, ground, test, component, whether that was kept, object.
    components: KEY with component_id; kept: component_id; owned: KEY with object_id."""
    rows = states.join(components.select(*KEY, "component_id"), KEY, "left").join(kept.select("component_id", F.lit(True).alias("component_kept")), "component_id", "left")
    return rows.join(owned.select(*KEY, "object_id"), KEY, "left").withColumn("component_kept", F.when(F.col("component_id").isNotNull(), F.coalesce("component_kept", F.lit(False))))


def gt_diagnostic(gts: DataFrame, truth: DataFrame, cells: DataFrame, obstacles: DataFrame, owned: DataFrame, cfg: Obstacles = Obstacles()) -> DataFrame:
    """Each gt's points by what its cells lack, in the order of the pipeline's tests, and the share of it that its best object holds.
    truth: gt_cells; owned: KEY with object_id, the cells of the final objects."""
    rows = cell_states(truth, cells, cfg).join(obstacles.select(*KEY, F.lit(True).alias("_o")), KEY, "left")
    lost = ("unresolved_reference", "no_obstacle_elevation", "too_few_points", "height_failed", "obstacle_eligible")
    state = F.when(F.col("state") == "missing_cell", "unresolved_reference").otherwise(F.col("state"))
    by_state = rows.groupBy(*GT, state.alias("_s")).agg(
        F.sum("n").alias("_n"), F.sum("ground_n").alias("_g"), F.count(F.lit(1)).alias("_c"), F.coalesce(F.sum(F.when(F.col("_o"), F.col("n"))), F.lit(0)).alias("_seen")
    )
    n = lambda s: F.coalesce(F.sum(F.when(F.col("_s") == s, F.col("_n"))), F.lit(0)).alias(s)
    found = by_state.groupBy(*GT).agg(F.sum("_n").alias("range_points"), F.sum("_g").alias("ground_points"), F.sum("_c").alias("cell_count"), *map(n, lost), F.sum("_seen").alias("obstacle_cell_points"))
    best = truth.join(owned.select(*KEY, "object_id"), KEY).groupBy(*GT, "object_id").agg(F.sum("n").alias("_n")).groupBy(*GT).agg(F.max("_n").alias("final_points"))
    counts = ["range_points", "ground_points", "cell_count", *lost, "obstacle_cell_points", "final_points"]
    out = gts.select(*GT, "semantic_id", "distance", "points").join(found, GT, "left").join(best, GT, "left").na.fill(0, counts)
    return out.withColumns({"best_coverage": F.col("final_points") / F.col("points"), "ground_share": F.when(F.col("range_points") > 0, F.col("ground_points") / F.col("range_points")).otherwise(0.0)})


def best_candidates(pairs: DataFrame) -> DataFrame:
    """The pair that covers most of each gt."""
    w = Window.partitionBy(*GT).orderBy(F.desc("coverage"), F.desc("iou"), F.desc("purity"), F.desc("overlap"), "object_id")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# Fixed values below: names of the outcomes.
def reason(accepted: Column) -> Column:
    """Why a gt has no proposal of its own; the first rule that holds. Needs gt_diagnostic with coverage and purity of the best pair."""
    c = F.col
    unseen = c("obstacle_cell_points") == 0
    return (
        F.when(accepted, "DETECTED")
        .when((c("coverage") >= LEAST) & (c("purity") < LEAST), "MERGED_OR_LOW_PURITY")
        .when(c("coverage") >= LEAST, "MATCHING_FAILURE")
        .when((c("best_coverage") > 0) & (c("best_coverage") < LEAST), "LOW_COMPONENT_COVERAGE")
        .when((c("obstacle_eligible") == 0) & (c("too_few_points") > 0), "SPARSE_OBSTACLE_POINTS")
        .when((c("ground_share") >= GROUND_SHARE) & unseen, "GROUND_OVERREJECTION_FLAG")
        .when(c("unresolved_reference") > 0, "NO_TERRAIN_REFERENCE")
        .when((c("height_failed") > 0) & unseen, "HEIGHT_THRESHOLD")
        .when((c("no_obstacle_elevation") > 0) & unseen, "NO_OBSTACLE_ELEVATION")
        .when(~unseen & (c("final_points") == 0), "COMPONENT_FILTERED_OUT")
        .otherwise("NO_OBSTACLE_CELLS")
    )


def failure_reasons(diagnostic: DataFrame, pairs: DataFrame, matched: DataFrame) -> DataFrame:
    """matched: (frame_id, gt_id) of the accepted one-to-one pairs."""
    rows = diagnostic.join(best_candidates(pairs).select(*GT, "coverage", "purity"), GT, "left").join(matched.select(*GT, F.lit(True).alias("_a")), GT, "left")
    return rows.withColumn("reason", reason(F.coalesce("_a", F.lit(False)))).drop("_a")


def histogram(reasons: DataFrame) -> DataFrame:
    """Labelled objects by the reason of their failure, distance and class."""
    return reasons.groupBy("reason", classify.distance_bucket(F.col("distance")).alias("bucket"), "semantic_id").agg(F.count(F.lit(1)).alias("objects"))


def difficult(reasons: DataFrame, k: int = 15) -> DataFrame:
    """The k undetected gts of each frame that are covered least, the nearer first."""
    w = Window.partitionBy("frame_id").orderBy("_c", "distance", "gt_id")
    rows = reasons.where("reason <> 'DETECTED'").withColumn("_c", F.coalesce("coverage", "best_coverage"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("_c", "covered").select("frame_id", "rank", "gt_id", "semantic_id", "distance", "covered", "reason")


def qualified(pairs: DataFrame, least: float = LEAST) -> DataFrame:
    return pairs.where((F.col("coverage") >= least) & (F.col("purity") >= least))


def contested_pairs(pairs: DataFrame) -> DataFrame:
    """(frame_id, object_id, gt_a, gt_b): objects that qualify for two gts. An object qualifies for five gts at most (purity)."""
    q = qualified(pairs).groupBy("frame_id", "object_id").agg(F.sort_array(F.collect_list("gt_id")).alias("_g")).where(F.size("_g") > 1)
    rows = q.select("frame_id", "object_id", "_g", F.posexplode("_g").alias("_k", "gt_a"))
    return rows.select("frame_id", "object_id", "gt_a", F.explode(F.slice("_g", F.col("_k") + 2, F.size("_g"))).alias("gt_b"))


# Fixed values below: names of the verdicts and the gains that they ask for.
def recovery_variants(points: DataFrame, cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """How the best pair of each gt would fare if the proposal's points were those of its cells (xy), without ground (up),
    or within the heights of their cell (band), and whether leaving ground out would help.
    cells: KEY with object_id and elevations; candidates: best_candidates."""
    at = with_cell(points).join(cells.select(*KEY, "object_id", "ground_elevation", "obstacle_elevation"), KEY)
    on = {"xy": F.lit(True), "up": ~F.col("is_ground"), "band": F.col("z").between(F.col("ground_elevation") - BAND, F.col("obstacle_elevation") + BAND)}
    size = at.groupBy("frame_id", "object_id").agg(*[F.count_if(e).alias(f"{m}_points") for m, e in on.items()])
    both = at.join(gt_points(points).select("frame_id", "point_id", "gt_id"), ["frame_id", "point_id"]).groupBy("frame_id", "object_id", "gt_id").agg(*[F.count_if(e).alias(f"_{m}") for m, e in on.items()])
    rows = candidates.select(*GT, "object_id", "gt_points").join(size, ["frame_id", "object_id"]).join(both, ["frame_id", "object_id", "gt_id"], "left").na.fill(0)
    for m in on:
        n, p, g = F.col(f"_{m}"), F.col(f"{m}_points"), F.col("gt_points")
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
        rows = rows.withColumns({f"{m}_coverage": ratio(n, g), f"{m}_purity": ratio(n, p), f"{m}_iou": ratio(n, p + g - n)})
    gain = (F.col("up_purity") - F.col("xy_purity")) * 100.0
    held = F.col("up_coverage") >= F.greatest(F.lit(LEAST), F.col("xy_coverage") - 0.10)
    return rows.drop("_xy", "_up", "_band", "gt_points").withColumn("verdict", F.when((gain > 10.0) & held, "STRONG SUPPORT").when(gain > 5.0, "PARTIAL SUPPORT").otherwise("WEAK / NO SUPPORT"))


def localization(truth: DataFrame, obstacles: DataFrame, components: DataFrame, kept: DataFrame, merged: DataFrame) -> DataFrame:
    """The stage at which each gt's evidence ends. obstacles, components, kept, merged: KEY of the cells that reach each stage."""
    rows = truth
    for name, df in (("_o", obstacles), ("_r", components), ("_k", kept), ("_m", merged)):
        rows = rows.join(df.select(*KEY, F.lit(True).alias(name)), KEY, "left")
    c = rows.groupBy(*GT).agg(
        F.count(F.lit(1)).alias("gt_cells"), F.count("_o").alias("obstacle_cells"), F.coalesce(F.sum(F.when(F.col("_o"), F.col("n"))), F.lit(0)).alias("obstacle_points"),
        F.count("_r").alias("raw_cells"), F.count("_k").alias("filtered_cells"), F.count("_m").alias("merged_cells"),
    )
    verdict = (
        F.when(F.col("obstacle_points") == 0, "NO_OBSTACLE_EVIDENCE").when(F.col("raw_cells") == 0, "OBSTACLE_CELLS_BUT_NO_RAW_COMPONENT")
        .when(F.col("filtered_cells") == 0, "COMPONENT_FILTERED_OUT").when(F.col("merged_cells") == 0, "FILTERED_COMPONENT_LOST_BEFORE_MERGE").otherwise("EVIDENCE_REACHED_COMPONENT_STAGE")
    )
    return c.withColumn("classification", verdict)


def first_shared_stage(pairs: DataFrame, truth: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(frame_id, gt_a, gt_b, stage): the first stage that has cells of both gts in one part. pairs: (frame_id, gt_a, gt_b);
    stages: name and KEY with `part`, in order."""
    seen = None
    for k, (_, df) in enumerate(stages):
        s = truth.join(df.select(*KEY, "part"), KEY).select("frame_id", "gt_id", F.lit(k).alias("k"), "part").distinct()
        seen = s if seen is None else seen.unionAll(s)
    a, b = (seen.withColumnRenamed("gt_id", f"gt_{x}") for x in "ab")
    asked = pairs.select("frame_id", "gt_a", "gt_b").distinct()
    first = asked.join(a, ["frame_id", "gt_a"]).join(b, ["frame_id", "gt_b", "k", "part"]).groupBy("frame_id", "gt_a", "gt_b").agg(F.min("k").alias("_k"))
    name = F.get(F.array(*[F.lit(n) for n, _ in stages]), F.col("_k"))
    return asked.join(first, ["frame_id", "gt_a", "gt_b"], "left").select("frame_id", "gt_a", "gt_b", F.coalesce(name, F.lit("NEVER")).alias("stage"))


def contained(before: DataFrame, after: DataFrame, tile: float = 4.0, slack: float = 1e-6) -> DataFrame:
    """Boxes of `after` (frame_id, id, semantic_id, min_x, ...) that hold two boxes or more of their class of `before`; each box
    goes to the first that holds it, by id. Outer boxes are spread to the tiles they touch, so that boxes meet on equal keys."""
    at = lambda e: F.floor(e / tile)
    c = F.col
    box = ["min_x", "max_x", "min_y", "max_y"]
    outer = after.select("frame_id", "semantic_id", c("id").alias("after_id"), *[c(b).alias(f"_{b}") for b in box])
    outer = outer.select("*", F.explode(F.sequence(at(c("_min_x") - slack), at(c("_max_x") + slack))).alias("_tx"))
    outer = outer.select("*", F.explode(F.sequence(at(c("_min_y") - slack), at(c("_max_y") + slack))).alias("_ty"))
    inner = before.select("frame_id", "semantic_id", c("id").alias("before_id"), *box, at(c("min_x")).alias("_tx"), at(c("min_y")).alias("_ty"))
    hit = inner.join(outer, ["frame_id", "semantic_id", "_tx", "_ty"])
    for x in "xy":
        hit = hit.where((c(f"min_{x}") >= c(f"_min_{x}") - slack) & (c(f"max_{x}") <= c(f"_max_{x}") + slack))
    owner = hit.groupBy("frame_id", "semantic_id", "before_id").agg(F.min("after_id").alias("after_id"))
    return owner.groupBy("frame_id", "semantic_id", "after_id").agg(F.count(F.lit(1)).alias("parts"), F.array_join(F.sort_array(F.collect_list("before_id")), ",").alias("part_ids")).where("parts > 1")
