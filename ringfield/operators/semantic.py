"""Semantic labels on points and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.config import COMPATIBLE, MERGE_GAP, MERGE_GAP_DEFAULT, OBJECT_IDS, QUALITY, QUALITY_DEFAULT, SEMANTIC_NAMES
from ringfield.operators.components import bucket_pairs
from ringfield.operators.graph import components_within
from ringfield.operators.grid import KEY, with_cell


def unpack(points: DataFrame) -> DataFrame:
    """label -> semantic_id (low 16 bits) and instance_id (high 16 bits)."""
    return points.withColumn("semantic_id", F.col("label").bitwiseAND(65535)).withColumn("instance_id", F.shiftright("label", 16))


def names(spark: SparkSession) -> DataFrame:
    """The fixed vocabulary as a table."""
    return spark.createDataFrame(list(SEMANTIC_NAMES.items()), "semantic_id bigint, semantic_name string")


def semantic_name(semantic_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEMANTIC_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, semantic_id.cast("int")), F.concat(F.lit("class-"), semantic_id))


def compatible_group(semantic_id: Column) -> Column:
    """Classes that may be parts of one object share a group; any other class is its own."""
    out = None
    for name, ids in COMPATIBLE.items():
        out = F.when(semantic_id.isin(*ids), name) if out is None else out.when(semantic_id.isin(*ids), name)
    return out.otherwise(F.concat(F.lit("class-"), semantic_id))


def semantic_counts(points: DataFrame) -> DataFrame:
    return unpack(with_cell(points)).groupBy(*KEY, "semantic_id").agg(F.count(F.lit(1)).alias("n"), F.first("resolution").alias("resolution"))


def dominant_class(counts: DataFrame) -> DataFrame:
    """Most frequent class of each cell, the smallest id on ties, with its share."""
    return counts.groupBy(*KEY).agg(
        F.max_by("semantic_id", F.struct("n", -F.col("semantic_id"))).alias("semantic_id"),
        (F.max("n") / F.sum("n")).alias("confidence"),
        F.sum("n").alias("points"),
        F.first("resolution").alias("resolution"),
    )


def cell_entropy(counts: DataFrame) -> DataFrame:
    total = counts.groupBy(*KEY).agg(F.sum("n").alias("_t"), F.collect_list("n").alias("_n"))
    p = lambda n: n / F.col("_t")
    return total.select(*KEY, F.aggregate("_n", F.lit(0.0), lambda a, n: a - p(n) * F.log2(p(n))).alias("entropy"))


def semantic_stats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("frame_id").agg(
        F.count_distinct("level", "ix", "iy").alias("cells"), F.sum("n").alias("points"), F.count_distinct("semantic_id").alias("classes")
    )


def label_histogram(points: DataFrame) -> DataFrame:
    """Points and percent of each class in a frame."""
    rows = unpack(points).groupBy("frame_id", "semantic_id").agg(F.count(F.lit(1)).alias("points"))
    total = rows.groupBy("frame_id").agg(F.sum("points").alias("_t"))
    return rows.join(total, "frame_id").select(
        "frame_id", "semantic_id", semantic_name(F.col("semantic_id")).alias("semantic_name"), "points", F.round(F.col("points") * 100.0 / F.col("_t"), 6).alias("percent")
    )


def thing_cells(counts: DataFrame) -> DataFrame:
    """Cells whose dominant class is an object class, with their id, centre and entropy."""
    from ringfield.functions.geometry import cell_id

    d = dominant_class(counts).where(F.col("semantic_id").isin(*OBJECT_IDS)).join(cell_entropy(counts), KEY)
    at = lambda i: (F.col(i) + 0.5) * F.col("resolution")
    return d.select(cell_id().alias("cell_id"), *KEY, "resolution", "semantic_id", "confidence", "points", "entropy", at("ix").alias("center_x"), at("iy").alias("center_y"))


def semantic_links(cells: DataFrame) -> DataFrame:
    """(frame_id, a, b): cells of compatible classes not farther than 1.75 cells on either axis."""
    rows = cells.select("frame_id", compatible_group(F.col("semantic_id")).alias("grp"), F.col("cell_id").alias("id"), "center_x", "center_y", "resolution")
    pairs = bucket_pairs(rows, ["frame_id", "grp"], "center_x", "center_y", 0.9)
    limit = F.greatest("a_resolution", "b_resolution") * 1.75 + 0.02
    near = lambda c: F.abs(F.col(f"a_center_{c}") - F.col(f"b_center_{c}")) <= limit
    return pairs.where(near("x") & near("y")).select("frame_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def hypotheses(cells: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Linked cells as objects: class by points (smallest id on ties), confidence, entropy, box.
    Those with under 2 cells and under 8 points are dropped."""
    links = semantic_links(cells) if links is None else links
    found = components_within("frame_id", cells.select("frame_id", F.col("cell_id").alias("id")), links).drop("frame_id")
    rows = cells.join(found.select(F.col("id").alias("cell_id"), F.col("component").alias("hypothesis_id")), "cell_id")
    by_class = rows.groupBy("frame_id", "hypothesis_id", "semantic_id").agg(F.sum("points").alias("_p"))
    top = by_class.groupBy("frame_id", "hypothesis_id").agg(
        F.max_by("semantic_id", F.struct("_p", -F.col("semantic_id"))).alias("semantic_id"), (F.max("_p") / F.sum("_p")).alias("_share")
    )
    w, half = F.col("points").cast("double"), F.col("resolution") / 2
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    box = rows.groupBy("frame_id", "hypothesis_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("points").alias("points"), mean("center_x").alias("center_x"), mean("center_y").alias("center_y"),
        mean("confidence").alias("_confidence"), mean("entropy").alias("entropy"),
        F.min(F.col("center_x") - half).alias("min_x"), F.max(F.col("center_x") + half).alias("max_x"),
        F.min(F.col("center_y") - half).alias("min_y"), F.max(F.col("center_y") + half).alias("max_y"),
    )
    out = box.join(top, ["frame_id", "hypothesis_id"]).where((F.col("cells") >= 2) | (F.col("points") >= 8))
    return out.withColumn("confidence", 0.65 * F.col("_share") + 0.35 * F.col("_confidence")).drop("_share", "_confidence")


def with_rules(found: DataFrame, names: tuple[str, ...], values: dict[int, tuple], default: tuple) -> DataFrame:
    """found with the values of its class as columns; a table of a few rows, so broadcast."""
    rows = [(k, *v) for k, v in values.items()]
    rules = found.sparkSession.createDataFrame(rows, ", ".join(["semantic_id bigint", *[f"{n} double" for n in names]]))
    out = found.join(F.broadcast(rules), "semantic_id", "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(float(d))) for n, d in zip(names, default, strict=True)})


def quality_filter(found: DataFrame) -> DataFrame:
    """Hypotheses with enough points, cells and extent for their class."""
    limits = ("_points", "_cells", "_extent")
    values = {k: tuple(float(x) for x in v) for k, v in QUALITY.items()}
    rows = with_rules(found, limits, values, QUALITY_DEFAULT)
    wide = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return rows.where((F.col("points") >= F.col("_points")) & (F.col("cells") >= F.col("_cells")) & (wide >= F.col("_extent"))).select(*found.columns)


TILE = 4.0


def near_boxes(grown: DataFrame, boxes: DataFrame) -> DataFrame:
    """(frame_id, a, b), a < b: boxes of one class at most the class's `gap` apart, of which one is in `grown`.
    Boxes reach out by half the gap and are spread to the tiles that they touch; a pair is told in the tile of the
    lower corner that the two have in common, so no pair is told twice."""
    at = lambda e: F.floor(e / TILE)

    def spread(df: DataFrame, p: str) -> DataFrame:
        half = F.col("gap") / 2
        out = df.select("frame_id", "semantic_id", "gap", *[F.col(c).alias(f"{p}_{c}") for c in ("hypothesis_id", "min_x", "max_x", "min_y", "max_y")], *[(F.col(f"min_{c}") - half).alias(f"{p}_{c}0") for c in "xy"], *[(F.col(f"max_{c}") + half).alias(f"{p}_{c}1") for c in "xy"])
        for c in "xy":
            out = out.withColumn(f"_t{c}", F.explode(F.sequence(at(F.col(f"{p}_{c}0")), at(F.col(f"{p}_{c}1")))))
        return out

    both = spread(grown, "a").join(spread(boxes, "b").drop("gap"), ["frame_id", "semantic_id", "_tx", "_ty"]).where(F.col("a_hypothesis_id") != F.col("b_hypothesis_id"))
    for c in "xy":
        both = both.where(F.col(f"_t{c}") == at(F.greatest(f"a_{c}0", f"b_{c}0")))
    gap = lambda c: F.greatest(F.col(f"b_min_{c}") - F.col(f"a_max_{c}"), F.col(f"a_min_{c}") - F.col(f"b_max_{c}"), F.lit(0.0))
    near = both.where(F.hypot(gap("x"), gap("y")) <= F.col("gap"))
    return near.select("frame_id", F.least("a_hypothesis_id", "b_hypothesis_id").alias("a"), F.greatest("a_hypothesis_id", "b_hypothesis_id").alias("b")).distinct()


def merged_fragments(found: DataFrame) -> DataFrame:
    """Hypotheses of one class whose boxes are at most the class's gap apart become one, until none are.
    Boxes only grow, so every order ends in the same groups; each round looks only for neighbours of boxes that
    grew in the last one. Centre, confidence and entropy are means by points."""
    from ringfield.operators.graph import cut

    means = ["center_x", "center_y", "confidence", "entropy"]
    keep = ["frame_id", "semantic_id", "hypothesis_id", "min_x", "max_x", "min_y", "max_y", "cells", "points", *means]
    rows = cut(with_rules(found.select(*keep), ("gap",), {k: (v,) for k, v in MERGE_GAP.items()}, (MERGE_GAP_DEFAULT,)))
    grown = rows
    while True:
        links = cut(near_boxes(grown, rows))
        if links.isEmpty():
            return rows.select(*keep)
        linked = links.select("frame_id", F.col("a").alias("id")).unionByName(links.select("frame_id", F.col("b").alias("id"))).distinct()
        named = cut(components_within("frame_id", linked, links).select(F.col("id").alias("hypothesis_id"), "component"))
        new = (
            rows.join(named, "hypothesis_id")
            .groupBy("frame_id", "semantic_id", F.col("component").alias("hypothesis_id"))
            .agg(
                *[F.min(c).alias(c) for c in ("min_x", "min_y")], *[F.max(c).alias(c) for c in ("max_x", "max_y")], F.first("gap").alias("gap"),
                *[(F.sum(F.col(c) * F.col("points")) / F.sum("points")).alias(c) for c in means], F.sum("cells").alias("cells"), F.sum("points").alias("points"),
            )
        )
        grown = cut(new.select(*keep, "gap"))
        rows = cut(rows.select(*keep, "gap").join(named, "hypothesis_id", "left_anti").unionByName(grown))


def semantic_objects(cells: DataFrame) -> DataFrame:
    """Hypotheses that pass the quality rules, merged, and judged again."""
    from ringfield.operators.graph import cut

    return quality_filter(merged_fragments(quality_filter(hypotheses(cut(cells)))))
