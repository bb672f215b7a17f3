"""Frame documents from anywhere, brought to one form.

A document is parsed once, into a variant, so that fields of any kind can be looked at before
they are read: a string where a number belongs is not a number, and an object where an array
belongs is an empty array. Documents that are no JSON, or have no pose, give an error instead of
a frame; strict() turns the first error into a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Arrays of a frame; what a frame may offer, by the field that holds it.
ARRAYS = ("points", "world_points", "tracks", "adaptive_cells", "obstacle_cells", "proposals", "world_objects", "retired_ids")
OFFERS = {
    "has_points": "points", "has_world_points": "world_points", "has_adaptive_grid": "adaptive_cells", "has_tracks": "tracks", "has_objects": "world_objects",
    "has_proposals": "proposals", "has_semantic_labels": "semantic_labels", "has_path_data": "path",
}
NOT_JSON, INVALID, NO_POSE = "not JSON", "invalid JSON", "no valid pose"


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def items(v: Column, path: str) -> Column:
    """The array at path; anything else is an empty one."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def is_array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def number(v: Column, path: str) -> Column:
    """The number at path; null for other kinds, and for numbers that are not finite."""
    return F.when(kind(part(v, path)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), finite(F.try_variant_get(v, path, "double")))


def loose(v: Column, path: str) -> Column:
    """As number(), but texts that spell a number count, and so do null and empty texts, as 0."""
    text = F.trim(F.try_variant_get(v, path, "string"))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.coalesce(number(v, path), F.when(kind(part(v, path)) == "STRING", finite(text.try_cast("double")))))


def placed(cell: Column) -> Column:
    """Whether a cell has a centre and a size above 0."""
    return number(cell, "$.center[0]").isNotNull() & number(cell, "$.center[1]").isNotNull() & F.coalesce(number(cell, "$.resolution") > 0, F.lit(False))


CELL = "struct<center:array<double>,resolution:double>"


def normalized(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with error, or frame_index, ego_x, ego_y, heading_rad, pose_source, the arrays of ARRAYS
    (cells that cannot be placed are left out) and the flags of OFFERS and has_ground_data."""
    trimmed = F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    page = trimmed.startswith("<!") | trimmed.startswith("<html")
    rows = documents.withColumn("_v", F.when(~page, F.try_parse_json(text)))
    v = F.col("_v")
    long_enough = F.size(items(v, "$.pose.ego_xy")) >= 2
    rows = rows.withColumns({"ego_x": F.when(long_enough, loose(v, "$.pose.ego_xy[0]")), "ego_y": F.when(long_enough, loose(v, "$.pose.ego_xy[1]"))})
    posed = F.col("ego_x").isNotNull() & F.col("ego_y").isNotNull()
    error = F.when(F.coalesce(page, F.lit(False)), NOT_JSON).when(v.isNull(), INVALID).when(~posed, NO_POSE)
    named = F.try_variant_get(v, "$.pose.pose_source", "string")
    rows = rows.withColumn("error", error)
    ok = F.col("error").isNull()
    arrays = {a: items(v, f"$.{a}") for a in ARRAYS}
    arrays |= {a: F.filter(arrays[a], placed) for a in ("adaptive_cells", "obstacle_cells")}
    fields = {
        "ego_x": F.col("ego_x"), "ego_y": F.col("ego_y"), "frame_index": F.coalesce(number(v, "$.frame_index"), F.lit(0.0)),
        "heading_rad": F.coalesce(number(v, "$.pose.heading_rad"), F.lit(0.0)), "pose_source": F.when(F.coalesce(named, F.lit("")) == "", "unknown").otherwise(named),
        **arrays, **{name: is_array(v, f"$.{field}") for name, field in OFFERS.items()},
        "has_ground_data": F.coalesce(kind(part(v, "$.ground")).rlike("^(OBJECT|ARRAY)"), F.lit(False)),
    }
    return rows.select(*[c for c in documents.columns if c not in fields and c != "error"], "error", *[F.when(ok, e).alias(n) for n, e in fields.items()])


def strict(frames: DataFrame) -> DataFrame:
    """frames of normalized(); the first error fails the job."""
    fine = F.assert_true(F.col("error").isNull(), F.concat(F.lit("frame document: "), F.coalesce("error", F.lit("")))).isNull()
    return frames.where(fine).drop("error")


def first_readable(candidates: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """Of the candidates of each key, in order, the first whose text is JSON; keys without any have the last one's error."""
    trimmed = F.regexp_replace(text, r"^\s+", "")
    page = F.coalesce(trimmed.startswith("<!") | trimmed.startswith("<html"), F.lit(False))
    error = F.when(F.col(text).isNull(), "missing").when(page, NOT_JSON).when(F.try_parse_json(text).isNull(), INVALID)
    tried = candidates.select(by, order, text, error.alias("error"))
    best = tried.groupBy(by).agg(
        F.min_by(F.struct(order, text), F.when(F.col("error").isNull(), F.col(order))).alias("_b"), F.max_by("error", order).alias("_e"),
    )
    return best.select(by, f"_b.{order}", f"_b.{text}", F.when(F.col("_b").isNull(), F.col("_e")).alias("error"))
