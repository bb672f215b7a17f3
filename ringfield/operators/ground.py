"""A ground plane for each frame, from planes through points drawn by hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: points this near the plane, in metres, are ground.
NEAR = 0.08
PRIME, STEP = 2147483647, 48271


def _distance(p: Column) -> Column:
    return F.abs(p["a"] * F.col("x") + p["b"] * F.col("y") + p["c"] * F.col("z") + p["d"])


def planes(points: DataFrame, tries: int = 64, first: int = 0) -> DataFrame:
    """(frame_id, h, a, b, c, d): planes of unit normal, pointing up, through three points of each frame, `tries` at
    most, numbered from `first` on. Points are drawn by a hash of their id, so that runs agree, and by another hash for
    another `first`; three points in a line give none."""
    step = pow(STEP, 1 + first // tries, PRIME)
    w = Window.partitionBy("frame_id").orderBy((F.col("point_id") % PRIME) * step % PRIME, "point_id", "x", "y", "z")
    drawn = points.select("frame_id", "point_id", "x", "y", "z").withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") < 3 * tries)
    at = lambda c, k: F.max(F.when(F.col("_k") % 3 == k, F.col(c))).alias(f"{c}{k}")
    t = drawn.groupBy("frame_id", (F.floor(F.col("_k") / 3) + first).cast("int").alias("h")).agg(*[at(c, k) for c in "xyz" for k in range(3)])
    u, v = ([F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz"] for k in (1, 2))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    t = t.select("frame_id", "h", "x0", "y0", "z0", *[e.alias(f"n{i}") for i, e in enumerate(n)])
    size = F.sqrt(F.col("n0") * F.col("n0") + F.col("n1") * F.col("n1") + F.col("n2") * F.col("n2"))
    t = t.withColumn("s", F.when(F.col("n2") < 0, -size).otherwise(size)).where(F.abs("s") > 1e-9)
    t = t.select("frame_id", "h", "x0", "y0", "z0", *[(F.col(f"n{i}") / F.col("s")).alias(c) for i, c in enumerate("abc")])
    return t.select("frame_id", "h", "a", "b", "c", (-(F.col("a") * F.col("x0") + F.col("b") * F.col("y0") + F.col("c") * F.col("z0"))).alias("d"))


def ransac_ground(points: DataFrame, tries: int = 64, first: int = 0) -> DataFrame:
    """(frame_id, a, b, c, d, inliers, points): the plane with most points near it, the first on ties. Frames without a plane
    (fewer than three points, or all drawn ones in lines) give no row. All planes of a frame are counted in one pass over
    its points, as one sum each, so that no point is repeated."""
    some = planes(points, tries, first).groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("h", "a", "b", "c", "d"))).alias("_p"))
    hits = points.select("frame_id", "x", "y", "z").join(some, "frame_id").groupBy("frame_id").agg(
        F.first("_p").alias("_p"), F.count(F.lit(1)).alias("points"),
        F.array(*[F.count_if((F.size("_p") > k) & (_distance(F.get("_p", F.lit(k))) <= NEAR)) for k in range(tries)]).alias("_n"),
    )
    best = F.array_position("_n", F.array_max("_n")).cast("int") - 1
    return hits.select("frame_id", F.get("_p", best).alias("_b"), F.array_max("_n").alias("inliers"), "points").select("frame_id", *[F.col(f"_b.{c}").alias(c) for c in "abcd"], "inliers", "points")


def with_ground(points: DataFrame, ground: DataFrame) -> DataFrame:
    """points with is_ground by the plane of their frame; without a plane none is ground."""
    rows = points.drop("is_ground").join(ground.select("frame_id", F.struct("a", "b", "c", "d").alias("_g")), "frame_id", "left")
    return rows.withColumn("is_ground", F.coalesce(_distance(F.col("_g")) <= NEAR, F.lit(False))).drop("_g")


def confident_ground(points: DataFrame, confidence: float = 0.9999, tries: int = 64, most: int = 1024) -> DataFrame:
    """As ransac_ground(), with as many planes as it takes to have met, with this confidence, three inliers of the best
    plane at once: log(1 - confidence) / log(1 - w^3) for a share w of inliers. Only frames that lack some are tried
    again, up to `most` planes."""
    from ringfield.operators.graph import cut

    best = cut(ransac_ground(points, tries))
    done = tries
    while done < most:
        w = F.least(F.col("inliers") / F.col("points"), F.lit(0.999999))
        lacking = best.where(math.log(1 - confidence) / F.log(1 - w * w * w) > done).select("frame_id")
        if lacking.isEmpty():
            break
        more = ransac_ground(points.join(lacking, "frame_id", "left_semi"), tries, done)
        pick = F.max_by(F.struct(*best.columns), F.struct("inliers", (-F.col("_k")).alias("k")))  # the first on ties
        best = cut(best.withColumn("_k", F.lit(0)).unionByName(more.withColumn("_k", F.lit(1))).groupBy("frame_id").agg(pick.alias("b")).select("b.*"))
        done += tries
    return best


def refitted(points: DataFrame, ground: DataFrame) -> DataFrame:
    """ground (frame_id, a, b, c, d) with the plane that fits its inliers best along the axis across which they are
    flattest: from the sums of their coordinates and products, one aggregation. Normals point up and have length 1;
    inliers on a line keep their plane."""
    near = points.select("frame_id", "x", "y", "z").join(ground.select("frame_id", "a", "b", "c", "d"), "frame_id")
    near = near.where(F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")) <= NEAR)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    from ringfield.operators.graph import cut

    m = near.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"], *[F.sum(F.col(p) * F.col(q)).alias(f"s{p}{q}") for p, q in pairs])
    m = cut(m)  # a row a frame, as below: the algebra in one piece would outgrow generated code
    m = m.select("frame_id", *[(F.col(f"s{c}") / F.col("n")).alias(f"m{c}") for c in "xyz"], *[(F.col(f"s{p}{q}") - F.col(f"s{p}") * F.col(f"s{q}") / F.col("n")).alias(p + q) for p, q in pairs])
    m = cut(m)
    xx, xy, xz, yy, yz, zz = (F.col(p + q) for p, q in pairs)
    dets = {"x": yy * zz - yz * yz, "y": xx * zz - xz * xz, "z": xx * yy - xy * xy}
    m = m.withColumns({f"_{c}": e for c, e in dets.items()})
    dx, dy, dz = (F.col(f"_{c}") for c in "xyz")
    p, q, s = xz * yz - xy * zz, xy * yz - xz * yy, xy * xz - yz * xx
    normal = F.when((dz >= dx) & (dz >= dy), F.array(q, s, dz)).when(dy >= dx, F.array(p, dy, s)).otherwise(F.array(dx, p, q))
    m = cut(m.withColumn("_n", normal))
    u, v, w = (F.get("_n", F.lit(i)) for i in range(3))
    size = F.sqrt(u * u + v * v + w * w)
    m = m.withColumn("_s", F.when(w < 0, -size).otherwise(size)).where(F.abs("_s") > 1e-12)
    m = m.select("frame_id", "mx", "my", "mz", *[(e / F.col("_s")).alias(c) for e, c in ((u, "_a"), (v, "_b"), (w, "_c"))])
    m = m.select("frame_id", "_a", "_b", "_c", (-(F.col("_a") * F.col("mx") + F.col("_b") * F.col("my") + F.col("_c") * F.col("mz"))).alias("_d"))
    return ground.join(m, "frame_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in "abcd"}).drop("_a", "_b", "_c", "_d")
