"""Point clouds, labels and poses that are computed from the given tables, in expressions that
Spark and any SQL engine read alike: coordinates are multiples of powers of two, so that sums of
them do not depend on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVE = 8192  # order keys of a drive
STRIDE = 8  # frame ids of a drive: seven frames and a gap, so that no frame follows the last one of another drive

_D = "CAST({} AS DOUBLE)".format
KINDS = 24  # what an order's points are goes by its key modulo this


def _objects() -> list[dict]:
    """What stands where, one row for each kind of order. Points that are `on` (every `every`-th part, up to line `lines`) lie at
    x0 + dx * line + xp * (part % xpm) + xs * (supplier % xsm), y0 + ys * (supplier * ysk % ysm) + yp * (part % ypm) + gap for
    suppliers in the upper half of eight, z0 + zq * (quantity % zqm), and with `flat` as the ground does. Suppliers whose
    key modulo `split` is less than `part` have the label `low`, the others `high`; -1 is the ground's own. All other points are ground."""
    none = {"every": 1, "lines": 0, "x0": 0, "dx": 0, "xp": 0, "xpm": 1, "xs": 0, "xsm": 1, "y0": 0, "ys": 0, "ysk": 1, "ysm": 1, "yp": 0, "ypm": 1, "gap": 0, "z0": 0, "zq": 0, "zqm": 1, "flat": 0, "split": 1, "part": 0, "low": 0, "high": -1}
    tall = {"z0": 1 / 4, "zq": 1 / 16, "zqm": 32, "lines": 99}
    label = lambda instance, semantic: instance * 65536 + semantic
    place = lambda k: {"x0": (k * 17 % 41 - 20) * 2, "dx": 1 / 4, "xp": 1 / 4, "xpm": 8, "y0": (k * 29 % 37 - 18) * 2, "ys": 1 / 4, "ysm": 8}
    rows = [{**none, **tall, **place(k), "high": label(k + 1, s)} for k, s in enumerate((10, 30, 50, 71, 80, 81, 10, 30, 252, 18, 99, 52))]
    rows[4] |= {"split": 16, "part": 1, "low": label(105, 31)}  # a sixteenth of it is another instance
    rows[6] |= {"split": 8, "part": 4, "low": label(7, 10), "high": label(107, 10)}  # two instances side by side
    rows[7] |= {"lines": 4}  # gone after the fourth frame
    rows[9] |= {"gap": 3 / 4}  # two parts that lie apart
    third = {"every": 3, "lines": 99}
    rows += [
        {**none, **third, "x0": -35, "xs": 1 / 16, "xsm": 8, "y0": 30, "yp": 1 / 16, "ypm": 8, "z0": 13 / 128, "zq": 1 / 256, "zqm": 4, "high": label(13, 10)},  # too low
        {**none, **third, "x0": 25, "xp": 1 / 8, "xpm": 97, "y0": -35, "ys": 1 / 8, "ysk": 7, "ysm": 89, "z0": 1, "high": label(14, 30)},  # too sparse
        {**none, **tall, **third, "x0": 80, "xp": 1 / 4, "xpm": 8, "y0": 40, "ys": 1 / 4, "ysm": 8, "high": label(15, 18)},  # no ground near
        {**none, **tall, **third, "x0": -45 - 1 / 8, "y0": -20 - 1 / 8, "high": label(16, 11)},  # a single cell
        {**none, **third, "x0": 10, "xs": 1 / 8, "xsm": 8, "y0": -8, "yp": 1 / 8, "ypm": 8, "flat": 1, "high": label(17, 15)},  # lies flat on the ground
        {**none, **tall, "x0": -30, "xp": 1 / 4, "xpm": 21, "y0": -38, "ys": 1 / 8, "ysm": 2, "high": label(18, 50)},  # a wall
        {**none, **place(0), "every": 3, "lines": 99, "flat": 1},  # ground below the first two objects
        {**none, **place(1), "every": 11, "lines": 99, "flat": 1},
    ]
    rows += [none] * (KINDS - len(rows))
    return [{"kind": k, **r} for k, r in enumerate(rows)]


OBJECTS = _objects()
_WHOLE = ("kind", "every", "lines", "xpm", "xsm", "ysk", "ysm", "ypm", "zqm", "split", "part", "low", "high")
OBJECT_SCHEMA = ", ".join(f"{c} {'bigint' if c in _WHOLE else 'double'}" for c in OBJECTS[0])
OBJECTS_SQL = (
    f"SELECT {', '.join(f'CAST({c} AS {"BIGINT" if c in _WHOLE else "DOUBLE"}) AS {c}' for c in OBJECTS[0])} FROM (VALUES "
    + ", ".join(f"({', '.join(str(v) for v in r.values())})" for r in OBJECTS)
    + f") t({', '.join(OBJECTS[0])})"
)
_ON = "(l_partkey % every = 0 AND l_linenumber <= lines)"
_FLAT = f"{_D('(l_orderkey + l_partkey) % 9 - 4')} / {_D(256)}"
POINT = {
    "frame_id": f"CAST(floor({_D('l_orderkey')} / {_D(DRIVE)}) * {STRIDE} + l_linenumber - 1 AS BIGINT)",
    # lines of an order may share their number; order, part and price tell them apart inside a frame
    "point_id": "CAST((l_orderkey % 268435456) * 4294967296 + (CAST(round(l_extendedprice * 100) AS BIGINT) % 16777216) * 256 + l_partkey % 256 AS BIGINT)",
    "x": f"CASE WHEN {_ON} THEN x0 + dx * l_linenumber + xp * (l_partkey % xpm) + xs * (l_suppkey % xsm) ELSE {_D('(l_partkey * 37 + l_orderkey) % 2561 - 1280')} / {_D(32)} END",
    "y": f"CASE WHEN {_ON} THEN y0 + ys * (l_suppkey * ysk % ysm) + yp * (l_partkey % ypm) + CASE WHEN l_suppkey % 8 >= 4 THEN gap ELSE {_D(0)} END ELSE {_D('(l_orderkey * 53 + l_partkey) % 2561 - 1280')} / {_D(32)} END",
    "z": f"CASE WHEN {_ON} THEN z0 + zq * (CAST(l_quantity AS BIGINT) % zqm) + flat * ({_FLAT}) ELSE {_FLAT} END",
    # low 16 bits: semantic id; high 16 bits: instance, 0 on the ground
    "label": f"CAST(CASE WHEN {_ON} AND l_suppkey % split < part THEN low WHEN {_ON} AND high >= 0 THEN high WHEN (l_orderkey + l_partkey) % 7 < 5 THEN 40 ELSE 72 END AS BIGINT)",
}
GROUND = f"abs(z) <= {_D('0.08')}"

POINTS_SQL = f"SELECT *, {GROUND} AS is_ground FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in POINT.items())} FROM lineitem JOIN ({OBJECTS_SQL}) ON kind = l_orderkey % {KINDS})"

# A turn of 0.05 rad and a step of (1.25, 0.5) a frame, from the origin in each drive.
_N = _D(f"frame_id % {STRIDE}")
POSE = {
    "yaw": f"{_N} * {_D('0.05')}", "t0": f"{_N} * {_D('1.25')}", "t1": f"{_N} * {_D('0.5')}", "t2": _D("0"),
}
POSES_SQL = (
    f"SELECT frame_id, cos(yaw) AS r00, -sin(yaw) AS r01, {_D(0)} AS r02, sin(yaw) AS r10, cos(yaw) AS r11, {_D(0)} AS r12,"
    f" {_D(0)} AS r20, {_D(0)} AS r21, {_D(1)} AS r22, t0, t1, t2 FROM (SELECT frame_id, {', '.join(f'{e} AS {n}' for n, e in POSE.items())}"
    f" FROM (SELECT DISTINCT {POINT['frame_id']} AS frame_id FROM lineitem))"
)


def points(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Points of all lines, or of those of slices()."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet") if lines is None else lines
    kinds = spark.createDataFrame([tuple((int if c in _WHOLE else float)(v) for c, v in r.items()) for r in OBJECTS], OBJECT_SCHEMA)  # 24 rows
    rows = rows.join(F.broadcast(kinds), F.col("kind") == F.col("l_orderkey") % KINDS)
    return rows.select(*[F.expr(e).alias(n) for n, e in POINT.items()]).withColumn("is_ground", F.expr(GROUND))


def poses(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    frames = (spark.read.parquet(f"{sf_dir}/lineitem.parquet") if lines is None else lines).select(F.expr(POINT["frame_id"]).alias("frame_id")).distinct()
    yaw = F.expr(POSE["yaw"])
    zero, one = F.lit(0.0), F.lit(1.0)
    return frames.select(
        "frame_id",
        F.cos(yaw).alias("r00"), (-F.sin(yaw)).alias("r01"), zero.alias("r02"),
        F.sin(yaw).alias("r10"), F.cos(yaw).alias("r11"), zero.alias("r12"),
        zero.alias("r20"), zero.alias("r21"), one.alias("r22"),
        *[F.expr(POSE[t]).alias(t) for t in ("t0", "t1", "t2")],
    )


def sequence_id() -> Column:
    """The drive of a frame."""
    return F.floor(F.col("frame_id") / STRIDE).cast("bigint")


def slices(spark: SparkSession, sf_dir: str, rows: int) -> list[DataFrame]:
    """The lines in slices of whole drives, of about `rows` lines each. The range of a slice's order keys is told apart from
    its drives, so that Parquet skips what lies outside; lines may lie in any order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    drive = F.floor(F.expr(POINT["frame_id"]) / STRIDE)
    n = -(-lines.count() // rows)
    if n <= 1:
        return [lines]
    ends = sorted(set(lines.agg(F.percentile_approx(drive, [i / n for i in range(1, n)], 100 * n)).first()[0] or []))
    place = F.aggregate(F.array(*[(drive > e).cast("int") for e in ends]), F.lit(0), lambda a, b: a + b)
    found = lines.where(drive.isNotNull()).groupBy(place.alias("k")).agg(*[f("l_orderkey").alias(f.__name__) for f in (F.min, F.max)]).orderBy("k").collect()
    low, high = [None, *ends], [*ends, None]
    inside = lambda k: (F.lit(True) if low[k] is None else drive > low[k]) & (F.lit(True) if high[k] is None else drive <= high[k])
    return [lines.where(F.col("l_orderkey").between(r["min"], r["max"]) & inside(r["k"])) for r in found]
