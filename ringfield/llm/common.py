"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ringfield-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed Parquet table: for wide rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/ringfield-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def compact(df: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """As cut(), in as few partitions as its counted rows need: later shuffles of a small table write few files."""
    done = cut(df)
    return done.coalesce(done.count() // rows + 1)


def released(spark: SparkSession) -> None:
    """Shuffle files go when the driver's collector finds that no plan refers to them. A loop whose
    rounds exchange much asks it to look now, lest the files of all rounds lie on the executors."""
    spark.sparkContext._jvm.java.lang.System.gc()


def bucketed(df: DataFrame, key: str, least: int, name: str | None = None) -> DataFrame:
    """df as a table of the shared warehouse, bucketed by key: grouping it by key again and
    again, alone or with other rows, shuffles only the other rows. For rows that are few and
    large: each is written where it is, so that this costs no shuffle either."""
    spark, name = df.sparkSession, name or f"ringfield_{uuid.uuid4().hex}"
    n = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def small(df: DataFrame, rows: int = 1 << 19) -> DataFrame:
    """df marked for broadcast if it has at most `rows` (narrow) rows, as counted; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def before_sum(df: DataFrame, keys: Sequence[str], bucket: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that come earlier in (bucket, order).

    Two levels, so that no task gets all rows of a key: sums by (keys, bucket), a running
    total over those few sums, and a window inside each bucket. bucket columns must be
    fine enough to split a hot key, and none of the columns may be null.
    """
    group = [*keys, *bucket]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        df.groupBy(*group)
        .agg(F.sum(value).alias("_s"))
        .withColumn("_base", F.coalesce(F.sum("_s").over(over), F.lit(0)))
        .drop("_s")
    )
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(base, group)
        .withColumn(out, (F.col("_base") + F.col("_in")).cast("long"))
        .drop("_base", "_in")
    )


def fine_buckets(rows: int, per: int = 1 << 22, least: int = 64) -> int:
    """Buckets for before_sum: at least 64, and no more than `per` rows of a key in each."""
    return max(least, -(-rows // per))
