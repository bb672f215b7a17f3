"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source_size copies. Inside a source the expected
copies are prefix-summed, one random offset is added, and a document is emitted once for each
integer boundary that its step crosses. Documents run in order of size class, so that the
sample is stratified by size and the words taken come near the target.

Defined results: null texts have size 0; a null source is a source of its own, the last one;
repeated rows are sampled one by one, in the order of a hash of id and text, so rows alike in both
are interchangeable; sources without words get target 0; an empty table gives an empty result;
other columns pass through whatever their names, those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringfield.llm.common import before_sum, cut, fine_buckets, word_count

ADDED = ("size", "source_size", "target", "copies", "taken")


def _key(source: str) -> Column:
    """Sorts as the sources by code point, null last."""
    return F.when(F.col(source).isNull(), "Z").otherwise(F.concat(F.lit("A"), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(_key, source_size) -> also target. Sources in key order weigh `weights`, repeating;
    the target of a source stops at most * source_size and the excess goes to the others by
    weight. Sorted by cap / weight, the capped sources come first, so the level follows from
    running sums: no iteration."""
    every = Window.partitionBy()
    rank = Window.orderBy("_key")
    upto = Window.orderBy("_ratio", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    df = (
        sizes.withColumn("_weight", weight)
        .withColumn("_ratio", most * F.col("source_size") / F.col("_weight"))
        .withColumn("_all", share * F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("_weight").over(every))
        .withColumn("_caps", F.sum(most * F.col("source_size")).over(upto) - most * F.col("source_size"))
        .withColumn("_used", F.sum("_weight").over(upto) - F.col("_weight"))
        .withColumn("_level", (F.col("_all") - F.col("_caps")) / (F.col("_weights") - F.col("_used")))
        # the first source that the level does not fill fixes the level of all after it
        .withColumn("_fixed", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_key", "_level"))).over(every))
    )
    target = F.least(F.col("_weight") * F.coalesce(F.col("_fixed._level"), F.col("_ratio")), most * F.col("source_size"))
    return df.select("_key", "source_size", target.cast("double").alias("target"))


def mixed(docs: DataFrame, size: Column | None = None, seed: int = 17, source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with ADDED; `copies` says how often the mix takes the row."""
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ADDED]).alias("_row"), size.alias("size"), _key(source).alias("_key"), _name(doc_id).alias("_name"))
    return _sampled(rows, seed, weights, share, most).select("_row.*", *ADDED)


def _name(doc_id: str, text: str = "text") -> Column:
    """A row's place in any order that the sample takes: of its id and text."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))


def _sampled(rows: DataFrame, seed: int, weights, share, most) -> DataFrame:
    """rows with size, _key and _name -> also ADDED."""
    totals = cut(rows.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")))
    n = totals.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    with_target = targets(totals.drop("_n"), weights, share, most)
    rows = (
        rows.withColumn("_class", F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"))
        .withColumn("_sub", F.pmod(F.xxhash64(F.lit(seed), "_name"), F.lit(fine_buckets(n))).cast("int"))
        .withColumn("_h", F.xxhash64(F.lit(seed + 1), "_name"))
        .withColumn("_one", F.lit(1))
    )
    ranked = before_sum(rows, ["_key"], ["_class", "_sub"], ["_h"], "_one", "_rank")
    # sources are dimension-like and few; Spark broadcasts this side only below its size threshold
    ranked = ranked.join(with_target, "_key")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_key")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor((F.col("_rank") + 1) * step + offset) - F.floor(F.col("_rank") * step + offset)
    copies = F.least(copies, F.floor(F.lit(most)))
    return (
        ranked.withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_key", "_name", "_class", "_sub", "_h", "_one", "_rank")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    small = cut(docs.select("doc_id", word_count(F.col("text")).alias("size"), _key("source").alias("_key"), _name("doc_id").alias("_name")))
    return _sampled(small, 17, (3, 1, 2), 1.5, 2.0).select("doc_id", "size", "source_size", "target", "taken")
