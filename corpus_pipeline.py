"""documents -> packed training sequences, in stages that each call one operator.

Each stage works on all rows that the one before it kept: quality rules drop what they reject,
line dedup drops boilerplate lines, near-dedup keeps one document of each group, mixing repeats
or drops rows so that sources meet their targets, and packing lays the rest into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.llm import linededup, mixing, neardup, packing, quality
from ringfield.llm.common import cut, released, small, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # hashing, EM and tokenizers are not SQL; tests/llm hold the operators to brute force or properties, and the stages to row counts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.deduped(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id are named by their text, after all ids, and are one row for each distinct text with words. Rows
    that share id and text are one row too."""
    unnamed = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = [c for c in COLUMNS if c != "text"]
    once = docs.where(unnamed).groupBy("text").agg(F.min(F.struct(*rest)).alias("_r")).select("text", "_r.*").select(*COLUMNS)
    key = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    # read anew from docs each time: a key is a pure function of its row, and a written copy would be one more of all texts
    rows = docs.where(~unnamed).select(*COLUMNS).unionAll(once).withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), key))
    verdicts = neardup.grouped(rows.select(F.col("_key").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("_key")).agg(F.max("kept").alias("kept"))
    gone = cut(verdicts.where("NOT kept").select("_key"))
    many = cut(rows.groupBy("_key").count().where("count > 1").select("_key"))  # ids only, no texts
    released(spark)
    kept = rows.join(small(gone), "_key", "left_anti")
    if many.isEmpty():
        return kept.select(*COLUMNS)
    twice = kept.join(small(many), "_key", "left_semi").groupBy("_key", "text").agg(F.min(F.struct(*rest)).alias("_r")).select("text", "_r.*")
    return kept.join(small(many), "_key", "left_anti").select(*COLUMNS).unionByName(twice.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is two rows."""
    taken = mixing.mixed(docs).where("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, packing.word_bpe())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
