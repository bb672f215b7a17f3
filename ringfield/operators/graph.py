"""Connected components of a link table."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints (one of our own only where none is set)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") and not named:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ringfield-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the folder that the cluster names for checkpoints."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Has the driver's collector look for shuffle files and checkpoints that no plan refers to any more."""
    spark.sparkContext._jvm.java.lang.System.gc()


def components(nodes: DataFrame | None, links: DataFrame) -> DataFrame:
    """nodes (id), links (a, b) -> (id, component): the smallest id reachable. Without nodes, only
    linked ids other than the smallest of their component are returned.

    Large-star and small-star rounds, so their number grows with the logarithm of the longest
    path; an edge is a row, and no node's neighbours are gathered in one place."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = edges.count() // (1 << 17) + 1  # edges never grow in number; a small table keeps to few files
    edges = edges.coalesce(parts)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = cut(near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(near.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    if nodes is None:
        return found
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def components_within(by: str, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """As components(), for links that never leave a group of bounded size, such as the cells of
    one scan: each group's links are joined in one task, without rounds. nodes (by, id), links (by, a, b)."""
    # fresh names for the columns: links are usually made from the nodes
    nodes, links = nodes.select(F.col(by).alias("_g"), F.col("id").alias("id")), links.select(F.col(by).alias("_g"), F.col("a").alias("a"), F.col("b").alias("b"))
    found = nodes.groupBy("_g").cogroup(links.groupBy("_g")).applyInPandas(_joined, "_by bigint, id bigint, component bigint")
    return found.withColumnRenamed("_by", by)


def _joined(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    ids = np.unique(nodes["id"].to_numpy(np.int64)) if len(nodes) else np.zeros(0, np.int64)
    root = np.arange(len(ids))
    if len(links):
        a, b = (np.searchsorted(ids, links[c].to_numpy(np.int64)) for c in "ab")
        while (root[a] != root[b]).any():
            x, y = root[a], root[b]
            low = np.minimum(x, y)  # the smaller id stays on top
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root = root[root]
    return pd.DataFrame({"_by": np.full(len(ids), key[0]), "id": ids, "component": ids[root]})
