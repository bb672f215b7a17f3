"""Approximate nearest neighbours with hash-prefix forests.

A tree is a sorted array of long hash strings, 32 bits each, one bit per random hyperplane
through the centre of its rows. A query descends in each tree to its longest prefix match; then
all trees ascend together, one bit at a time, and each step adds the rows that share the shorter
prefix, until `share` of a block's rows are candidates. Candidates are ranked by their exact
distance. Ties and copies of a vector share all their prefixes, so they come together.

Rows are dealt into blocks by a hash of their id and queries into groups; each (block, group)
has a forest of its own, so no task holds more than `block` rows and `group` queries, and the
ten best of each block meet in one aggregate. A block answers for its own rows: the true
neighbours stand out more in it than in the whole, so that recall does not fall as rows grow.

Defined results: vectors that are null, zero, of another length than most rows' or that hold
null or non-finite components take no part; repeated rows (one id twice) are separate
candidates, and rows with the query's own id are none; repeated query rows with one id and vector are
one query, those with one id and several vectors are several queries that are ranked apart; with
fewer rows than asked for, all candidates are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringfield.llm.common import cut

BITS = 32
FOUND = "query_id bigint, query bigint, vec_id bigint, score double"


def forest(x: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The centre, each tree's sorted strings and the rows in that order, and the hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1], BITS))
    centre = x.mean(axis=0)
    strings, rows = [], []
    for t in range(trees):
        h = hashed(x - centre, planes[t])
        order = np.argsort(h, kind="stable")
        strings.append(h[order])
        rows.append(order)
    return centre, strings, rows, planes


def hashed(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    bits = (x @ planes > 0).astype(np.uint64)
    return bits @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))


def candidates(q: np.ndarray, built: tuple, wanted: int) -> list[np.ndarray]:
    """For each query the rows found by descending and then ascending in all trees together."""
    centre, strings, rows, planes = built
    n, m = len(rows[0]), len(q)
    lo, hi = np.empty((BITS + 1, len(strings), m), np.int32), np.empty((BITS + 1, len(strings), m), np.int32)
    for t, s in enumerate(strings):
        h = hashed(q - centre, planes[t])
        for depth in range(BITS + 1):
            free = np.uint64((1 << (BITS - depth)) - 1)
            lo[depth, t] = np.searchsorted(s, h & ~free, side="left")
            hi[depth, t] = np.searchsorted(s, h | free, side="right")
    out = []
    seen = np.zeros(n, bool)
    for i in range(m):
        seen[:] = False
        for depth in range(BITS, -1, -1):
            if (hi[depth, :, i] - lo[depth, :, i]).sum() < wanted and depth:
                continue
            for t, r in enumerate(rows):
                seen[r[lo[depth, t, i] : hi[depth, t, i]]] = True
            if not depth or np.count_nonzero(seen) >= wanted:
                break
        out.append(np.flatnonzero(seen))
    return out


def _answer(key: tuple, base: pd.DataFrame, asked: pd.DataFrame, k: int, trees: int, share: float, seed: int) -> pd.DataFrame:
    if not len(base) or not len(asked):
        return pd.DataFrame({"query_id": pd.array([], "int64"), "query": pd.array([], "int64"), "vec_id": pd.array([], "int64"), "score": pd.array([], "float64")})
    base = base.sort_values("vec_id", ignore_index=True)
    x, q = np.stack(base["v"].to_numpy()).astype(float), np.stack(asked["v"].to_numpy()).astype(float)
    ids, qid, name = base["vec_id"].to_numpy(), asked["query_id"].to_numpy(), asked["query"].to_numpy()
    wanted = max(4 * k, int(np.ceil(share * len(x))))
    rows = []
    for i, c in enumerate(candidates(q, forest(x, trees, seed), wanted)):
        c = c[ids[c] != qid[i]]
        d = np.sqrt(((x[c] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[c], d))[:k]
        rows.append(pd.DataFrame({"query_id": qid[i], "query": name[i], "vec_id": ids[c][best], "score": d[best]}))
    return pd.concat(rows)


def usable(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = 96, share: float = 0.4, block: int = 4096, group: int = 2048, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by `every`."""
    rows = cut(usable(vectors))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (size[0] if size else 0))
    n = size[1] if size else 0
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query"), "v").dropDuplicates(["query_id", "query"])
    groups, blocks = max(1, -(-(n // every + 1) // group)), max(1, -(-n // block))
    each = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    base = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), each(groups, "grp"), "vec_id", "v")
    asked = asked.select(each(blocks, "block"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("grp"), "query_id", "query", "v")
    found = base.groupBy("block", "grp").cogroup(asked.groupBy("block", "grp")).applyInPandas(
        partial_named(_answer, k=k, trees=trees, share=share, seed=seed), FOUND
    )
    best = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def partial_named(f, **given):
    """A function of (key, left, right): applyInPandas counts the parameters."""

    def call(key, left, right):
        return f(key, left, right, **given)

    return call


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
