"""Prefix trie of conversations, rolled up by centroid decomposition.

Each distinct sequence of the first turns of a conversation is a node. A turn is told by a digest
of role and text, a node by a digest chained along its turns, so texts never travel: a task walks
its conversations turn by turn in sorted order and keeps one digest.

Sums over subtrees do not go up level by level, as a conversation may have any number of turns.
The forest of parent edges is split at centroids. `below`, the number of conversation turns in a
node's subtree (known by counting, without the trie), weighs each node; a component's centroid
is its deepest node with at least half the component's weight. Each round, for every component:

- the totals of the centroid's subtree within the component are added to the centroid and along
  the path from it to the component's top;
- the centroid is done; each subtree of its children is a component of its own, and what is
  left above it stays one, without the weight that left.

Components so halve, and rounds grow with the logarithm of the turns. Who lies below a centroid
or above it is looked up in the table of paths (conversation, depth, node), as every node lies on
the path of its smallest member. Components of up to MOST nodes go on with the same steps inside
one task, in arrays.

Defined results: rows without a conv_id belong to no conversation and are left out; turns of
one conversation with the same number stand by role, then by a digest of the turn; repeated rows
are turns of their own; null role or text is empty; an empty table gives an empty result (without
a root); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringfield.llm.common import compact, small, stored, word_count

ROOT = bytes(16)
MOST = 1 << 14  # nodes of a component that one task splits
PIECE = 4096  # ids in a piece of a hashed list


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, rank (from 1), role_text (digest) and words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), name.alias("name"), word_count(text).alias("words"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "name")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("rank"), "name", "words")


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, name, words, length) of conversations that begin with turns of the first of
    their block, and the conversations (conv, length): the first h turns of c - c % block, h by the
    CRC-32 of c modulo `heads`, then its own turns after its first h."""
    lengths = turns.groupBy("conv").agg(F.max("rank").alias("own"))
    c = F.col("conv")
    convs = lengths.select("conv", "own", (c - c % block).alias("base"), (F.crc32(c.cast("string")) % heads).cast("long").alias("h"))
    convs = convs.join(lengths.select(F.col("conv").alias("base"), F.col("own").alias("n_base")), "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = stored(convs.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    own = turns.join(convs, "conv").where("rank > h").select("conv", (F.col("taken") + F.col("rank") - F.col("h")).alias("depth"), "name", "words", "length")
    first = turns.where((F.col("rank") < heads) & (c % block == 0)).select(c.alias("base"), F.col("rank").alias("depth"), "name", "words")
    begun = first.join(convs, "base").where("depth <= h").select("conv", "depth", "name", "words", "length")
    return own.unionByName(begun), convs.select("conv", "length")


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of (conv, depth) -> node and parent of each; a conversation may run over several batches."""
    conv, key = None, ROOT
    for b in batches:
        keys, parents = [], []
        for c, name in zip(b["conv"].tolist(), b["name"], strict=True):
            if c != conv:
                conv, key = c, ROOT
            parents.append(key)
            key = hashlib.blake2b(key + name, digest_size=16).digest()
            keys.append(key)
        yield pd.DataFrame({"conv": b["conv"], "depth": b["depth"], "key": keys, "parent": parents, "words": b["words"], "length": b["length"]})


def paths_of(turns: DataFrame) -> DataFrame:
    """turns (conv, depth, name, words, length) -> (conv, depth, key, parent, words, length), as a table."""
    lined = turns.repartition("conv").sortWithinPartitions("conv", "depth").select("conv", "depth", "name", "words", "length")
    return stored(lined.mapInPandas(_chained, "conv bigint, depth bigint, key binary, parent binary, words bigint, length bigint"))


def nodes_of(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes: key, parent, conv (smallest member), depth, n_convs, words (of the last turn), below."""
    inner = paths.groupBy("key").agg(
        F.first("parent").alias("parent"), F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.first("words").alias("words"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"),
    )
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") + 1).alias("below")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), "conv", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"), "below")
    return inner.unionByName(root)


def split(parent: np.ndarray, top: np.ndarray, below: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values (n, k) over subtrees. Rows are nodes in the order of depth; parent is a row, -1
    at the top of a component; top is the row of a node's component; below its weight there."""
    parent, top, below, sums = parent.copy(), top.copy(), below.copy(), np.zeros_like(values)
    live = np.arange(len(parent))
    while len(live):
        heavy = live[2 * below[live] >= below[top[live]]]
        centre = np.full(len(parent), -1)
        np.maximum.at(centre, top[heavy], heavy)  # later rows are deeper
        tops = np.flatnonzero(centre >= 0)
        centres = centre[tops]
        via = np.full(len(parent), -1)  # the child of the centroid that a node below it descends from
        edges = np.flatnonzero(np.diff(depth[live])) + 1
        for v in np.split(live, edges):
            p = parent[v]
            via[v] = np.where(p < 0, -1, np.where(p == centre[top[v]], v, via[p]))
        inside = live[via[live] >= 0]
        total = np.zeros_like(values)
        np.add.at(total, top[inside], values[inside])
        total[tops] += values[centres]
        sums[centres] += total[tops]
        at, of, gone = parent[centres], tops, below[centres]
        while len(at):
            keep = at >= 0
            at, of, gone = at[keep], of[keep], gone[keep]
            sums[at] += total[of]
            below[at] -= gone
            at = parent[at]
        top[inside] = via[inside]
        parent[inside[via[inside] == inside]] = -1
        live = np.setdiff1d(live, centres, assume_unique=True)
    return sums


def _split(batches: Iterator[pd.DataFrame], values: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in the order of component -> sums; a component may run over several batches."""
    held = None
    for b in batches:
        if not len(b):
            continue
        b = b if held is None else pd.concat((held, b), ignore_index=True)
        component = b["component"].to_numpy()
        last = int(np.flatnonzero(np.r_[True, component[1:] != component[:-1]])[-1])
        if last:
            yield _sums(b.iloc[:last], values)
        held = b.iloc[last:]
    if held is not None:
        yield _sums(held, values)


def _sums(b: pd.DataFrame, values: list[str]) -> pd.DataFrame:
    b = b.sort_values("depth", kind="stable")
    at = {k: i for i, k in enumerate(b["key"])}
    top = np.fromiter((at[k] for k in b["component"]), np.int64, len(b))
    parent = np.fromiter((-1 if c == k else at[p] for k, p, c in zip(b["key"], b["parent"], b["component"], strict=True)), np.int64, len(b))
    found = split(parent, top, b["below"].to_numpy(), b["depth"].to_numpy(), b[values].to_numpy(np.int64))
    return pd.DataFrame({"key": b["key"].to_numpy(), **{v: b[f"sum_{v}"].to_numpy() + found[:, i] for i, v in enumerate(values)}})


def rolled_up(nodes: DataFrame, paths: DataFrame, values: list[str], most: int = MOST) -> DataFrame:
    """nodes (key, parent, conv, depth, below, values), paths (conv, depth, key, parent) -> key and the
    sums of the values over each node's subtree, itself included."""
    sums = [f"sum_{v}" for v in values]
    live = stored(nodes.select("key", "parent", "conv", "depth", "below", F.lit(ROOT).alias("component"), *values, *[F.lit(0).cast("long").alias(s) for s in sums]))
    done = []
    while True:
        sizes = live.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("below").alias("whole"))
        large = compact(sizes.where(F.col("n") > most).select("component", "whole"))
        if large.isEmpty():
            break
        named = small(large)
        rest = live.join(named, "component", "left_anti")
        cut_up = live.join(named, "component")
        centre = cut_up.where("2 * below >= whole").groupBy("component").agg(F.min(F.struct("below", "key", "conv", "depth")).alias("c"))
        centre = small(compact(centre.select("component", F.col("c.key").alias("c_key"), F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.below").alias("c_below"))))
        onward = paths.join(centre, F.col("parent") == F.col("c_key")).select("component", "conv", F.col("key").alias("via"))
        upward = paths.join(centre, (F.col("conv") == F.col("c_conv")) & (F.col("depth") <= F.col("c_depth"))).select("component", F.col("parent").alias("key"), F.col("c_below").alias("less"))
        marked = live.join(centre, "component").join(onward, ["component", "conv"], "left").withColumn("via", F.when(F.col("depth") > F.col("c_depth"), F.col("via")))
        marked = stored(marked.join(upward, ["component", "key"], "left"))
        inside = F.col("via").isNotNull() | (F.col("key") == F.col("c_key"))
        totals = small(compact(marked.where(inside).groupBy("component").agg(*[F.sum(v).alias(f"t_{v}") for v in values])))
        adds = (F.col("key") == F.col("c_key")) | F.col("less").isNotNull()
        marked = marked.join(totals, "component").withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.when(adds, F.col(f"t_{v}")).otherwise(0) for v in values})
        done.append(compact(marked.where("key = c_key").select("key", *[F.col(f"sum_{v}").alias(v) for v in values])))
        halves = marked.where("key <> c_key").select("key", "parent", "conv", "depth", (F.col("below") - F.coalesce("less", F.lit(0))).alias("below"), F.coalesce("via", "component").alias("component"), *values, *sums)
        live = stored(halves.unionByName(rest))
    lined = live.repartition("component").sortWithinPartitions("component", "depth")
    out = lined.mapInPandas(partial(_split, values=values), ", ".join(["key binary", *[f"{v} bigint" for v in values]]))
    for d in done:
        out = out.unionByName(d)
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of (key, conv) -> (key, first id, ids joined), up to PIECE ids each."""
    for b in batches:
        key, conv = b["key"].to_numpy(), b["conv"].to_numpy()
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(b) else np.zeros(0, np.int64)
        ends = np.r_[begins[1:], len(b)]
        spans = [(lo, min(lo + PIECE, e)) for s, e in zip(begins.tolist(), ends.tolist(), strict=True) for lo in range(s, e, PIECE)]
        yield pd.DataFrame({"key": [key[lo] for lo, _ in spans], "conv": [conv[lo] for lo, _ in spans], "ids": [",".join(map(str, conv[lo:hi].tolist())) for lo, hi in spans]})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in the order of (key, conv) -> the SHA-256 of each key's joined pieces; one state at a time."""
    key, state = None, None
    for b in batches:
        out = []
        for k, ids in zip(b["key"], b["ids"], strict=True):
            if k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])


def ends_of(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """key -> ends_sha256: of the ids, in ascending order, of the conversations that end at the node."""
    ends = paths.where("depth = length").select("key", "conv").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("key"), "conv"))
    pieces = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInPandas(_pieces, "key binary, conv bigint, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "conv").select("key", "ids").mapInPandas(_hashed, "key binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, most: int = MOST) -> DataFrame:
    """turns (conv, depth, name, words, length), convs (conv, length) -> the nodes of their prefix trie."""
    paths = paths_of(turns)
    bare = stored(nodes_of(paths, convs))
    children = bare.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(bare.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    sums = rolled_up(own, paths, ["n_leaves", "saved_tokens"], most)
    above = bare.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, "key").join(ends_of(paths, convs), "key", "left").join(above, "parent", "left")
    nobody = hashlib.sha256().hexdigest()
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
