"""A Merkle manifest of a dataset: subroots by source, one root, and a proof for each document.

A document's leaf is the digest of its fields. A source's leaves stand in the order of their ids,
and every FAN consecutive nodes become one, until one is left.

Coordinates come from bitmaps, not from a sort. For each source, 64 ids that follow each other
are one word of a bitmap, kept only if some bit is set; words of all tasks merge by OR. A popcount
directory over the words has levels of 1,024 words, then 65,536 nodes each, so that its running
sums stay in groups of bounded size whatever the ids are. A leaf's place is what the directory
has before its word plus the ones below its bit.

Levels are reduced through arrays: with a span of 3 ** levels, leaf p goes to slot p % span of
array p / span of its source, and an array goes up that many levels at once. A pass leaves one
node of a span, so a source of 10 billion documents takes four. Paths come down the same arrays. A subroot's path goes on in the
tree over the subroots.

Defined results: rows without an id stand before all others of their source; rows that share
source and id stand in the order of their leaves, and equal rows in any order, each with its own
place and path; a null source is a source of its own and comes first; null fields are `-`, an
empty text is `0:`; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringfield.llm.common import before_sum, cut, small, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 3, 6  # children of a node; levels of one array, which so has up to 729 slots
NO_ID = -(1 << 57) - 1  # the word of rows without an id: before that of any long
STEPS = (10, 16, 16)  # a word's container of 1,024 words, and two levels above it
PATHS = "tree string, pos bigint, subroot string, lefts array<string>, rights array<string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of the fields, each `-` or its byte count, `:` and itself."""
    as_text = [c.cast("string") for c in fields.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in as_text])


def directory(leaves: DataFrame) -> DataFrame:
    """leaves (tree, word, bit) -> a row for each word that has some: bits, extras (bit, n) of ids that
    several rows have, base (rows of the tree before it) and n_tree (rows of the tree)."""
    words = cut(leaves.groupBy("tree", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n")))
    keys = [F.col("word")]
    for step in STEPS:
        keys.append(F.shiftright(keys[-1], step))
    level = words.select("tree", *[k.alias(f"k{i}") for i, k in enumerate(keys)], "n")
    levels = [level]
    for i in range(1, len(keys)):
        level = level.groupBy("tree", *[f"k{j}" for j in range(i, len(keys))]).agg(F.sum("n").alias("n"))
        levels.append(level)
    base = level.groupBy("tree").agg(F.sum("n").alias("n_tree"), F.lit(0).cast("long").alias("base"))
    for i in reversed(range(len(keys))):
        above = ["tree", f"k{i + 1}"] if i + 1 < len(keys) else ["tree"]
        before = Window.partitionBy(*above).orderBy(f"k{i}").rowsBetween(Window.unboundedPreceding, -1)
        run = levels[i].select(*above, f"k{i}", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run"))
        base = run.join(base, above).select("tree", f"k{i}", "n_tree", (F.col("base") + F.col("run")).alias("base"))
    crowded = small(words.where("n > bit_count(bits)").select("tree", "word"))
    ids = leaves.join(crowded, ["tree", "word"], "left_semi").groupBy("tree", "word", "bit").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    extras = ids.groupBy("tree", "word").agg(F.collect_list(F.struct("bit", "n")).alias("extras"))  # at most 64
    return cut(words.drop("n").join(base.withColumnRenamed("k0", "word"), ["tree", "word"]).join(extras, ["tree", "word"], "left"))


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (tree, word, bit, leaf, row, ...) with pos, the place in the tree, and n, the tree's leaves."""
    found = directory(leaves)
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit)) + coalesce(aggregate(extras, 0L, (a, x) -> a + IF(x.bit < bit, x.n, 0L)), 0L)")
    pos = leaves.join(found, ["tree", "word"]).withColumn("pos", F.col("base") + below)
    repeated = found.select("tree", "word", F.explode("extras").alias("x")).select("tree", "word", "x.bit")
    if not repeated.isEmpty():
        ties = leaves.join(small(repeated), ["tree", "word", "bit"], "left_semi").select("tree", "word", "bit", "leaf", "row", (F.col("row") % 64).alias("part"), F.lit(1).alias("one"))
        ties = before_sum(ties, ["tree", "word", "bit"], ["leaf", "part"], ["row"], "one", "tie").select("row", "tie")
        pos = pos.join(ties, "row", "left").withColumn("pos", F.col("pos") + F.coalesce("tie", F.lit(0)))
    return pos.withColumnRenamed("n_tree", "n").drop("base", "bits", "extras", "tie")


def levels_of(n: int, nodes: list[str], levels: int) -> list[list[str]]:
    """One array of a level of n nodes, and what it becomes, up to so many levels or the tree's top."""
    out = [nodes]
    for j in range(levels):
        if n > FAN**j:
            nodes = [hashlib.sha256("".join(nodes[i : i + FAN]).encode()).hexdigest() for i in range(0, len(nodes), FAN)]
            out.append(nodes)
    return out


def _tops(batches: Iterator[pd.DataFrame], levels: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        tops = [levels_of(k, list(d), levels)[-1][0] for k, d in zip(b["n"], b["digest"], strict=True)]
        yield pd.DataFrame({"tree": b["tree"], "n": -(-b["n"] // FAN**levels), "pos": b["place"], "digest": tops})


def raised(nodes: DataFrame, payload: tuple[str, ...], levels: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes (tree, n, pos, digest) -> the arrays of each pass, and the trees' tops (tree, digest).
    The columns of payload, strings (pandas has no nulls in arrays of long), stay beside their nodes in the first pass."""
    passes: list[DataFrame] = []
    span = FAN**levels
    while True:
        slot = F.struct((F.col("pos") % span).alias("slot"), "digest", *payload)
        arrays = nodes.groupBy("tree", "n", F.expr(f"pos DIV {span}").alias("place")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        arrays = stored(arrays.select("tree", "n", "place", *[F.col(f"slots.{c}").alias(c) for c in ("digest", *payload)]))
        passes.append(arrays)
        payload = ()
        nodes = arrays.mapInPandas(partial(_tops, levels=levels), "tree string, n bigint, pos bigint, digest string")
        if (arrays.agg(F.max("n")).first()[0] or 0) <= span:
            return passes, cut(nodes.select("tree", "digest"))


def _lowered(batches: Iterator[pd.DataFrame], payload: tuple[str, ...], most: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.to_dict("records"):
            levels = levels_of(r["n"], list(r["digest"]), most)[:-1]
            lefts, rights = [], []
            for i in range(len(r["digest"])):
                at = [(level, i // FAN**j) for j, level in enumerate(levels)]
                lefts.append(["".join(v[k - k % FAN : k]) for v, k in at] + list(r["lefts"]))
                rights.append(["".join(v[k + 1 : k - k % FAN + FAN]) for v, k in at] + list(r["rights"]))
            pos = r["place"] * FAN**most + np.arange(len(lefts))
            yield pd.DataFrame({"tree": r["tree"], "pos": pos, "subroot": r["subroot"], "lefts": lefts, "rights": rights, **{c: r[c] for c in payload}})


def lowered(passes: list[DataFrame], tops: DataFrame, payload: str, levels: int) -> DataFrame:
    """The paths of all nodes: digests to the left and to the right at each level, from the node to
    the root. tops: the paths of the trees' tops, as PATHS. payload: names and types of raised()'s payload."""
    paths = tops
    for k, arrays in reversed(list(enumerate(passes))):
        more = payload if k == 0 else ""
        names = tuple(x.split()[0] for x in more.split(",") if x)
        rows = arrays.join(paths.withColumnRenamed("pos", "place"), ["tree", "place"])
        paths = rows.mapInPandas(partial(_lowered, payload=names, most=levels), f"{PATHS}, {more}" if more else PATHS)
        if k:
            paths = stored(paths)
    return paths


def numbered(df: DataFrame, by: str) -> DataFrame:
    """df in the order of `by` with pos, gapless from 0: a range-partitioned sort and an offset for each partition."""
    lined = cut(df.orderBy(by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = lined.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # as many as partitions
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["_part"], total))
        total += r["count"]
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    out = lined.withColumn("_part", part).join(F.broadcast(table), "_part")
    return out.withColumn("pos", F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("n", F.lit(total).cast("long")).drop("_at", "_part", "_offset")


def manifest(docs: DataFrame, also: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """docs (FIELDS) -> doc_id, source, pos, leaf, subroot, root, lefts, rights: the path that proves a
    leaf against the root. also: further string columns by expressions over docs."""
    also = also or {}
    tree = F.coalesce(F.concat(F.lit("+"), "source"), F.lit(""))  # "" stands before all others
    word, bit = F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_ID)), F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(c) for c in FIELDS[1:]]]
    texts = docs.select(*columns)
    leaves = stored(texts.select("doc_id", tree.alias("tree"), word.alias("word"), bit.alias("bit"), leaf({c: F.col(c) for c in FIELDS}).alias("leaf"), F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in also.items()]))
    nodes = placed(leaves).select("tree", "n", "pos", F.col("leaf").alias("digest"), F.col("doc_id").cast("string").alias("doc"), "leaf", *also)
    passes, subroots = raised(nodes, ("doc", "leaf", *also), levels)
    above, root = raised(numbered(subroots, "tree").select(F.lit("").alias("tree"), "n", "pos", "digest", F.col("tree").alias("name")), ("name",), levels)
    top = root.first()
    nothing = F.array().cast("array<string>")
    start = root.select("tree", F.lit(0).cast("long").alias("pos"), F.lit("").alias("subroot"), nothing.alias("lefts"), nothing.alias("rights"))
    by_source = lowered(above, start, "name string", levels).join(subroots.withColumnRenamed("tree", "name"), "name")
    tops = stored(by_source.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "lefts", "rights"))
    rows = lowered(passes, tops, ", ".join(f"{k} string" for k in ("doc", "leaf", *also)), levels)
    source = F.when(F.col("tree") != "", F.substr("tree", F.lit(2)))
    return rows.select(F.col("doc").cast("long").alias("doc_id"), source.alias("source"), "pos", "leaf", "subroot", F.lit(top and top["digest"]).cast("string").alias("root"), "lefts", "rights", *also)


def folded(node: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its path lead to."""
    path = F.zip_with(lefts, rights, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(path, node, lambda d, p: digest(p["x"], d, p["y"]))


def checked(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Digests of the manifest, and whether documents still verify after a tampering that takes the
    line ends out of the texts whose decimal id has an even CRC-32."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proved = manifest(docs, {"tampered": leaf({c: text if c == "text" else F.col(c) for c in FIELDS})}, levels)
    proof = F.sha2(F.array_join(F.zip_with("lefts", "rights", lambda x, y: F.concat(x, y)), ""), 256)
    again = folded(F.col("tampered"), F.col("lefts"), F.col("rights"))
    out = proved.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
