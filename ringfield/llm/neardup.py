"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles is reduced to a signature of PERMS minima, each cut to 16
bits. Two sets of similarity s differ in a given place with probability 1 - s, so sets of
similarity 0.8 differ in more than MOST = 31 of the 80 places with probability below 1e-4, and
sets of 0.85 below 1e-8. All pairs within that signature distance are found by pigeonhole: the
places are dealt into 16 chunks; if at most 31 places differ, some chunk has at most one error;
so each chunk is written once for each place that may be wrong, without that place, and equal
keys meet in a bucket.

Nothing emits all pairs of a bucket.

1. Each bucket is compared with its most central member, the one whose 80 buckets are the most
   crowded: the text that the others are edits of, if there is one. Links join components, and a
   bucket whose members lie in one component is done.
2. Buckets that still hold several components are dealt into units of bounded size: the members
   of the largest component by blocks, the rest by blocks, and each block of the rest meets each
   block of both. A unit compares signatures and gives out only pairs of different components
   within MOST, and only in the first of the buckets that a pair shares, so each candidate is one
   row however many buckets it is in.

Candidates whose sets cannot share enough shingles go: shingles are counted in CELLS cells by
hash, and two sets share at most the sum of the smaller counts. That bound loses no link. Every
other candidate is confirmed on the full sets. No bucket is capped. Equal sets are one class from
the start, so groups of copies cost one signature.

Defined results: null and empty texts have no shingles, are linked with nothing and are kept;
texts with fewer words than a shingle are one shingle; rows of one id are taken to hold one text
(of several, the one whose set has the smallest digest stands for it), and all rows of the
smallest id are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.llm.common import compact, released, small, stored
from ringfield.operators.graph import components

PERMS, MOST, CHUNKS = 80, 31, 16
PLACES = PERMS // CHUNKS
CELLS = 256  # shingles counted by hash
UNIT, REST = 1024, 256  # members of a unit: of the largest component, of the others
SLAB = 1 << 17  # pairs compared at a time
CACHE = 1_000_000

_R = np.random.default_rng(20240917)
_MUL = _R.integers(0, 1 << 32, PERMS, dtype=np.uint32) | np.uint32(1)
_XOR = _R.integers(0, 1 << 32, PERMS, dtype=np.uint32)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P2
    return h ^ (h >> np.uint64(29))


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, size: int, known: Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not ws:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k if len(w) < size else 0, np.uint64)
    for i in range(k):
        h = mix(h * _P1 + w[i : len(w) - k + 1 + i])
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(low, ((_MUL[:, None] * x[None, lo : lo + 2048]) ^ _XOR[:, None]).min(axis=1), out=low)
    return low.astype(np.uint16)


def _signed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    known = Words()
    for b in batches:
        n, hi, lo, sig, cells = [], [], [], [], []
        for t in b["text"]:
            s = shingle_set(t, size, known)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            hi.append((d >> 64) - (1 << 63))
            lo.append((d & ((1 << 64) - 1)) - (1 << 63))
            sig.append(signature(s).tobytes() if len(s) else None)
            cells.append(np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes() if len(s) else None)
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_shingles": n, "hi": hi, "lo": lo, "sig": sig, "cells": cells})


def _sets(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    known = Words()
    for b in batches:
        yield pd.DataFrame({"id": b["doc_id"].astype("Int64"), "shingles": [shingle_set(t, size, known).view(np.int64) for t in b["text"]]})


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, id, slot) for each place that may be wrong: the key is the rest of the place's chunk."""
    for b in batches:
        for at in range(0, len(b), 2048):
            part = b.iloc[at : at + 2048]
            sig = _matrix(part["sig"]).astype(np.uint64)
            keys = np.empty((len(part), PERMS), np.uint64)
            for slot in range(PERMS):
                first = slot // PLACES * PLACES
                h = np.full(len(part), slot + 1, np.uint64)
                for i in range(first, first + PLACES):
                    if i != slot:
                        h = mix(h * _P1 + sig[:, i] + np.uint64(1))
                keys[:, slot] = h
            slots = np.tile(np.arange(PERMS, dtype=np.int8), len(part))
            yield pd.DataFrame({"key": keys.ravel().view(np.int64), "id": np.repeat(part["id"].to_numpy(np.int64), PERMS), "slot": slots})


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), PERMS)


def _counts(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), CELLS)


def _may_share(x: np.ndarray, y: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with cell counts x and y, of n shingles together, may share enough of them. A
    count of 255 stands for any larger one."""
    most = np.minimum(x, y)
    shared = most.sum(1, dtype=np.int64)
    return (shared * 100 >= (n - shared) * percent) | (most == 255).any(1)


def _distance(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs within the signature distance that may share enough shingles."""
    for b in batches:
        for at in range(0, len(b), 4096):
            part = b.iloc[at : at + 4096]
            near = (_matrix(part["sig_a"]) != _matrix(part["sig_b"])).sum(1) <= MOST
            near &= _may_share(_counts(part["cells_a"]), _counts(part["cells_b"]), part["n"].to_numpy(), percent)
            yield part.loc[near, ["a", "b"]]


def _near(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by unit and side -> the candidates of each unit; a unit may run over several batches."""
    held = None
    for b in batches:
        if not len(b):
            continue
        b = b if held is None else pd.concat((held, b), ignore_index=True)
        units = b["unit"].to_numpy()
        last = int(np.flatnonzero(np.r_[True, units[1:] != units[:-1]])[-1])
        yield from _compared(b.iloc[:last], percent)
        held = b.iloc[last:]
    if held is not None:
        yield from _compared(held, percent)


def _compared(b: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    """side 0 meets side 1 of its unit, side 2 meets the later rows of its unit."""
    if len(b) < 2:
        return
    unit, side, ids, component, n, slot = (b[c].to_numpy() for c in ("unit", "side", "id", "component", "n", "slot"))
    sig, cells = _matrix(b["sig"]), _counts(b["cells"])
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[first, len(b)])
    end = np.repeat(first + size, size)
    right = np.repeat(first + np.add.reduceat((side == 0).astype(np.int64), first), size)  # where side 1 begins
    begin = np.where(side == 0, right, np.where(side == 2, np.arange(len(b)) + 1, end))
    ends = np.cumsum(end - begin)
    lo = 0
    while lo < len(b):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLAB, side="right")))
        count = (end - begin)[lo:hi]
        x = np.repeat(np.arange(lo, hi), count)
        y = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[lo:hi], count)
        fits = (component[x] != component[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        x, y = x[fits], y[fits]
        equal = sig[x] == sig[y]
        near = np.flatnonzero(equal.sum(1) >= PERMS - MOST)
        near = near[np.r_[False, *(_may_share(cells[x[k]], cells[y[k]], n[x[k]] + n[y[k]], percent) for k in np.array_split(near, len(near) // 16384 + 1))][1:]]
        x, y, equal = x[near], y[near], equal[near].reshape(-1, CHUNKS, PLACES)
        right_ones = equal.sum(2) >= PLACES - 1
        chunk = right_ones.argmax(1)  # of all buckets that the two share, the first one's chunk and slot
        here = right_ones.any(1) & (chunk * PLACES + equal[np.arange(len(x)), chunk].argmin(1) == slot[x])
        yield pd.DataFrame({"a": np.minimum(ids[x], ids[y])[here], "b": np.maximum(ids[x], ids[y])[here]})
        lo = hi


def confirmed(near: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of class ids within the signature distance -> those linked on full sets."""
    ids = compact(near.select(F.col("a").alias("doc_id")).unionAll(near.select(F.col("b").alias("doc_id"))).distinct())
    texts = docs.join(small(ids), "doc_id", "left_semi").select("doc_id", "text")
    sets = stored(texts.mapInPandas(partial(_sets, size=shingle), "id bigint, shingles array<bigint>").where("id is not null"))
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    inter = F.size(F.array_intersect("x", "y"))
    links = near.join(x, "a").join(y, "b").where(inter * 100 >= (F.size("x") + F.size("y") - inter) * percent)
    return compact(links.select("a", "b"))


def buckets(keyed: DataFrame) -> DataFrame:
    """The rows of keys that several ids have, with their number. keyed is cheaper to make twice than to keep."""
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return stored(keyed.join(many, "key"))


def stars(members: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's most central member and the others, within the signature distance."""
    central = members.groupBy("id").agg(F.sum("members").alias("crowd"))
    ranked = members.select("key", "id").join(central, "id")
    pivot = ranked.groupBy("key").agg(F.max(F.struct("crowd", (-F.col("id")).alias("id")))["id"].alias("id")).select("key", (-F.col("id")).alias("pivot"))
    pairs = members.select("key", "id").join(pivot, "key").where("id <> pivot")
    pairs = pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    side = lambda x: sig.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n_shingles", "sig", "cells")])
    n_a, n_b = F.col("n_shingles_a"), F.col("n_shingles_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)
    both = both.select("a", "b", "sig_a", "sig_b", "cells_a", "cells_b", (n_a + n_b).alias("n"))
    return compact(both.mapInPandas(partial(_distance, percent=percent), "a bigint, b bigint"))


def left_over(members: DataFrame, found: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Candidates of different components in buckets that hold several."""
    named = stored(members.select("key", "id", "slot").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    inside = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    core = inside.groupBy("key").agg(F.max(F.struct("n", "component")).alias("c"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("components"))
    core = core.where("components > 1").select(
        "key", F.col("c.component").alias("core"), (F.col("all") <= UNIT).alias("one"),
        F.ceil(F.col("c.n") / UNIT).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("c.n")) / REST).cast("int").alias("rests"),
    )
    h = F.xxhash64(F.lit(7), "id")
    rows = named.join(core, "key").withColumn("mine", F.when(F.col("component") == F.col("core"), F.pmod(h, F.col("blocks"))).otherwise(F.pmod(h, F.col("rests"))).cast("int"))
    # (i, j, side): block i of the rest against block j of the core, or against block j - blocks of the rest
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    of_core = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side")))
    of_rest = F.transform(
        F.sequence(F.lit(0), F.col("blocks") + F.col("rests") - 1),
        lambda j: F.when(j < F.col("blocks") + F.col("mine"), F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(0).alias("side")))
        .when(j == F.col("blocks") + F.col("mine"), F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(2).alias("side")))
        .otherwise(F.struct((j - F.col("blocks")).alias("i"), (F.col("blocks") + F.col("mine")).alias("j"), F.lit(1).alias("side"))),
    )
    to = F.when(F.col("one"), whole).when(F.col("component") == F.col("core"), of_core).otherwise(of_rest)
    dealt = rows.select("key", "id", "slot", "component", F.explode(to).alias("to"))
    # of_rest above: block i meets the blocks before it as their side 0, the later ones as side 1
    dealt = dealt.select(F.xxhash64("key", "to.i", "to.j").alias("unit"), F.col("to.side").alias("side"), "id", "slot", "component")
    full = dealt.join(sig.select("id", "sig", "cells", F.col("n_shingles").alias("n")), "id").repartition("unit").sortWithinPartitions("unit", "side")
    return compact(full.mapInPandas(partial(_near, percent=percent), "a bigint, b bigint").distinct())


def grouped(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row for each row."""
    signed = stored(docs.select("doc_id", "text").mapInPandas(partial(_signed, size=shingle), "doc_id bigint, n_shingles bigint, hi bigint, lo bigint, sig binary, cells binary"))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(some.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("cells").alias("cells")))
    sig = classes.groupBy("id").agg(F.min(F.struct("hi", "lo", "n_shingles", "sig", "cells")).alias("c")).select("id", "c.n_shingles", "c.sig", "c.cells")

    members = buckets(classes.select("id", "sig").mapInPandas(_keyed, "key bigint, id bigint, slot tinyint"))
    released(docs.sparkSession)  # of the keys that one id alone has
    links = confirmed(stars(members, sig, percent), docs, shingle, percent)
    released(docs.sparkSession)
    more = confirmed(left_over(members, components(None, links), sig, percent), docs, shingle, percent)
    found = components(None, links.unionAll(more))

    named = stored(classes.join(found, "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("component_id")))
    out = signed.drop("sig", "cells").join(named, ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=2, percent=80)
