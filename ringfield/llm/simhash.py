"""SimHash near-dedup by a grid over segment popcounts.

A document's fingerprint has 64 bits: bit i is 1 if over half the hashes of its word shingles have
it. Fingerprints link at 2 or fewer differing bits. Those pairs are found in three steps, none of
which emits pairs of a bucket or compares a bucket's members with each other.

1. Embedding: 16 segments of four bits, and a fingerprint's point is the count of ones in each.
   The Manhattan distance of two points is at most the number of differing bits.
2. Grid range-join: two points at distance 2 or less have a grid point within 1 of both, so each
   fingerprint goes to its own grid point and to those one step away, 33 at most. Grid points with
   one visitor are no candidates. They are counted, not gathered.
3. Exact check: where a grid point has several visitors, each of them names the 64-bit words that
   lie at that grid point and differ from it in at most one bit, at most four. Two fingerprints
   share such a word if and only if they differ in at most two bits. A word has at most 65
   visitors, and the smallest is linked with each of the others.

Distinct fingerprints are one node, however many documents have them.

Defined results: null, empty and blank texts have fingerprint zero and are linked with each other
(and with fingerprints of one or two ones); texts with fewer words than a shingle are one shingle;
repeated rows get equal results each; rows without an id link others like any row, but name no
component (a component of such rows alone has component_id null); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.llm.common import compact, stored
from ringfield.operators.graph import components

SEED, SHINGLE, MOST = 42, 3, 2
SEGMENTS = 16  # of four bits; their counts fill the nibbles of one word
BLOCK = 1 << 15  # shingles counted at a time


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    ws = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not ws:
        return 0
    k = min(size, len(ws))
    body = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(ws) - k + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        spans = zip(starts[lo:hi].tolist(), ends[lo + k - 1 : hi + k - 1].tolist(), strict=True)
        h = np.fromiter((digest(body[s:e], SEED) for s, e in spans), "<u8", hi - lo)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def _marked(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        prints = np.array([fingerprint(t, size) for t in b["text"]], np.uint64)
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "print": prints.view(np.int64)})


def point(prints: np.ndarray) -> np.ndarray:
    """The count of ones in each group of four bits, in those four bits."""
    pairs = prints - ((prints >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))


def _visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cell, print, step): step 0 for the own grid point, s + 1 for one more in segment s, -s - 1 for one less."""
    for b in batches:
        for at in range(0, len(b), 4096):
            prints = b["print"].to_numpy(np.int64)[at : at + 4096]
            own = point(prints.view(np.uint64))
            cells, rows, steps = [own], [np.arange(len(prints))], [np.zeros(len(prints), np.int8)]
            for s in range(SEGMENTS):
                one = np.uint64(1 << 4 * s)
                count = (own >> np.uint64(4 * s)) & np.uint64(15)
                for ok, cell, step in ((count < 4, own + one, s + 1), (count > 0, own - one, -s - 1)):
                    cells.append(cell[ok])
                    rows.append(np.flatnonzero(ok))
                    steps.append(np.full(int(ok.sum()), step, np.int8))
            yield pd.DataFrame({"cell": np.concatenate(cells).view(np.int64), "print": prints[np.concatenate(rows)], "step": np.concatenate(steps)})


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, print): the words at the visited grid point that differ from the fingerprint in at most one bit."""
    for b in batches:
        prints, step = b["print"].to_numpy(np.int64).view(np.uint64), b["step"].to_numpy(np.int64)
        words, owners = [prints[step == 0]], [prints[step == 0]]
        for bit in range(4):
            moved = step != 0
            flip = np.uint64(1) << (4 * (np.abs(step[moved]) - 1) + bit).astype(np.uint64)
            mine = prints[moved]
            right = ((mine & flip) == 0) == (step[moved] > 0)  # one more is a 0 that becomes 1
            words.append((mine ^ flip)[right])
            owners.append(mine[right])
        yield pd.DataFrame({"word": np.concatenate(words).view(np.int64), "print": np.concatenate(owners).view(np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """prints (print), distinct -> (a, b): links that join all pairs of 2 or fewer differing bits."""
    visits = prints.select("print").mapInPandas(_visits, "cell bigint, print bigint, step tinyint")
    crowded = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    words = visits.join(crowded, "cell", "left_semi").select("print", "step").mapInPandas(_words, "word bigint, print bigint")
    met = words.groupBy("word").agg(F.sort_array(F.collect_list("print")).alias("p")).where("size(p) > 1")  # at most 65
    pairs = met.select(F.col("p")[0].alias("a"), F.explode(F.slice("p", 2, 64)).alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST).distinct()


def grouped(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint, component_id), a row for each row."""
    marked = stored(docs.select("doc_id", "text").mapInPandas(partial(_marked, size=shingle), "doc_id bigint, print bigint"))
    nodes = compact(marked.groupBy("print").agg(F.min("doc_id").alias("first")))
    found = components(None, compact(links(nodes))).select(F.col("id").alias("print"), "component")
    named = compact(nodes.join(found, "print", "left").withColumn("component", F.coalesce("component", "print")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    out = marked.join(named.join(least, "component").select("print", "component_id"), "print", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
