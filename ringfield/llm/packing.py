"""Best-fit packing with several capacities.

A bin has three capacities: tokens, documents, and attention cost (sum of squared lengths).
Pieces are counted by length, a table of at most `capacity` rows, and vector best-fit runs over
that table, longest first: among the bins in which a piece fits under every constraint, the one
whose weighted residual norm is least takes it. Bins in the same state are handled together, so
the work depends on the number of lengths, never on the number of documents. Documents then
find their place by their rank among the pieces of their length (a two-level prefix count).

Defined results: null and empty texts are the single id that ends a document; repeated rows
are packed one by one; a text of any length is cut only into pieces of `capacity`; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.llm.common import before_sum, cut, fine_buckets

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
CACHE = 800_000  # words whose ids a worker remembers as recent ones

_BLANKS = re.compile("[ \t\n\r]+")
_SYMBOL = re.compile(r"(?:[^\w\s]|_)[.,]\s")
# kinds of bytes: white space, full stop or comma, separators 1C to 1F, other ASCII symbols, ASCII letters and digits, the rest
_KIND = bytes(
    32 if i in b" \t\n\r\x0b\x0c" else 46 if i in b".," else 88 if 0x1C <= i <= 0x1F else 117 if i > 127 else 97 if chr(i).isalnum() else 35
    for i in range(256)
)


def words_of(text: str) -> list[str]:
    """Pieces of a text that the tokenizer encodes one by one to the same ids: its words, where
    that is safe in lower case and apart from a full stop or comma behind them, so that they recur."""
    raw = (text + " ").encode("utf-8", "surrogatepass").lower()
    kind = raw.translate(_KIND)
    if b"X" in kind:  # white space for Python alone
        return [w for w in _BLANKS.split(text) if w]
    # marks that compose with letters, special tokens, and stops that run on from another symbol
    if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw or b"#. " in kind or b".. " in kind or (b"u. " in kind and _SYMBOL.search(text + " ")):
        return text.split()
    plain = raw.decode("utf-8", "surrogatepass")
    return plain.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").replace(",\n", " ,\n").split()


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary's tokenizer drops white space and never joins across it, so a text's ids are
    those of its words in order, and words recur."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Recent()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encoded(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Letters alone are one run each, so many such words are encoded as one text and cut at run ends."""
        letters = [w for w in new if w.isalpha()]
        for lo in range(0, len(letters), 2000):
            some = letters[lo : lo + 2000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            yield from zip(some, (raw[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True)
        others = [w for w in new if not w.isalpha()]
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            yield w, np.asarray(e.ids, dtype="<u4").tobytes()

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        split = [words_of(t) if t else () for t in texts]
        new = self.known.missing(set().union(*split))
        self.known.update(self.encoded(list(new)))
        for ws in split:
            yield b"".join(map(self.known.__getitem__, ws))


class Recent(dict):
    """Remembers entries; when there are CACHE of them they become the old ones, which stay
    known as long as they are asked for before the next change."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """The keys that are not known; afterwards all others can be read."""
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        out = keys.difference(self)
        back = self.old.keys() & out
        for k in back:
            self[k] = self.old[k]
        return out - back


def pieces_of(batches: Iterator[pd.DataFrame], path: str, capacity: int) -> Iterator[pd.DataFrame]:
    ids = Ids(path)
    end = b"\x00\x00\x00\x00"
    for batch in batches:
        rows: list[tuple] = []
        for lo in range(0, len(batch), 1024):
            some = batch.iloc[lo : lo + 1024]
            for doc, data in zip(some["doc_id"], ids.batch([x if isinstance(x, str) else None for x in some["text"]]), strict=True):
                data += end
                n = len(data) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    rows.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["doc_id"]], dtype="Int64")
        yield out


def plan(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> list[tuple[int, list[tuple[int, int]]]]:
    """Vector best-fit decreasing over {length: pieces}: [(bins, [(length, pieces in each), ...]), ...]."""
    cap, w = np.array(capacity, dtype=float), np.array(weights, dtype=float)
    state = np.zeros((0, 3))  # residual capacities of each group of bins
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def fits(residual: np.ndarray, item: np.ndarray) -> int:
        return int(np.min(residual // item))

    for length in sorted(counts, reverse=True):
        left, item = counts[length], np.array([length, 1.0, float(length) ** 2])
        while left:
            fit = (state >= item).all(axis=1) if len(groups) else np.zeros(0, dtype=bool)
            if not fit.any():
                each = max(1, fits(cap, item))  # a fresh bin takes like pieces until it is full
                full, rest = divmod(left, each)
                new = [(full, each)] * (full > 0) + [(1, rest)] * (rest > 0)
                for bins, k in new:
                    groups.append((bins, [(length, k)]))
                    state = np.vstack([state, cap - k * item])
                left = 0
                break
            norm = (w * ((state - item) / cap) ** 2).sum(axis=1)
            norm[~fit] = np.inf
            at = int(np.argmin(norm))
            bins, inside = groups[at]
            each = fits(state[at], item)
            full, rest = divmod(min(left, bins * each), each)
            parts = [(full, each)] * (full > 0) + [(1, rest)] * (rest > 0)
            parts += [(bins - full - (rest > 0), 0)] * (bins > full + (rest > 0))
            left -= full * each + rest
            residual = state[at].copy()
            keep = [(b, k, residual - k * item) for b, k in parts]
            groups.pop(at)
            state = np.delete(state, at, axis=0)
            for b, k, r in keep:
                content = [*inside, (length, k)] if k else inside
                if r[0] >= 1 and r[1] >= 1 and r[2] >= 1:
                    groups.append((b, content))
                    state = np.vstack([state, r])
                else:
                    done.append((b, content))
    return done + groups


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """For each length, runs of ranks: (length, first rank, first sequence, pieces in each, offset), sorted."""
    rows, seen, sequence = [], {}, 0
    for n, inside in bins:
        offset = 0
        for length, each in inside:
            rank = seen.get(length, 0)
            rows.append((length, rank, sequence, each, offset))
            seen[length] = rank + n * each
            offset += length * each
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def _placed(batches: Iterator[pd.DataFrame], runs: pd.DataFrame) -> Iterator[pd.DataFrame]:
    keys = runs["length"].to_numpy() * (1 << 44) + runs["rank"].to_numpy()
    first, sequence, each, offset = (runs[c].to_numpy() for c in ("rank", "sequence", "each", "offset"))
    for b in batches:
        if not len(b):
            continue
        length, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
        at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
        inside = rank - first[at]
        b["sequence_id"] = sequence[at] + inside // each[at]
        b["offset"] = offset[at] + inside % each[at] * length
        yield b.drop(columns="_rank")


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> DataFrame:
    """docs (doc_id, text) -> PIECES, sequence_id, offset. max_docs and max_attention (sum of
    squared lengths in a sequence) default to values that bind no more than the tokens do."""
    pieces = cut(docs.select("doc_id", "text").mapInPandas(partial(pieces_of, path=tokenizer, capacity=capacity), PIECES))
    found = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    limits = (capacity, max_docs or capacity, max_attention or capacity**2)
    runs = places(plan(found, limits, weights))
    n = sum(found.values())
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "piece", "ids_crc32")
    ranked = pieces.withColumn("_h", key).withColumn("_b", F.pmod("_h", F.lit(fine_buckets(n))).cast("int")).withColumn("_one", F.lit(1))
    ranked = before_sum(ranked, ["length"], ["_b"], ["_h"], "_one", "_rank").drop("_h", "_b", "_one")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return ranked.mapInPandas(partial(_placed, runs=runs), f"{PIECES}, sequence_id bigint, offset bigint")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe())
