"""Suffix-array dedup with column-wise construction of a collection's BWT.

Every byte that a 50-byte string covers is removed if the string also starts in a document with
a smaller id. Equal strings are found in three steps.

1. Anchors. Each 50-byte window has a minimiser, the 26-byte string in it whose hash is least;
   equal windows have equal minimisers at equal places. Runs of windows with one minimiser form
   a segment of 50 to 74 bytes. Minimisers that only one document has are dropped; all others
   stay, so no equal windows are lost. Minimisers with more than CROWD places are crowded: their
   windows go one by one, each under its own hash, so that nothing gathers around such an anchor.
2. Segments with the same minimiser meet in one bucket, equal ones as one with its smallest
   document id, summed in each chunk of the corpus before they are sent. In the bucket segments
   are told apart by their bytes; a hash only brings equal ones side by side.
3. In a bucket, minimisers with several different segments form collections of what their
   segments may share (windows whose hash is not the only one of its value). A collection's
   Burrows-Wheeler transform and longest common prefixes are built column by column: each round
   puts one more symbol, from the right, in front of every segment; the suffixes of the round
   are put in place by the stable order of the transform's symbols, and a common prefix is one
   more than the least in the range between its neighbours. Transform and prefixes are read
   from and written to files of the task's own, front to back. Suffixes with common prefixes of
   50 are equal windows; the smallest document id of each group goes back to the chunks.

Defined results: null and empty texts have no bytes and lose nothing; texts under 50 bytes lose
nothing; rows of one id do not remove each other; a null id counts as larger than all others; an
empty table gives an empty result; other columns are ignored. Inside a chunk a hash of 64 bits names a
segment; in a bucket segments are compared byte by byte, and their windows through the transform.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from functools import partial

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.llm.chunks import MAX_ID, bucket_slices, packed_keys, plan_sizes, unpacked_keys
from ringfield.llm.common import bucketed, released, stored
from ringfield.llm.neardup import mix

LENGTH, K = 50, 26
W = LENGTH - K + 1
LONGEST = LENGTH + W - 1
BLOCK = 1 << 19
COLLECTION = 6_000  # segments whose transform is built at a time
CROWD = 20_000
SLAB = 4 << 20  # bytes of segments compared at a time

FILTER = np.uint64(0xFFFFFFFFFFFF0000)  # 48 bits tell anchors apart well enough to drop those of one document

CHUNK = "chunk bigint, ids binary, sizes binary, body binary"
ASK = "bucket int, chunk bigint, body binary"
BACK = "chunk bigint, bucket int, body binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans binary"

_R = np.random.default_rng(50)
_BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))))


_UP = _powers(_BASE, 64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed body: count, lengths in bytes, then the bytes."""
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpacked(body: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _chunked(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Documents of about `size` bytes together, as the task reads them."""
    part, k = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []

    def row():
        nonlocal k, ids, texts
        k += 1
        lens = np.array([len(t) for t in texts], np.int64)
        out = pd.DataFrame([(part << 32 | k, np.array(ids, np.int64).tobytes(), lens.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))], columns=["chunk", "ids", "sizes", "body"])
        ids, texts = [], []
        return out

    held = 0
    for b in batches:
        for d, t in zip(b["doc_id"], b["text"], strict=True):
            ids.append(MAX_ID if pd.isna(d) else int(d))
            texts.append(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"")
            held += len(texts[-1]) + 64
            if held >= size:
                yield row()
                held = 0
    if ids:
        yield row()


class Chunk:
    def __init__(self, row: pd.Series):
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
        self.ends = np.cumsum(self.sizes)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of places where windows begin, of BLOCK bytes, so that a text of any length is worked on in parts."""
        for lo in range(0, len(self.data), BLOCK):
            yield lo, min(lo + BLOCK, len(self.data))

    def runs(self, lo: int, hi: int, spans: bool) -> tuple[np.ndarray, ...]:
        """Of the windows that begin from lo to hi: each segment's start, windows, anchor's place in it, anchor key, hash (if spans), document."""
        x = self.data[lo : hi + LENGTH - 1]
        n = len(x)
        nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
        if n < LENGTH:
            return nothing
        powers = doubled(_BYTE[x], spans)
        h = window_hash(powers, K)
        order = mix(h)
        v = (order & ~np.uint64((1 << 28) - 1)) | np.arange(len(h), dtype=np.uint64)
        m = v
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: len(m) - (W - 16)], m[W - 16 :])
        at = (m & np.uint64((1 << 28) - 1)).astype(np.int64)
        first, last = np.searchsorted(self.ends, (lo, lo + n - 1), side="right")
        edges = np.clip(np.r_[lo, self.ends[first : last + 1]], lo, lo + n)
        doc = np.repeat(np.arange(first, last + 1), np.diff(edges))
        ok = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
        if not len(ok):
            return nothing
        a = at[ok]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)])
        count = np.diff(np.r_[first, len(ok)])
        s, anchor = ok[first], a[first]
        key = mix(order[anchor])  # minimisers are the small hashes; their keys are even
        return lo + s, count, anchor - s, key, span_hash(powers, s, s + count - 1 + LENGTH) if spans else key, doc[s]


def doubled(value: np.ndarray, spans: bool = True) -> dict[int, np.ndarray]:
    """Hashes of all windows of 1, 2, 4, 8, 16 and, for spans, 32 values."""
    with np.errstate(over="ignore"):
        powers, w = {1: value}, 1
        while w < (32 if spans else 16) and len(value) > w:
            powers[2 * w] = powers[w][:-w] * _UP[w] + powers[w][w:]
            w *= 2
        return powers


def window_hash(powers: dict[int, np.ndarray], k: int) -> np.ndarray:
    """Of all windows of k values: those of the powers of two that add up to k, in falling order."""
    with np.errstate(over="ignore"):
        n, out, have = len(powers[1]), None, 0
        for w in (32, 16, 8, 4, 2, 1):
            if k & w:
                part = powers[w][have : n - k + have + 1]
                out = part if out is None else out * _UP[w] + part
                have += w
        return out


def span_hash(powers: dict[int, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of spans of LENGTH to LONGEST values: from their first and last LENGTH values and the length."""
    h = window_hash(powers, LENGTH)
    return mix(h[start] * _BASE + mix(h[end - LENGTH])) + (end - start).astype(np.uint64)


def text_hash(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """span_hash of texts that follow each other, some megabytes at a time."""
    out = np.empty(len(sizes), np.uint64)
    for lo in range(0, len(sizes), 20_000):
        hi = min(lo + 20_000, len(sizes))
        base, end = begins[lo], begins[hi - 1] + sizes[hi - 1]
        at = begins[lo:hi] - base
        out[lo:hi] = span_hash(doubled(_BYTE[text[base:end]]), at, at + sizes[lo:hi])
    return out


def _anchors(key, pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Per bucket the chunk's distinct anchor keys, whether more than one document has them, and their number of places."""
    c = Chunk(pdf.iloc[0])
    keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in c.blocks():
        r = c.runs(lo, hi, spans=False)
        keys.append(r[3] & FILTER)
        docs.append(c.ids[r[5]])
    k, d = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(k, kind="stable")
    k, d = k[order], d[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    many, places = np.zeros(len(first), np.uint8), np.minimum(np.diff(np.r_[first, len(k)]), 65535).astype(np.uint16)
    if len(first):
        many = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)).astype(np.uint8)
    k = k[first]
    rows = []
    for b, lo, hi in bucket_slices(k, buckets):
        body = zstandard.ZstdCompressor(level=1).compress(packed_keys(k[lo:hi]) + places[lo:hi].tobytes() + np.packbits(many[lo:hi]).tobytes())
        rows.append((b, int(key[0]), np.int64(hi - lo).tobytes() + body))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "body"])


def _repeated(key, pdf: pd.DataFrame, crowd_over: int) -> pd.DataFrame:
    """Per chunk two bits for each of its keys: whether several documents of the corpus have it, and whether it is crowded."""
    ks, many, places = [], [], []
    for body in pdf["body"]:
        n = int(np.frombuffer(body[:8], np.int64)[0])
        raw = zstandard.ZstdDecompressor().decompress(body[8:])
        ks.append(unpacked_keys(raw[: 8 * n]))
        places.append(np.frombuffer(raw, np.uint16, n, 8 * n))
        many.append(np.unpackbits(np.frombuffer(raw[10 * n :], np.uint8), count=n))
    k = np.concatenate(ks)
    _, back, count = np.unique(k, return_inverse=True, return_counts=True)
    flag = np.bincount(back, weights=np.concatenate(many), minlength=len(count)) + count >= 2
    crowd = np.bincount(back, weights=np.concatenate(places), minlength=len(count)) > crowd_over
    flag, crowd, at, rows = flag[back], crowd[back], 0, []
    for chunk, x in zip(pdf["chunk"], ks, strict=True):
        part = slice(at, at + len(x))
        rows.append((chunk, int(key[0]), np.packbits(flag[part]).tobytes() + np.packbits(crowd[part]).tobytes()))
        at += len(x)
    return pd.DataFrame(rows, columns=["chunk", "bucket", "body"])


def windows_of(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The single windows of segments: segment, start, hash."""
    owner = np.repeat(np.arange(len(start)), count)
    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    h = np.empty(len(at), np.uint64)
    size = np.full(20_000, LENGTH)
    for lo in range(0, len(at), len(size)):
        some = at[lo : lo + len(size)]
        text = data[some[:, None] + np.arange(LENGTH)].ravel()
        h[lo : lo + len(some)] = text_hash(text, np.arange(len(some)) * LENGTH, size[: len(some)])
    return owner, at, h


def _segments(key, left: pd.DataFrame, right: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Requests by bucket: the chunk's distinct segments of repeated anchors, with their smallest
    document; and, in bucket -1, where these segments lie."""
    if not len(left):
        return pd.DataFrame({"bucket": [], "chunk": [], "body": []})
    c = Chunk(left.iloc[0])
    found = [c.runs(lo, hi, spans=True) for lo, hi in c.blocks()]
    start, count, _, k, h, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    unique = np.unique(k & FILTER)
    flag, crowd = np.zeros(len(unique), bool), np.zeros(len(unique), bool)
    replies = dict(zip(right["bucket"], right["body"], strict=True)) if len(right) else {}
    for b, lo, hi in bucket_slices(unique, buckets):
        bits = np.frombuffer(replies[b], np.uint8).reshape(2, -1)
        flag[lo:hi], crowd[lo:hi] = (np.unpackbits(x, count=hi - lo) for x in bits)
    place = np.searchsorted(unique, k & FILTER)
    keep, single = np.flatnonzero(flag[place] & ~crowd[place]), np.flatnonzero(flag[place] & crowd[place])
    owner, at, alone = windows_of(c.data, start[single], count[single])
    k, h = np.r_[k[keep], mix(alone)], np.r_[h[keep], alone]
    start, count, doc = np.r_[start[keep], at], np.r_[count[keep], np.ones(len(at), np.int64)], np.r_[doc[keep], doc[single][owner]]
    order = np.argsort(start, kind="stable")
    start, count, k, h, doc = (x[order] for x in (start, count, k, h, doc))
    order = np.lexsort((h, k))
    fresh = np.r_[True, (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])] if len(k) else np.zeros(0, bool)
    begins = np.flatnonzero(fresh)
    low = np.minimum.reduceat(c.ids[doc][order], begins) if len(begins) else np.zeros(0, np.int64)
    first = order[begins]
    index = np.empty(len(k), np.int32)
    index[order] = np.cumsum(fresh) - 1
    rows, numbers = [], np.zeros(buckets, np.int64)
    uk, us, uc = k[first], start[first], count[first]
    for b, lo, hi in bucket_slices(uk, buckets):
        length = uc[lo:hi] + LENGTH - 1
        ends = np.cumsum(length)
        text = c.data[np.repeat(us[lo:hi] - (ends - length), length) + np.arange(ends[-1])]
        numbers[b] = hi - lo
        rows.append((b, int(key[0]), packed(np.frombuffer(packed_keys(uk[lo:hi]), np.uint8), uc[lo:hi].astype(np.uint8), low[lo:hi], text)))
    # where the segments lie: they run in the order of the text, so their distances are small
    rows.append((-1, int(key[0]), packed(np.diff(start, prepend=0).astype(np.int32), index, numbers, uc.astype(np.uint8))))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "body"])


def transform(segments: np.ndarray, sizes: np.ndarray, reach: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Collection BWT and LCP, column by column. segments: a row of bytes each, aligned right.
    Returns the sorted suffixes' segment, length and common prefix with the suffix before.
    Common prefixes that cannot grow to `reach` in the rounds left are bounded, not exact."""
    m, width = segments.shape
    rounds = int(sizes.max())
    flat, start = segments.ravel(), (np.arange(m) * width).astype(np.int32)
    with ExitStack() as stack:
        files = {x: stack.enter_context(tempfile.TemporaryFile(prefix="bwt-", buffering=0)) for x in ("bwt", "lcp", "who", "len")}
        written = dict.fromkeys(files, 0)

        def write(**arrays: np.ndarray) -> None:
            """Front to back over what the round before has written; a column never has fewer suffixes than the one before."""
            for x, a in arrays.items():
                files[x].seek(0)
                a.tofile(files[x])
                written[x] = len(a)

        def read(x: str, kind: type) -> np.ndarray:
            files[x].seek(0)
            return np.fromfile(files[x], kind, written[x])

        def ahead(who: np.ndarray, length: np.ndarray) -> np.ndarray:
            """The symbol before each suffix, plus one (no UTF-8 text has the byte 255); 0 at a segment's start."""
            c = flat[np.maximum(start[who] + (width - 1) - length, 0)] + np.uint8(1)
            c[length >= sizes[who]] = 0
            return c

        every, none = np.arange(m, dtype=np.int32), np.zeros(m, np.uint8)
        write(bwt=ahead(every, none), lcp=none, who=every, len=none)
        for left in range(rounds - 1, -1, -1):
            bwt, lcp = read("bwt", np.uint8), read("lcp", np.uint8)
            order = np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt) :]  # segments that have begun bring nothing new
            c = bwt[order]
            new = np.zeros(len(order), np.uint8)
            same = np.flatnonzero(c[1:] == c[:-1])
            before, after = order[same], order[same + 1]
            low = np.minimum(lcp[before + 1], lcp[after])
            wide = np.flatnonzero((after - before > 2) & (low > 0) & (low.astype(np.int16) + 1 + left >= reach))
            if len(wide):
                low[wide] = least(lcp, before[wide] + 1, after[wide])
            new[same + 1] = np.minimum(low, 254) + 1
            who = np.concatenate((every, read("who", np.int32)[order]))
            length = np.concatenate((none, read("len", np.uint8)[order] + np.uint8(1)))
            write(bwt=ahead(who, length), lcp=np.concatenate((none, new)), who=who, len=length)
        return read("who", np.int32), read("len", np.uint8), read("lcp", np.uint8)


def least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi+1]) for many ranges, from minima over powers of two."""
    out = np.empty(len(lo), x.dtype)
    level = (np.frexp((hi - lo + 1).astype(np.float64))[1] - 1).astype(np.uint8)
    order = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    table, width = x, 1
    for k in range(len(ends) - 1):
        if k:
            table = np.minimum(table[:-width], table[width:])
            width *= 2
        at = order[ends[k] : ends[k + 1]]
        out[at] = np.minimum(table[lo[at]], table[hi[at] - width + 1])
    return out


def lowest(text: np.ndarray, windows: np.ndarray, low: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For distinct segments the smallest document of each of their windows; group: by anchor, ascending.
    Segments with an anchor of their own need no comparing."""
    sizes = windows.astype(np.int64) + LENGTH - 1
    ends, first = np.cumsum(sizes), np.cumsum(windows.astype(np.int64)) - windows
    out = np.repeat(low, windows)
    many = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    begin, windows = narrowed(text, (ends - sizes)[many], windows[many].astype(np.int64))
    some = np.flatnonzero(windows)
    many, begin, windows = many[some], begin[some], windows[some]
    place = first[many] + begin - (ends - sizes)[many]  # of each segment's first window in out
    sizes, at = windows + LENGTH - 1, 0
    while at < len(many):
        to = min(at + COLLECTION, len(many))
        while to < len(many) and group[many[to]] == group[many[to - 1]]:
            to += 1
        part = slice(at, to)
        at = to
        n, width = sizes[part], int(sizes[part].max())
        rows = np.zeros((len(n), width), np.uint8)
        column = np.arange(width)[None, :] - (width - n)[:, None]
        inside = column >= 0
        rows[inside] = text[(begin[part][:, None] + column)[inside]]
        who, length, lcp = transform(rows, n, LENGTH)
        long = np.flatnonzero(length >= LENGTH)
        # a suffix of 50 or more bytes that follows another one with 50 common bytes is in its group;
        # no shorter suffix stands between two that share 50
        start = np.flatnonzero(np.r_[True, (lcp[long][1:] < LENGTH) | (long[1:] != long[:-1] + 1)])
        best = np.minimum.reduceat(low[many[part]][who[long]], start)
        best = np.repeat(best, np.diff(np.r_[start, len(long)]))
        out[place[part][who[long]] + n[who[long]] - length[long]] = best
    return out


def narrowed(text: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment cut down to the windows from the first to the last whose hash occurs in
    another window too; none, if there are none. A window with a hash of its own has no equal."""
    ends = np.cumsum(windows)
    hashes = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for lo in range(0, len(begin), 10_000):
        hi = min(lo + 10_000, len(begin))
        w = windows[lo:hi]
        # only these segments' bytes, side by side: what lies between them may be much more
        size = w + LENGTH - 1
        ahead = np.cumsum(size) - size
        some = text[np.repeat(begin[lo:hi] - ahead, size) + np.arange(int(size.sum()))]
        step = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        hashes[ends[lo] - windows[lo] : ends[hi - 1]] = window_hash(doubled(_BYTE[some]), LENGTH)[np.repeat(ahead, w) + step]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(len(hashes), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.flatnonzero(again)
    owner = np.searchsorted(ends, hit, side="right")
    step = hit - (ends - windows)[owner]
    lo, hi = np.full(len(begin), 1 << 30), np.full(len(begin), -1)
    np.minimum.at(lo, owner, step)
    np.maximum.at(hi, owner, step)
    some = hi >= 0
    return begin + np.where(some, lo, 0), np.where(some, hi - lo + 1, 0)


def gathered(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spans of a text, side by side."""
    ahead = np.cumsum(size) - size
    return text[np.repeat(begin - ahead, size) + np.arange(int(size.sum()))]


def distinct_texts(text: np.ndarray, begin: np.ndarray, size: np.ndarray, k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each text: equal where key and bytes are; h brings equal texts side by side."""
    order = np.lexsort((size, h, k))
    a, b = order[:-1], order[1:]
    same = (k[a] == k[b]) & (h[a] == h[b]) & (size[a] == size[b])
    hit = np.flatnonzero(same)
    if len(hit):
        n = size[a[hit]]
        equal = gathered(text, begin[a[hit]], n) == gathered(text, begin[b[hit]], n)
        same[hit] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(np.r_[True, ~same]) - 1
    return out


def _compared(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk the smallest document of each window of its segments in this bucket; the segments
    of some anchors at a time, so that memory depends on SLAB and CROWD."""
    parts = [unpacked(b, np.uint8, np.uint8, np.int64, np.uint8) for b in pdf["body"]]
    windows, low, text = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    k = np.concatenate([unpacked_keys(p[0].tobytes()) for p in parts])
    lengths = [len(p[1]) for p in parts]
    del parts
    windows = windows.astype(np.int64)
    sizes = windows + LENGTH - 1
    begins, firsts = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    order = np.argsort(k, kind="stable")
    ends, lo = np.cumsum(sizes[order]), 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLAB, side="right")))
        while hi < len(order) and k[order[hi]] == k[order[hi - 1]]:
            hi += 1
        rows = order[lo:hi]
        lo = hi
        n, w = sizes[rows], windows[rows]
        some = gathered(text, begins[rows], n)
        at = np.cumsum(n) - n
        number = distinct_texts(some, at, n, k[rows], text_hash(some, at, n))
        by = np.argsort(number, kind="stable")
        first = np.flatnonzero(np.r_[True, number[by][1:] != number[by][:-1]])
        one = by[first]
        d_low, dk = np.minimum.reduceat(low[rows][by], first), k[rows][one]
        best = lowest(gathered(some, at[one], n[one]), w[one], d_low, np.cumsum(np.r_[True, dk[1:] != dk[:-1]]) - 1)
        d_first = np.cumsum(w[one]) - w[one]
        step = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        out[np.repeat(firsts[rows], w) + step] = best[np.repeat(d_first[number], w) + step]
    answers, at = [], 0
    for chunk, n in zip(pdf["chunk"], lengths, strict=True):
        to = firsts[at + n - 1] + windows[at + n - 1]
        answers.append((chunk, int(key[0]), packed(out[firsts[at] : to])))
        at += n
    return pd.DataFrame(answers, columns=["chunk", "bucket", "body"])


def _removed(key, left: pd.DataFrame, right: pd.DataFrame, buckets: int) -> pd.DataFrame:
    if not len(left):
        return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
    c = Chunk(left.iloc[0])
    replies = dict(zip(right["bucket"], right["body"], strict=True))
    start, index, numbers, uc = unpacked(replies[-1], np.int32, np.int32, np.int64, np.uint8)
    start, uc = np.cumsum(start.astype(np.int64)), uc.astype(np.int64)
    doc = np.searchsorted(c.ends, start, side="right")
    low = [np.zeros(0, np.int64)] + [unpacked(replies[b], np.int64)[0] for b in np.flatnonzero(numbers).tolist()]
    low, first = np.concatenate(low), np.cumsum(uc) - uc
    change = np.zeros(len(c.data) + 1, np.int32)
    for i in range(0, len(index), 50_000):
        part = slice(i, i + 50_000)
        w = uc[index[part]]
        step = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        at = np.repeat(start[part], w) + step
        hit = at[low[np.repeat(first[index[part]], w) + step] < np.repeat(c.ids[doc[part]], w)]
        np.add.at(change, hit, 1)
        np.add.at(change, hit + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    rows, data = [], c.data
    for i in range(len(c.ids)):
        lo, hi = int(c.ends[i] - c.sizes[i]), int(c.ends[i])
        g = gone[lo:hi]
        n = int(np.count_nonzero(g))
        edges = np.flatnonzero(np.diff(np.r_[0, g.view(np.int8), 0])) if n else np.zeros(0, np.int64)
        kept = data[lo:hi][~g] if n else data[lo:hi]
        rows.append((None if c.ids[i] == MAX_ID else int(c.ids[i]), hi - lo, n, len(edges) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), edges.astype(np.int64).tobytes()))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def deduped(docs: DataFrame, chunk_bytes: int = 6 << 20, crowd: int = CROWD) -> DataFrame:
    """docs (doc_id, text) -> RESULT; spans: starts and ends of the removed runs, as 64-bit integers."""
    chunk_bytes, buckets = plan_sizes(docs, chunk_bytes)
    chunks = bucketed(docs.select("doc_id", "text").mapInPandas(partial(_chunked, size=chunk_bytes), CHUNK), "chunk", buckets)
    by = lambda f: bound(f, buckets)
    asked = chunks.groupBy("chunk").applyInPandas(by(_anchors), ASK)
    flags = asked.groupBy("bucket").applyInPandas(lambda key, pdf: _repeated(key, pdf, crowd), BACK)
    found = stored(chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(by(_segments), ASK))
    del asked, flags
    released(docs.sparkSession)
    compared = found.where("bucket >= 0").groupBy("bucket").applyInPandas(_compared, BACK)
    back = compared.unionByName(found.where("bucket < 0"))
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(by(_removed), RESULT)


def bound(f, buckets: int):
    """applyInPandas counts a function's parameters: key and one or two frames."""
    if f is _anchors:
        return lambda key, pdf: f(key, pdf, buckets)
    return lambda key, left, right: f(key, left, right, buckets)


def op8_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
