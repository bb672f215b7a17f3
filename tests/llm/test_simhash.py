"""Fingerprints and their links against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ringfield.llm import simhash

SCHEMA = "doc_id bigint, text string"


def print_of(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def joined(prints):
    """{id: smallest id reachable} of {id: fingerprint}."""
    ids, up = sorted(prints), {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus():
    rnd = random.Random(3)
    words = ["W" + "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 400))) for _ in range(60)]
    for i in range(40):  # near copies of one long text
        w = rows[5].split() * 3
        w[7 * i % len(w)] = f"edit{i}"
        rows.append("  \n".join(w))
    return [*rows, rows[0], rows[0].upper(), None, "", " \t", "one", "ONE", "one two", "Äöü ß ẞ", " ".join(words) * 100]


def test_documents_against_brute_force(spark):
    texts = corpus()
    table = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("print", F.lit("x")).withColumn("cell", F.lit(1)).repartition(5)
    found = {r["doc_id"]: r for r in simhash.grouped(table).collect()}
    prints = {i: print_of(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == joined(prints)
    assert len({r["component_id"] for r in found.values()}) < len(texts) - 30


@pytest.mark.parametrize("crowd", [0, 400])
def test_links_lose_no_pair(spark, crowd):
    """Random fingerprints with neighbours at 1 to 4 bits; crowd: many within 3 bits of one."""
    rnd = random.Random(crowd)
    flipped = lambda p, n: p ^ sum(1 << i for i in rnd.sample(range(64), n))
    prints = {rnd.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1, 3, 7, 1 << 63}
    prints |= {flipped(p, rnd.randint(1, 4)) for p in list(prints) for _ in range(2)}
    centre = rnd.getrandbits(64)
    prints |= {flipped(centre, rnd.randint(0, 3)) for _ in range(crowd)}
    as_long = lambda p: p - (1 << 64) if p >> 63 else p
    table = spark.createDataFrame([(as_long(p),) for p in prints], "print bigint")
    got = simhash.links(table).collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in got)
    want = joined({as_long(p): p for p in prints})
    assert joined_by([(r["a"], r["b"]) for r in got], want) == want


def joined_by(pairs, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_points_bound_the_distance():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    b[:1000] = a[:1000] ^ (np.uint64(1) << rnd.integers(0, 64, 1000, dtype=np.uint64))
    nibbles = lambda x: np.stack([(simhash.point(x) >> np.uint64(4 * s)) & np.uint64(15) for s in range(16)]).astype(int)
    apart = np.array([bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b)])
    assert (np.abs(nibbles(a) - nibbles(b)).sum(0) <= apart).all()


def test_rows_without_id_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (9, text), (4, text), (None, "alone here now"), (5, None), (5, None), (None, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.grouped(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 4), (9, 4), (4, 4), (None, None), (5, 5), (5, 5), (None, 5)], key=str)
    assert simhash.grouped(spark.createDataFrame([], SCHEMA)).count() == 0
