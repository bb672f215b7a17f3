"""The trie of conversations against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfield.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((-1 << 70 if t is None else t, r or "", x or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(who) - 1) * len(n[-1][1].encode().split()) if n else 0
    return [
        (who[0], len(n), members[n[:-1]][0] if n else None, len(who), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, who in members.items()
    ]


def corpus():
    rnd = random.Random(6)
    say = [f"say {i} " * (i % 4) for i in range(6)]
    rows = []
    for c in rnd.sample(range(400), 200):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t, ("user", "assistant")[t % 2], say[0] if t < 2 else rnd.choice(say)))
    long = [(500, t, "user", f"turn {t}") for t in range(60)]
    rows += long + [(c, t, r, x) for c in (501, 503, 507) for _, t, r, x in long[: c - 470]]
    for c in range(600, 650):  # equal conversations
        rows += [(c, 0, "user", "hello"), (c, 1, "assistant", "hello you")]
    rows += [(700, None, None, None), (700, 0, "user", None), (701, 3, "", ""), (702, 1, "a", "x"), (702, 1, "a", "x"), (702, None, "b", "before"), (703, 5, "user", "w " * 30_000)]
    return rows + [(None, 0, "user", "of nobody"), (None, 1, "user", "of nobody")]


@pytest.mark.parametrize("most", [1 << 14, 5])
def test_against_a_plain_trie(spark, most):
    """most = 5: components are split by the distributed rounds."""
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("conv", "depth", "key", "parent", "words")]).repartition(4)
    got = [tuple(r[c] for c in NAMES) for r in trie.trie(*trie.rebuilt(trie.turns_of(table)), most=most).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_split_of_random_trees():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 400):
        parent = np.array([-1, *[int(rnd.integers(max(0, i - 5), i)) for i in range(1, n)]])
        depth = np.zeros(n, np.int64)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        order = np.argsort(depth, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        parent = np.array([-1 if parent[i] < 0 else place[parent[i]] for i in order])
        values, weight = rnd.integers(-5, 9, (n, 2)), rnd.integers(1, 5, n)
        want, below = values.copy(), weight.copy()
        for i in reversed(range(1, n)):
            want[parent[i]] += want[i]
            below[parent[i]] += below[i]
        assert (trie.split(parent, np.zeros(n, np.int64), below, depth[order], values) == want).all()


def test_empty_table(spark):
    assert trie.trie(*trie.rebuilt(trie.turns_of(spark.createDataFrame([], SCHEMA)))).count() == 0
