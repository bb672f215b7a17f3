"""The manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ringfield.llm import manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))


def tree(nodes):
    """The root, and for each node its path of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k - k % 3
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 3])))
        nodes, at = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [k // 3 for k in at]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    out, subroots = [], []
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], leaf(r)))
        subroots.append(tree([leaf(r) for r in groups[s]]))
    root, tops = tree([t for t, _ in subroots])
    for s, (subroot, paths), top in zip(names, subroots, tops):
        for r, path in zip(groups[s], paths):
            path = path + top
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            d = leaf({**r, "text": r["text"].replace("\n", "")} if changed else r)
            for a, b in path:
                d = digest(a, d, b)
            out.append((r["doc_id"], leaf(r), subroot, root, digest(*(a + b for a, b in path)), d, d == root))
    return out


def corpus():
    rnd = random.Random(4)
    rows = [(i, f"line {i}\nnext {rnd.random()}", "en", "hot", 5) for i in rnd.sample(range(-3000, 200_000), 1500)]
    rows += [(rnd.getrandbits(64) - (1 << 63), "x\n" * rnd.randint(0, 3), None, rnd.choice(["a", "é", "Z", "", None]), rnd.randint(0, 9)) for _ in range(200)]
    rows += [(7 + 64 * i, None, "de", f"one {i}", None) for i in range(40)]
    rows += [(5, "same\nrow", "en", "a", 1)] * 70 + [(5, "same id, other text", "en", "a", 1), (6, "behind", "en", "a", 1)]
    rows += [(None, "no id", "en", "a", 1), (None, "no id\n", "en", None, 1), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [((1 << 63) - 1, "", "en", "a", 1), (-(1 << 63), "", "en", "a", 1), (63, "last bit", "en", "a", 1), (99, "long\n" * 50_000, "en", "a", 1)]
    rnd.shuffle(rows)
    return rows


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("tree", "pos", "word", "row", "n", "tampered")]).repartition(3)


@pytest.mark.parametrize("levels", [6, 1])
def test_against_a_plain_tree(spark, levels):
    """levels = 1: many passes. Rows that share source and id differ in their paths only."""
    rows = [r for r in corpus() if levels == 6 or r[0] is None or r[0] % 5 == 0 or r[3] == "a"]
    want = expected([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = [tuple(r[c] for c in names) for r in manifest.checked(table_of(spark, rows), levels).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_lone_leaf_and_empty_table(spark):
    row = (3, "a\nb", "en", None, 3)
    (got,) = manifest.checked(table_of(spark, [row])).collect()
    want = leaf({"doc_id": 3, "text": "a\nb", "lang": "en", "source": None, "n_chars": 3})
    assert got["leaf"] == got["subroot"] == got["root"] == want and got["proof_sha256"] == digest("")
    assert manifest.checked(table_of(spark, [])).count() == 0
