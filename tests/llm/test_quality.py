"""Features by brute force, the model against numpy and a known truth."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ringfield.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def expected(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {i + k for i in places for k in range(3)}
    ended = sum(x[-1] in ".!?,;:" for x in w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), sum(any(c.isalpha() for c in x) for x in w), len(set(w)), ended, len(lines))


def test_features(spark):
    rnd = random.Random(1)
    pool = ["word", "a,", "b.", "|", "$$$", "12", "1a", "É.", "ß;", "x\t", "\n", " \n ", "-", "漢字", "end!"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 80))) for _ in range(120)]
    texts += [None, "", " ", "\n\n", "-" * 200_000, "a" * 100_000 + ".", "same line\n" * 3000, "one"]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).withColumn("n_lines", F.lit("x"))
    got = {r["doc_id"]: tuple(r[c] for c in quality.FEATURES) for r in quality.features(table).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def generated(n, seed):
    """Votes of rules of known accuracy, the last of which says nothing."""
    rnd = np.random.default_rng(seed)
    truth = rnd.random(n) < 0.8
    rates = [(0.97, 0.10), (0.95, 0.30), (0.90, 0.20), (0.99, 0.55), (0.93, 0.40), (0.90, 0.90)]
    votes = np.stack([np.where(rnd.random(n) < np.where(truth, g, b), 1, -1) * (rnd.random(n) < 0.9) for g, b in rates], axis=1)
    return truth, rates, votes


def patterns(votes):
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    return [(tuple(map(int, r)), int(c)) for r, c in zip(rows, counts)]


def test_accuracies_are_recovered():
    truth, rates, votes = generated(40_000, 5)
    share, theta = quality.fit(patterns(votes))
    assert abs(share - truth.mean()) < 0.02
    for (g, b), (tg, tb) in zip(rates, theta):
        assert abs(g - tg) < 0.02 and abs(b - tb) < 0.04
    kept = np.array([quality.posterior(tuple(v), share, theta) >= 0.5 for v in votes.tolist()])
    assert (kept == truth).mean() > 0.95 > ((votes >= 0).all(1) == truth).mean()


def test_votes_are_weighed():
    """A bad vote of the rule that says nothing is outvoted; weak ones add up."""
    share, theta = quality.fit(patterns(generated(40_000, 6)[2]))
    p = lambda *v: quality.posterior(v, share, theta)
    assert p(1, 1, 1, 1, 1, -1) > 0.9 and p(1, 1, -1, 1, 1, 1) > 0.5 and p(1, -1, 1, 1, 1, 1) > 0.5
    assert p(1, -1, -1, 1, -1, 1) < 0.5


def test_verdicts_against_a_second_implementation(spark):
    """kept, by EM over single documents in numpy."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 7))) for _ in range(400)]
    clean = lambda: " ".join(rnd.choice(words) + ("." if rnd.random() < 0.15 else "") for _ in range(rnd.randint(60, 150)))
    texts = [clean() for _ in range(150)] + ["\n".join([clean()] + ["more of it here."] * 9) for _ in range(12)]
    texts += [" ".join(rnd.choice(words) + "$$$" for _ in range(90)) for _ in range(15)] + [" | ".join(rnd.choice(words) for _ in range(60)) for _ in range(10)] + ["short"] * 5
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)).collect()}
    rule = quality.rules()
    table = spark.createDataFrame([(i, *expected(t)) for i, t in enumerate(texts)], "doc_id bigint, " + ", ".join(f"{c} bigint" for c in quality.FEATURES))
    rows = table.select("doc_id", *[rule[r].alias(r) for r in quality.RULES]).orderBy("doc_id").collect()
    use = [i for i, t in enumerate(texts) if expected(t)[0] >= 50 and 2 * expected(t)[4] <= expected(t)[0]]
    v = np.array([rows[i][1:] for i in use], float)
    share, theta = 0.9, np.tile([0.98, 0.5], (v.shape[1], 1))
    for _ in range(200):
        like = [np.where(v == 1, theta[:, s], np.where(v == -1, 1 - theta[:, s], 1.0)).prod(1) for s in (0, 1)]
        p = share * like[0] / (share * like[0] + (1 - share) * like[1])
        share = (p.sum() + 4.5) / (len(p) + 5.0)
        theta = np.stack([((q[:, None] * (v == 1)).sum(0) + 5.0 * prior) / ((q[:, None] * (v != 0)).sum(0) + 5.0) for q, prior in ((p, 0.98), (1 - p, 0.5))], axis=1)
    like = [np.where(v == 1, theta[:, s], np.where(v == -1, 1 - theta[:, s], 1.0)).prod(1) for s in (0, 1)]
    want = dict(zip(use, share * like[0] / (share * like[0] + (1 - share) * like[1])))
    for i, t in enumerate(texts):
        assert got[i]["base_failed"] == (i not in want) and got[i]["kept"] == (want.get(i, 0) >= 0.5)
        assert i not in want or math.isclose(got[i]["quality"], want[i], abs_tol=1e-9)
    blamed = [i for i in use if min(rows[i][1:]) < 0]
    assert any(got[i]["kept"] for i in blamed) and not any(got[i]["kept"] for i in range(162, 187))
    assert all(got[i]["kept"] for i in range(162) if i in want)


def test_nulls_in_any_column_and_empty_tables(spark):
    rows = [(None, "w " * 60, None, None, None), (1, None, None, None, None), (1, None, None, None, None)]
    got = quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and sum(r["n_words"] == 60 for r in got) == 1 and not any(r["kept"] for r in got)
    assert quality.judged(spark.createDataFrame([], SCHEMA)).count() == 0
