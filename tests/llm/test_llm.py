"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated
rows and clashing column names, against brute force."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringfield.llm import chat, linededup, mixing, neardup, neighbours, packing, quality, scoring, sharding, suffixdedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rnd = random.Random(5)
    words = ["w" + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [text(rnd.randint(5, 160)) for _ in range(40)]
    passage = text(60)
    for i in range(6):
        rows.append(text(30) + " " + passage + " " + text(30))
    base = text(200).split()
    for i in range(8):  # near copies
        w = list(base)
        w[10 * i + 3] = f"edit{i}"
        rows.append(" ".join(w))
    rows += [rows[0]] * 5 + [None, "", " \n ", "one", "Äöü ß x " * 20, text(4000), "same same same " * 40]
    rows += ["Licensed under 4.0\n" + text(40) for _ in range(12)]
    rows += [f"page {i} of report\n{text(30)}\nlogin of user {rnd.choice(words)} went well" for i in range(12)]
    out = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", 7) for i, t in enumerate(rows)]
    return out + [(None, "no id at all " * 30, "en", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_scoring(docs, empty):
    found = rows_of(scoring.scored(docs, chunk_bytes=4000, depth=2))
    assert len(found) == len(corpus())
    toks = [(d, (t or "").encode().lower().split() + [b" "]) for d, t, *_ in corpus()]
    train = [t for d, t in toks if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        c1.update(t)
        c2.update(zip(t, t[1:]))
        c3.update(zip(t, t[1:], t[2:]))
    n, v = sum(c1.values()), len(c1)
    unknown = (sum(x == 1 for x in c1.values()) + 1) / (n + 2)
    mu, least, gain = scoring.MU, scoring.LEAST, scoring.GAIN
    p0 = lambda w: (1 - unknown) * c1[w] / n if c1[w] else unknown
    g1, g2 = Counter(), Counter()
    for (a, b), k in c2.items():
        if c1[a] >= least:
            g1[a] += k * math.log((k - 1 + mu * p0(b)) / (c1[a] - 1 + mu) / p0(b))
    p1 = lambda a, b: (c2[a, b] + mu * p0(b)) / (c1[a] + mu) if c1[a] >= least and g1[a] > gain else p0(b)
    for (a, b, w), k in c3.items():
        if c2[a, b] >= least:
            g2[a, b] += k * math.log((k - 1 + mu * p1(b, w)) / (c2[a, b] - 1 + mu) / p1(b, w))
    p2 = lambda a, b, w: (c3[a, b, w] + mu * p1(b, w)) / (c2[a, b] + mu) if c2[a, b] >= least and g2[a, b] > gain else p1(b, w)
    want = {d: sum(math.log10(p0(w) if k == 0 else p1(t[k - 1], w) if k == 1 else p2(t[k - 2], t[k - 1], w)) for k, w in enumerate(t)) for d, t in toks}
    for r in found:
        t = dict(toks)[r["doc_id"]]
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(c1[w] > 0 for w in t) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] == pytest.approx(want[r["doc_id"]])
    assert scoring.scored(empty).count() == 0


@pytest.mark.parametrize("depth", [4, scoring.DEPTH])
def test_scoring_of_deeper_trees(docs, depth):
    """Contexts of up to four words, and as long as the query takes them, by brute force over all of them."""
    found = rows_of(scoring.scored(docs, chunk_bytes=4000, depth=depth))
    toks = [(d, (t or "").encode().lower().split() + [b" "]) for d, t, *_ in corpus()]
    train = [t for d, t in toks if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = [Counter()] + [Counter(x for t in train for x in zip(*[t[i:] for i in range(k)])) for k in range(1, depth + 2)]
    n = sum(c[1].values())
    unknown, mu = (sum(x == 1 for x in c[1].values()) + 1) / (n + 2), scoring.MU
    kept = set()

    def p(context, w):
        if not context:
            return (1 - unknown) * c[1][w,] / n if c[1][w,] else unknown
        below = p(context[1:], w)
        return (c[len(context) + 1][*context, w] + mu * below) / (c[len(context)][context] + mu) if context in kept else below

    for k in range(1, depth + 1):
        gains = Counter()
        for x, m in c[k + 1].items():
            if c[k][x[:-1]] >= scoring.LEAST:
                below = p(x[1:-1], x[-1])
                gains[x[:-1]] += m * math.log((m - 1 + mu * below) / (c[k][x[:-1]] - 1 + mu) / below)
        kept |= {x for x, g in gains.items() if g > scoring.GAIN}
    assert any(len(x) >= 4 for x in kept)
    for r in found:
        t = dict(toks)[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(t[max(0, i - depth) : i]), w)) for i, w in enumerate(t)))


def test_states_of_scoring_stay_small(docs, monkeypatch):
    """What a round stores is little more than the texts as places of words."""
    sizes, bucketed = [], scoring.bucketed

    def measured(*args):
        table = bucketed(*args)
        sizes.append(table.agg(F.sum(F.length("body"))).first()[0])
        return table

    monkeypatch.setattr(scoring, "bucketed", measured)
    assert scoring.scored(docs, depth=3).count() == len(corpus())
    assert len(sizes) > 4 and max(sizes) < 1.5 * sizes[0]


def played(rows, monkeypatch, chunk_bytes, depth, buckets=3):
    """The rounds of scoring without Spark: (rows of the result, bytes and keys of all requests)."""
    monkeypatch.setattr(scoring, "TaskContext", type("Here", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    columns = lambda schema: [c.split()[0] for c in schema.split(", ")]
    given = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    states, totals, size, keys = [s for d in scoring._encoded(iter([given]), chunk_bytes) for s in d.to_dict("records")], None, 0, 0
    while totals is None or any(s["waiting"] for s in states):
        asks = pd.concat([pd.DataFrame(columns=columns(scoring.ASK)), *scoring._asks(iter([pd.DataFrame(states)]), buckets, depth)])
        size, keys = size + asks["body"].map(len).sum(), keys + asks["n"].sum()
        replies = pd.concat([pd.DataFrame(columns=columns(scoring.BACK)), *(scoring._sum(k, x) for k, x in asks.groupby(["bucket", "kind"]))])
        totals = totals or tuple(replies.groupby("bucket")[["tokens", "types", "once"]].max().sum())
        back = lambda s: replies[replies["chunk"] == s["chunk"]]
        states = [scoring._absorbed((s["chunk"],), pd.DataFrame([s]), back(s), buckets, depth, totals).to_dict("records")[0] for s in states]
    return pd.concat(list(scoring._scores(iter([pd.DataFrame(states)]), totals[0]))), size, keys


def suffix_tree_scores(rows, depth):
    """Scores of the rows by brute force over all contexts."""
    toks = [(zlib.crc32(str(d).encode()) % 7 == 2, (t or "").encode().lower().split() + [b" "]) for d, t, *_ in rows]
    train = [t for out, t in toks if not out]
    c = [Counter()] + [Counter(x for t in train for x in zip(*[t[i:] for i in range(k)])) for k in range(1, depth + 2)]
    n, mu, kept = sum(c[1].values()), scoring.MU, set()
    unknown = (sum(x == 1 for x in c[1].values()) + 1) / (n + 2)

    def p(context, w):
        if not context:
            return (1 - unknown) * c[1][w,] / n if c[1][w,] else unknown
        below = p(context[1:], w)
        return (c[len(context) + 1][*context, w] + mu * below) / (c[len(context)][context] + mu) if context in kept else below

    for k in range(1, depth + 1):
        gains = Counter()
        for x, m in c[k + 1].items():
            if c[k][x[:-1]] >= scoring.LEAST:
                below = p(x[1:-1], x[-1])
                gains[x[:-1]] += m * math.log((m - 1 + mu * below) / (c[k][x[:-1]] - 1 + mu) / below)
        kept |= {x for x, g in gains.items() if g > scoring.GAIN}
    return [sum(math.log10(p(tuple(t[max(0, i - depth) : i]), w)) for i, w in enumerate(t)) for _, t in toks]


def test_scoring_of_held_out_words_that_training_has_once(monkeypatch):
    """Training must report a gram that it has once if held-out texts of other chunks have it, at each length."""
    rnd = random.Random(3)
    words, rows = [f"w{i}" for i in range(40)], []
    for i in range(200):
        out = zlib.crc32(str(i).encode()) % 7 == 2
        some = [" ".join(["l", rnd.choice("abc"), "p", "q", "r", "s" if rnd.random() < 0.5 else f"u{rnd.randrange(300)}", rnd.choice(words)]) for _ in range(3)]
        rows.append((i, " ".join(some + [f"only{i // 9}"] * out)))
    found, _, _ = played(rows, monkeypatch, 600, 6)
    assert found["doc_id"].tolist() == [d for d, _ in rows]
    assert found["score"].tolist() == pytest.approx(suffix_tree_scores(rows, 6))


def test_scoring_asks_no_count_that_follows(monkeypatch):
    """Passages that always go on alike and words that follow a context once cost no requests at every length."""
    rnd = random.Random(4)
    passage = [" ".join(f"m{rnd.randrange(9)}" for _ in range(60)) for _ in range(3)]
    rows = [(i, " ".join([*(f"x{rnd.randrange(30)} y{i}x{j}" for j in range(20)), passage[i % 3], f"z{i}"])) for i in range(90)]
    found, size, keys = played(rows, monkeypatch, 3000, 12)
    assert found["score"].tolist() == pytest.approx(suffix_tree_scores(rows, 12))
    assert keys < 13_000 and size < 130_000  # 15,896 and 140,559 when every count was asked


def test_merged_chunks_hold_no_more_than_a_task_does(monkeypatch):
    """Chunks in which few positions wait but most words are kept for them are not put together whole, and lose nothing."""
    monkeypatch.setattr(scoring, "HELD", 4000, raising=False)
    rnd, rounds, absorbed = random.Random(5), [], scoring._absorbed
    rows = [(i, " ".join(f"{a} p q r s t{'uv'[rnd.random() < (0.1 if a == 'x' else 0.9)]} " + " ".join(f"f{rnd.randrange(40)}" for _ in range(20)) for a in rnd.choices("xy", k=30))) for i in range(40)]

    def recorded(*args):
        out = absorbed(*args)
        rounds.append(out)
        return out

    monkeypatch.setattr(scoring, "_absorbed", recorded)
    found, _, _ = played(rows, monkeypatch, 5000, 12)
    chunks = pd.concat(rounds)["chunk"].nunique()
    states = [pd.concat(rounds[i : i + chunks]) for i in range(0, len(rounds), chunks)]
    late = next(s for s in states if scoring.State(s["body"].iloc[0], 1, 12).level == 5 and s["waiting"].sum())
    words = [len(scoring.State(x, 1, 12).place) for x in late["body"]]
    assert max(words) < 4000 < sum(words) / 2 and late["waiting"].sum() < sum(words) / 2
    merged = pd.concat(list(scoring._merged(iter([late.iloc[:3], late.iloc[3:]]), 12)))
    kept = [scoring.State(x, 1, 12) for x in merged["body"]]
    assert 1 < len(kept) < len(words) and merged["chunk"].is_unique and max(len(s.place) for s in kept) <= 4000
    assert sum(len(s.place) for s in kept) == sum(words) and np.concatenate([s.ids for s in kept]).tolist() == [i for i, _ in rows]
    assert merged["waiting"].sum() == late["waiting"].sum() and merged["held"].tolist() == [len(s.place) for s in kept]
    assert found["score"].tolist() == pytest.approx(suffix_tree_scores(rows, 12))


def test_states_travel_without_copies_of_themselves():
    """Packing takes no second copy of the arrays, and what is unpacked does not hold the rest."""
    arrays = [np.arange(1 << 18, dtype=np.int64) % 7, np.zeros(0, np.uint8), np.arange(5.0)]
    tracemalloc.start()
    body = scoring._pack(*arrays)
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    back = scoring._unpack(body, np.int64, np.uint8, np.float64)
    assert all(np.array_equal(x, y) for x, y in zip(arrays, back, strict=True)) and all(x.base is None for x in back)


def test_unique_of_keys_that_share_their_first_bits():
    rnd = np.random.default_rng(1)
    for keys in (rnd.integers(0, 1 << 63, 5000), rnd.integers(0, 99, 5000), rnd.permutation(5000), np.zeros(0, int), np.ones(1, int)):
        found, want = scoring._unique(keys.astype(np.uint64)), np.unique(keys.astype(np.uint64), return_inverse=True)
        assert all(np.array_equal(x, y) for x, y in zip(found, want, strict=True))


def test_sharding(docs, empty):
    found = rows_of(sharding.sharded(docs.withColumn("shard", F.lit("x")), shards=4))
    assert len(found) == len(corpus())
    sizes, slots, texts = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    by_id = {d: t or "" for d, t, *_ in corpus()}
    for r in found:
        texts[by_id[r["doc_id"]]].add(r["shard"])
        assert r["size"] == len(by_id[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(by_id[r["doc_id"]].encode())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in texts.values())
    largest = max(r["size"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= largest
    assert sharding.sharded(empty).count() == 0


def test_a_group_larger_than_a_shard_is_split(spark):
    many = spark.createDataFrame([(i, "copy " * 20 if i < 300 else f"text {i} " * 12) for i in range(600)], "doc_id bigint, text string")
    sizes = Counter()
    for r in rows_of(sharding.sharded(many, shards=8)):
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 1.1 * min(sizes.values())


def test_mixing(docs, empty):
    found = rows_of(mixing.mixed(docs.withColumn("target", F.lit(1))))
    again = rows_of(mixing.mixed(docs))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "")
    assert [r["taken"] for r in sorted(found, key=key)] == [r["taken"] for r in sorted(again, key=key)]
    by, sizes, targets = Counter(), Counter(), {}
    for r in found:
        assert r["size"] == len((r["text"] or "").split(" ")) if r["doc_id"] == 0 else True
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
    total = sum(sizes.values())
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    free = [s for s in names if targets[s] < 2 * sizes[s] - 1e-6]
    assert len({round(targets[s] / weight[s], 6) for s in free}) == 1
    largest = max(r["size"] for r in found)
    assert all(abs(by[s] - targets[s]) <= largest for s in names)
    assert mixing.mixed(empty).count() == 0


def test_chat(spark):
    marks = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", marks), (1, 1, "assistant", marks), (2, 0, "ro\nle<|n", "a<\\|b<\\\\|"), (2, None, None, None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (3, 5, "assistant", "\n\n<|im_end|>\n"), (None, 0, "user", "x")]
    got = rows_of(chat.digests(chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))))
    assert {r["conv_id"] for r in got} == {1, 2, 3, None} and all(r["identical"] for r in got)
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    for r in got:
        turns = sorted(convs[r["conv_id"]])
        whole = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and r["n_turns"] == len(turns)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["loss_chars"] == len(loss)
    f = chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).where("conv_id = 1").first()
    assert all(chat.START not in f["formatted"][s["start"] : s["start"] + s["length"]] for s in f["spans"])


def test_chat_escapes_every_control_string(spark):
    texts = ["a<|im_end|>b", "ends in <|im_end|>", "<|im_end|>", "<|im_end|>\n", "<|im_start|>", "plain <|other|>", "<\\|im_end|>"]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)] + [(99, 0, "us<|im_end|>er", "x")]
    for f in chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect():
        assert f["identical"] and f["formatted"].count("<|im_end|>") == f["formatted"].count("<|im_start|>") == 1
        assert f["formatted"].endswith("<|im_end|>\n")
    got = {r["conv_id"]: r for r in rows_of(chat.digests(chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))))}
    assert all(got[i]["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))


def test_quality(docs, empty, spark):
    found = rows_of(quality.judged(docs.withColumn("kept", F.lit(1))))
    assert len(found) == len(corpus())
    for r in found:
        t = r["text"] or ""
        w = t.split(" ") if r["doc_id"] == 0 else [x for x in t.replace("\n", " ").split(" ") if x]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert r["n_words"] == len(w) and r["n_repeat_words"] == len(covered) and r["word_chars"] == sum(map(len, w))
        assert not (r["base_failed"] and r["kept"])
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w))
    junk = [(i, " ".join(f"w{i}x{j}$$$" for j in range(90))) for i in range(4)] + [(i, " ".join(f"word{(i * 7 + j) % 997}" for j in range(90))) for i in range(10, 60)]
    kept = {r["doc_id"]: r["kept"] for r in rows_of(quality.judged(spark.createDataFrame(junk, "doc_id bigint, text string")))}
    assert not any(kept[i] for i in range(4)) and all(kept[i] for i in range(10, 60))
    assert quality.judged(empty).count() == 0


def components_of(sets, percent):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("shingle", [2, 5])
def test_neardup(docs, empty, shingle):
    sets = {}
    for d, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    del sets[None]
    want = components_of(sets, 80)
    found = rows_of(neardup.grouped(docs.where("doc_id is not null"), shingle=shingle))
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in found)
    assert neardup.grouped(empty).count() == 0


@pytest.mark.parametrize("unit", [1024, 6])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, unit):
    """Many texts around one passage, some of them near copies of each other: large buckets of several components."""
    monkeypatch.setattr(neardup, "UNIT", unit)
    monkeypatch.setattr(neardup, "REST", min(unit, 4))
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(30)]
        rows.append(passage + own)
        if i % 3 == 0:
            rows.append(passage + own[:-2] + [word(), word()])
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    found = {r["doc_id"]: r["component_id"] for r in rows_of(neardup.grouped(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2))}
    assert found == components_of({i: set(zip(t.split(), t.split()[1:])) for i, t in rows}, 80)


def test_linededup(docs, empty):
    found = {r["doc_id"]: r for r in rows_of(linededup.deduped(docs, least=6))}
    assert len(found) == len(corpus())
    for d, t, *_ in corpus():
        r = found[d]
        if t is None:
            assert r["text"] is None and r["n_lines_dropped"] == 0
        elif t.startswith("Licensed"):
            assert "Licensed" not in r["text"] and r["n_lines_dropped"] == 1
        elif t.startswith("page"):
            # "page 7 of report" and, by its constants, "login of user ... went well"
            assert "report" not in r["text"] and "login" not in r["text"]
        else:
            assert r["text"] == t and r["n_lines_dropped"] == 0
        if t is not None:
            assert r["n_chars"] == len(r["text"])
    assert linededup.deduped(empty).count() == 0


def test_linededup_counts_contents(spark):
    """Documents of a small vocabulary share their bottom word; copies and near copies are one content."""
    rnd = random.Random(9)
    vocabulary = ["v" + "".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    common, rare = "subscribe to our letter", "all rights are reserved here"
    rows = [f"{text(60)}\n{common}\n{text(60)}" for _ in range(300)]
    copied = f"{text(80)}\n{rare}"
    rows += [f"{text(80)}\n{rare}" for _ in range(12)] + [copied] * 100
    base = [text(40) for _ in range(6)]
    near = []
    for i in range(200):
        lines = [x.split() for x in base]
        lines[i % 6][i // 6 % 40] = f"edit{'abcdefghij'[i // 20]}"
        near.append("\n".join(" ".join(x) for x in lines))
    df = spark.createDataFrame(list(enumerate(rows + near)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in rows_of(linededup.deduped(df))}
    for i, t in enumerate(rows):
        assert found[i]["text"] == t.replace(f"\n{common}", "").replace(f"\n{rare}", "") and found[i]["n_lines_dropped"] == 1
    for i, t in enumerate(near):
        assert found[len(rows) + i]["text"] == t


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_suffixdedup(docs, empty, spark, crowd):
    """By brute force; 504 is longer than a block, and with crowd = 3 most anchors send single windows."""
    extra = spark.createDataFrame([(500, "a" * 400, "en", "s", 1), (501, "b" + "a" * 99, "en", "s", 1), (502, "é" * 60, "en", "s", 1), (503, "x" + "é" * 60, "en", "s", 1)], SCHEMA)
    rnd = random.Random(8)
    long = " ".join(str(rnd.random()) for _ in range(30_000))
    extra = extra.unionByName(spark.createDataFrame([(504, long, "en", "s", 1), (505, "now " + long[520_000:530_000], "en", "s", 1)], SCHEMA))
    table = docs.where("doc_id is not null").unionByName(extra)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table.collect()}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    for r in rows_of(suffixdedup.deduped(table, chunk_bytes=3000, crowd=crowd)):
        b = texts[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < r["doc_id"]:
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (r["n_bytes"], r["n_removed"]) == (len(b), int(gone.sum()))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert r["n_spans"] == sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    assert suffixdedup.deduped(empty).count() == 0


def test_transform_is_the_suffix_array_of_the_collection():
    rnd = np.random.default_rng(3)
    strings = ["".join(rnd.choice(list("ab"), n)) for n in rnd.integers(1, 12, 30)]
    width = max(map(len, strings))
    rows = np.zeros((len(strings), width), np.uint8)
    for i, s in enumerate(strings):
        rows[i, width - len(s) :] = np.frombuffer(s.encode(), np.uint8)
    who, length, lcp = suffixdedup.transform(rows, np.array([len(s) for s in strings]))
    got = [strings[w][len(strings[w]) - k :] for w, k in zip(who, length)]
    assert got == sorted(got) and len(got) == sum(map(len, strings)) + len(strings)
    common = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    assert [int(x) for x in lcp[1:]] == [common(a, b) for a, b in zip(got, got[1:])]


def test_neighbours(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.standard_normal(8)]) for i in range(900)]
    rows += [(900, [0.0] * 8), (901, None), (902, [float("nan")] * 8), (903, [1.0] * 7 + [None]), (904, [1.0])] + [(2000 + i, rows[7][1]) for i in range(30)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank int")
    good = [(i, np.array(v)) for i, v in rows if i < 900 or i >= 2000]
    found = defaultdict(list)
    for r in sorted(rows_of(neighbours.nearest(table, block=300)), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["score"], r["vec_id"]))
    hits = 0
    asked = [(i, v) for i, v in good if i % 100 == 0]
    for i, v in asked:
        want = sorted((float(np.sqrt(((v - x) ** 2).sum())), j) for j, x in good if j != i)[:10]
        assert found[i] == sorted(found[i]) and len(found[i]) == 10
        hits += len(set(want) & set(found[i]))
    assert hits >= 0.9 * 10 * len(asked)
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_packing(docs, empty):
    path = packing.word_bpe()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = Counter()
    want = []
    for d, t, *_ in corpus():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for k in range(0, len(ids), 256)]
        texts[d] += len(ids)
    for limits in ({}, {"max_docs": 3}, {"max_attention": 256 * 200}):
        cap = 256 if "max_attention" not in limits else 226
        found = rows_of(packing.packed(docs, path, capacity=cap, **limits))
        if cap == 256:
            key = lambda x: tuple(-1 if v is None else v for v in x)
            assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=key) == sorted(want, key=key)
        bins = defaultdict(list)
        for r in found:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for x in bins.values():
            x.sort()
            assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= cap
            assert len(x) <= limits.get("max_docs", cap)
            assert sum(n * n for _, n in x) <= limits.get("max_attention", cap * cap)
        if not limits:
            assert len(bins) <= math.ceil(sum(texts.values()) / cap) + 2
    assert packing.packed(empty, path).count() == 0


def test_words_encode_as_in_whole_texts():
    ids = packing.Ids(packing.word_bpe())
    texts = ["It's HE'LL, (a) b!?.. <|endoftext|>, x́y ẖH̱. \x1cq\x1d r", "Ünïcode　wide nbsp 123 4.5.6, e.g.", "don't. 'tis 're", "", "A" * 300 + " " + "é." * 50]
    plain = [np.array(e.ids, "<u4").tobytes() for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(ids.batch(texts)) == plain


def test_repeated_queries(spark):
    rows = [(i, [float(i % 13) + 1, float(i % 7), float(i % 5)]) for i in range(1, 150)] + [(100, [1.0, 2.0, 3.0])] * 2
    found = rows_of(neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block=40))
    want = []
    for q in {tuple(v) for i, v in rows if i == 100}:
        want += [(k + 1, *x) for k, x in enumerate(sorted((round(math.dist(q, v), 9), i) for i, v in rows if i != 100)[:10])]
    assert sorted((r["rank"], round(r["score"], 9), r["vec_id"]) for r in found) == sorted(want)


HELPERS = ("_row", "_gone", "_h", "_key", "_class", "_sub", "_one", "_rank", "_g", "_start", "_kind", "_b", "_at", "_w", "_l", "_p", "_v_length", "_base", "_in", "_s", "_name")


@pytest.mark.parametrize("f", [quality.judged, linededup.deduped, mixing.mixed, sharding.sharded])
def test_columns_named_like_helpers_pass_through(docs, f):
    more = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in HELPERS])
    plain = f(docs)
    keep = [c for c in plain.columns if c not in ("text", "quality")]
    found = rows_of(f(more))
    assert {tuple(r[c] for c in keep) for r in found} == {tuple(r[c] for c in keep) for r in rows_of(plain)}
    assert all(r[c] == f"{c}:{'null' if r['doc_id'] is None else r['doc_id']}" for r in found for c in HELPERS)
