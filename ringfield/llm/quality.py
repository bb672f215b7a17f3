"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0). Expectation-maximisation over the vote
patterns estimates how far each rule can be trusted and which share of the documents is good, and
a document is kept on its posterior probability of being good. So a rule that blames texts which
all others praise loses its say, and rules that agree gain it: one bad vote of a poor rule is
outvoted, two that seldom err add up. Rules look at different sides of a text, as the model takes
their errors to be independent. All text work is built-in expressions; the patterns, at most
3 ** len(RULES) of them, are the only thing the driver sees.

Defined results: null and empty texts have no words (base_failed, so not kept); repeated rows
get equal results each; an empty table gives an empty result; other columns pass through
untouched except those this operator adds, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.llm.common import SPACES, cut, fresh, stored, words

MIN_WORDS = 50
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_different_words", "n_ended_words", "n_lines")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of FEATURES."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    df = docs.drop(*FEATURES)
    w, ls, h, p = fresh(df, "_w", "_l", "_h", "_p")
    df = df.select("*", words(t).alias(w), lines.alias(ls))
    df = df.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        # words with a letter: tried at the start of each word only, and without going back, so that long words cost no more
        F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]*+\p{L}")).cast("long").alias("n_letter_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_different_words"),
        F.regexp_count(t, F.lit(r"[.!?,;:](?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_ended_words"),
        F.size(ls).cast("long").alias("n_lines"),
        # (hash of three words, place), sorted: equal windows stand side by side
        F.expr(
            f"IF(size({w}) < 3, array(), array_sort(transform(sequence(0, size({w}) - 3),"
            f" i -> struct(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) AS h, i AS i))))"
        ).alias(h),
    ).drop(w, ls)
    df = df.withColumn(
        p,
        F.expr(
            f"array_sort(transform(filter({h}, (x, k) -> (k > 0 AND {h}[k - 1].h = x.h)"
            f" OR (k + 1 < size({h}) AND {h}[k + 1].h = x.h)), x -> x.i))"
        ),
    ).drop(h)
    covered = F.expr(
        f"aggregate({p}, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct("
        "'n', a.n + least(3, p - a.last), 'last', p), a -> a.n)"
    )
    # each start covers three words; the overlap with the start before it is not counted twice
    return df.withColumn("n_repeat_words", covered.cast("long")).drop(p)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _band(x: Column, bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.col("n_lines")
    mean = F.col("word_chars") / n
    return {
        "symbols": _band(n, 10 * F.col("n_symbols") > n, 50 * F.col("n_symbols") <= n),
        "letters": _band(n, 100 * F.col("n_letter_words") < 80 * n, 100 * F.col("n_letter_words") >= 95 * n),
        "word_length": _band(mean, (mean < 4.2) | (mean > 7.0), mean.between(4.5, 6.0)),
        "variety": _band(n, 100 * F.col("n_different_words") < 52 * n, 100 * F.col("n_different_words") >= 60 * n),
        "sentences": _band(n, 100 * F.col("n_ended_words") < 5 * n, 100 * F.col("n_ended_words") >= 9 * n),
        # one rule: a line that stands twice is also a repeat, and one opinion must not count twice
        "repetition": _band(
            n, (100 * F.col("n_repeat_words") > 10 * n) | (10 * F.col("n_dup_lines") > lines), (100 * F.col("n_repeat_words") <= 3 * n) & (F.col("n_dup_lines") == 0)
        ),
    }


RULES = ("symbols", "letters", "word_length", "variety", "sentences", "repetition")
# What is believed before any document is seen, and how many documents that weighs: nine in ten are good, rules seldom blame
# those, and junk passes half of the rules. That is: the share of good ones, and the
# probability of a good vote on a good document and on a bad one. It says which of the two classes is the good one.
SHARE, GOOD, BAD, WEIGHT = 0.9, 0.98, 0.5, 5.0


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """EM on (votes, count) rows: the share of good documents, and for each rule the probability that it votes
    good when it votes on a good document, and on a bad one. Abstaining says nothing."""
    k = len(patterns[0][0]) if patterns else len(RULES)
    share, theta = SHARE, [(GOOD, BAD)] * k
    total = sum(c for _, c in patterns)
    for _ in range(rounds):
        post = [posterior(v, share, theta) for v, _ in patterns]
        weight = [(c * p, c * (1 - p)) for p, (_, c) in zip(post, patterns, strict=True)]
        share = (sum(g for g, _ in weight) + WEIGHT * SHARE) / (total + WEIGHT)
        theta = []
        for r in range(k):
            sides = []
            for side, prior in enumerate((GOOD, BAD)):
                voted = sum(w[side] for w, (v, _) in zip(weight, patterns, strict=True) if v[r])
                good = sum(w[side] for w, (v, _) in zip(weight, patterns, strict=True) if v[r] == 1)
                sides.append((good + WEIGHT * prior) / (voted + WEIGHT))
            theta.append((sides[0], sides[1]))
    return share, theta


def weight_of(vote: int, good: float, bad: float) -> float:
    """What a vote adds to the log odds."""
    if vote == 0:
        return 0.0
    return math.log(good / bad) if vote == 1 else math.log((1 - good) / (1 - bad))


def posterior(votes: tuple[int, ...], share: float, theta: list[tuple[float, float]]) -> float:
    odds = math.log(share / (1 - share)) + sum(weight_of(v, g, b) for v, (g, b) in zip(votes, theta, strict=True))
    return 1 / (1 + math.exp(-odds))


def judged(docs: DataFrame, text: str = "text", at_least: float = 0.5) -> DataFrame:
    """docs with FEATURES, base_failed, quality (the posterior, double) and kept."""
    # a written table: a filter on the verdict would otherwise copy the text expressions into itself
    return verdict(stored(features(docs, text)), at_least)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small = cut(features(docs).drop("text"))  # texts are read once; the votes come from these few numbers
    return verdict(small).select("doc_id", *FEATURES, "base_failed", "kept", "quality")


def verdict(df: DataFrame, at_least: float = 0.5) -> DataFrame:
    """As judged(), for rows that have FEATURES already."""
    rule = rules()
    df = df.drop("base_failed", "quality", "kept")
    names = fresh(df, *(f"_v_{r}" for r in RULES))
    votes = df.select("*", base_failed().alias("base_failed"), *(rule[r].cast("int").alias(name) for r, name in zip(RULES, names, strict=True)))
    found = [(tuple(r[:-1]), r[-1]) for r in votes.where("NOT base_failed").groupBy(*names).count().orderBy(*names).collect()]
    share, theta = fit(found)
    odds = F.lit(math.log(share / (1 - share)))
    for name, (g, b) in zip(names, theta, strict=True):
        c = F.col(name)
        odds = odds + F.when(c == 1, weight_of(1, g, b)).when(c == -1, weight_of(-1, g, b)).otherwise(0.0)
    return (
        votes.withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= at_least))
        .drop(*names)
    )
