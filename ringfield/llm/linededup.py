r"""Line dedup with a log-template tree.

Lines are parsed into a tree of fixed depth: first the number of tokens, then the leading
DEPTH tokens, where a token with a digit counts as variable (``<*>``). In a leaf that lines of
enough documents reach, the tokens are generalised place by place: a token that at least half
of the leaf's lines have at its place is constant, any other place is ``<*>``. A line takes
the leaf's template if it has all of its constants and these are at least half of its places;
any other line is its own template, its tokens with digits generalised.

A template recurs if documents of at least `least` different contents have lines of it: copies
and near copies of one document repeat all of its lines, and are no boilerplate, so each content
counts once however many copies it has. Copies are told by the hash of the text, near copies by
min-hashes over the three-word shingles of the whole text: texts that share two of SLOTS minima
are one content, named by the smallest text hash that two rounds over shared pairs reach. Two
texts of shingle similarity 0.9 share two of four with probability 0.996, of 0.05 with 0.014.
Lines of recurring templates are dropped, all of them.

Each step joins on 64-bit keys of lines, templates or documents; a template that a third of all
lines have is summed before it is shuffled. Tables of templates are broadcast only if counted to be
small, and joined by a shuffle otherwise.

Defined results: null texts stay null and lose nothing; lines without words are no lines here and stay;
repeated rows are separate documents with equal content; a text whose lines are all dropped is
left empty and its row stays; an empty table gives an empty result; other columns pass through,
whatever their names (n_lines_dropped is replaced), and n_chars, where present, is counted anew.
Near copies are told among the texts that have a line of a leaf with enough different texts; other
texts cannot lose a line.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.llm.common import cut, fresh, small, words

DEPTH, LEAST = 3, 8
WILD = "<*>"
#: One point of the hash space for each minimum: the shingle whose hash is nearest by exclusive or.
SLOTS = (0x1B873593CC9E2D51, -0x4F4A52C7A1D36E09, 0x6A09E667F3BCC908, -0x2545F4914F6CDD1D)


#: A token with a digit; tokens are apart by the white space of words().
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def lines_of(docs: DataFrame) -> DataFrame:
    """(_row, text) -> (_row, no, leaf, own, copy, tokens) for each line with a word."""
    df = docs.select("_row", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    df = df.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    line = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", VARIABLE, WILD)).otherwise(F.col("line"))
    df = df.select("_row", "copy", "no", line.alias("line"))  # masked as a whole: no function of each token
    df = df.select("_row", "copy", "no", words(F.col("line")).alias("tokens"))
    return df.select(
        "_row", "copy", "no",
        F.expr(f"xxhash64(size(tokens), slice(tokens, 1, {DEPTH}))").alias("leaf"),
        F.xxhash64("tokens").alias("own"),
        "tokens",
    )


def near_copies(docs: DataFrame) -> DataFrame:
    """(copy, content): text hashes, and the smaller one of a near copy; other texts are contents of their own."""
    w = docs.select(F.xxhash64("text").alias("copy"), words(F.col("text")).alias("_w"))
    w = w.select("copy", F.inline(F.arrays_zip(F.col("_w").alias("a"), F.expr("slice(_w, 2, size(_w))").alias("b"), F.expr("slice(_w, 3, size(_w))").alias("c"))))
    h = w.select("copy", F.xxhash64(*w.columns[1:]).alias("_h"))
    minima = cut(h.groupBy("copy").agg(*[F.min(F.col("_h").bitwiseXOR(F.lit(x))).alias(f"_{i}") for i, x in enumerate(SLOTS)]))
    pairs = F.explode(F.array(*[F.xxhash64(F.lit(i), F.lit(j), f"_{i}", f"_{j}") for i, j in combinations(range(len(SLOTS)), 2)]))
    keys = minima.select("copy", pairs.alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("copy").alias("content"), F.max("copy").alias("_hi")).where("content <> _hi").select("key", "content"))
    keys = cut(keys.join(small(shared), "key").select("key", "copy", "content"))
    first = keys.groupBy("copy").agg(F.min("content").alias("first"))
    again = cut(keys.join(small(cut(first)), "copy").groupBy("key").agg(F.min("first").alias("second")))
    named = keys.join(small(again), "key").groupBy("copy").agg(F.min("second").alias("content"))
    return cut(named.where("copy <> content"))


def _recurring(members: DataFrame, key: str, least: int) -> DataFrame:
    """members (key, content): keys of enough different contents."""
    sums = members.groupBy(key, "content").agg(F.lit(1).alias("_1")).groupBy(key).agg(F.count(F.lit(1)).alias("contents"))
    return sums.where(F.col("contents") >= least).select(key)


def marked(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(_row, text) -> (_row, no) of the lines to drop."""
    brief = cut(lines_of(docs).drop("tokens"))
    # Contents are no more than different texts, so a leaf that too few texts reach is done here;
    # texts without a line of another leaf are not read again.
    busy = cut(_recurring(brief.withColumnRenamed("copy", "content"), "leaf", least))
    brief = cut(brief.join(small(busy), "leaf", "left_semi"))
    some = docs.join(small(cut(brief.select("_row").distinct())), "_row", "left_semi")
    named = brief.join(small(near_copies(some)), "copy", "left")
    brief = cut(named.select("_row", "no", "leaf", "own", F.coalesce("content", "copy").alias("content")))
    leaves = cut(_recurring(brief, "leaf", least))

    # constants of the leaves in question; equal lines of a leaf are counted before tokens are spread
    inside = lines_of(some).join(small(leaves), "leaf", "left_semi")
    kinds = cut(inside.groupBy("leaf", "own").agg(F.count(F.lit(1)).alias("n"), F.first("tokens").alias("tokens")))
    spread = kinds.select("leaf", "n", F.posexplode("tokens").alias("pos", "token"))
    votes = spread.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"))
    total = cut(kinds.groupBy("leaf").agg(F.sum("n").alias("_all")))
    constant = votes.join(small(total), "leaf").where((2 * F.col("n") >= F.col("_all")) & (F.col("token") != WILD))
    constant = constant.groupBy("leaf", "pos").agg(F.max(F.struct("n", "token"))["token"].alias("token"))
    shape = cut(constant.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("fixed")))
    fits = F.forall(F.map_entries("fixed"), lambda e: F.get("tokens", e["key"]) == e["value"]) & (2 * F.size("fixed") >= F.size("tokens"))
    named = kinds.join(small(shape, 1 << 14), "leaf", "left").select("leaf", "own", F.when(fits, F.xxhash64(F.lit("leaf"), "leaf")).otherwise(F.col("own")).alias("template"))
    generalised = cut(named.where("template <> own"))

    tagged = brief.join(small(generalised), ["leaf", "own"], "left").select("_row", "no", "content", F.coalesce("template", "own").alias("template"))
    tagged = cut(tagged)
    drop = cut(_recurring(tagged, "template", least))
    return tagged.join(small(drop), "template", "left_semi").select("_row", "no")


def deduped(docs: DataFrame, least: int = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the lines of recurring templates, with n_lines_dropped."""
    row, gone = fresh(docs, "_row", "_gone")
    rows = docs.drop("n_lines_dropped").withColumn(row, _row_key(text, doc_id))
    lost = marked(rows.select(F.col(row).alias("_row"), F.col(text).alias("text")), least).groupBy(F.col("_row").alias(row)).agg(F.sort_array(F.collect_set("no")).alias(gone))
    left = rows.join(small(cut(lost), 1 << 18), row, "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = left.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept))
    out = out.withColumn("n_lines_dropped", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.drop(row, gone)


def _row_key(text: str, doc_id: str) -> Column:
    """Names a row by its id and text: repeated rows share the name and lose the same lines."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = F.coalesce(F.col("text"), F.lit(""))
    return deduped(docs).select(
        "doc_id", "n_lines_dropped", F.length(t).cast("long").alias("kept_chars"), F.sha2(t.cast("binary"), 256).alias("kept_sha256")
    )
