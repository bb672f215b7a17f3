"""Sharding by balanced label propagation.

Documents are linked when their texts are equal. All start in a shard drawn from their id and text;
in each round the linked documents of a shard want to move to the shard where most of their
neighbours' bytes are, and a quota for each pair of shards, from the loads and capacities,
says how much may move. Equal texts have the same neighbours, so a round decides for all
documents of one text in one shard together: the joins run on (text, shard) sums, at most
`shards` rows a text, and a text that a third of the corpus repeats is one more such row.
Documents without links then fill the shards up, large ones first, by prefix sums.

The law is `bytes`: shard sizes near equal.

Defined results: null texts have size 1 and crc32 0 and equal empty texts; repeated rows are
separate documents with equal texts, ordered by a hash of id and text, so rows alike in both are
interchangeable; an empty table gives an empty result; documents larger than a shard's share make
their shard larger than the others; other columns but the text pass through whatever their names,
those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfield.llm.common import before_sum, cut, fine_buckets


def quotas(demand: dict[tuple[int, int], int], load: list[int], capacity: float) -> dict[tuple[int, int], float]:
    """The bytes that may move from a to b: first what is swapped against the opposite
    demand, then what the room of b allows. shards * shards numbers at most."""
    move = {(a, b): float(min(d, demand.get((b, a), 0))) for (a, b), d in demand.items()}
    now = [float(x) for x in load]
    for (a, b), d in sorted(demand.items(), key=lambda x: (-(x[1] - move[x[0]]), x[0])):
        more = min(d - move[a, b], max(0.0, capacity - now[b]))
        move[a, b] += more
        now[a] -= more
        now[b] += more
    return move


def _lookup(values: dict[tuple[int, int], float], a: str, b: str, shards: int) -> Column:
    flat = [float(values.get((i, j), 0.0)) for i in range(shards) for j in range(shards)]
    return F.element_at(F.array(*[F.lit(x) for x in flat]), (F.col(a) * shards + F.col(b) + 1).cast("int"))


def propagated(cells: DataFrame, load: list[int], shards: int, rounds: int, capacity: float) -> tuple[DataFrame, list[int]]:
    """cells: (_g, shard, bytes), the bytes that documents of text _g have in a shard.
    load: their sums by shard. capacity: of a shard; documents without links give way.
    Returns the cells after the rounds, and the loads."""
    for k in range(rounds):
        best = cells.groupBy("_g").agg(F.max(F.struct("bytes", F.xxhash64("_g", "shard").alias("_tie"), "shard"))["shard"].alias("_to"))
        wants = cut(cells.join(best, "_g"))
        demand = {(r[0], r[1]): int(r[2]) for r in wants.where("shard <> _to").groupBy("shard", "_to").agg(F.sum("bytes")).collect()}
        if not demand:
            break
        move = quotas(demand, load, capacity)
        part = {x: min(1.0, move[x] / d) for x, d in demand.items()}
        share = _lookup(part, "shard", "_to", shards)
        quota = _lookup(move, "shard", "_to", shards)
        lot = F.pmod(F.xxhash64(F.lit(k), "_g", "shard"), F.lit(1 << 20)) / float(1 << 20)
        # a cell moves whole by lot, but one that would fill the quota alone moves its share
        moved = (
            F.when(F.col("shard") == F.col("_to"), F.lit(0.0))
            .when(F.col("bytes") * 20 > quota, F.col("bytes") * share)
            .otherwise(F.when(lot < share, F.col("bytes")).otherwise(0))
        )
        wants = wants.withColumn("_m", F.floor(moved).cast("long"))
        both = F.explode(
            F.array(
                F.struct(F.col("shard"), (F.col("bytes") - F.col("_m")).alias("bytes")),
                F.struct(F.col("_to").alias("shard"), F.col("_m").alias("bytes")),
            )
        ).alias("_x")
        cells = cut(wants.select("_g", both).groupBy("_g", F.col("_x.shard").alias("shard")).agg(F.sum("_x.bytes").alias("bytes")).where("bytes > 0"))
        for (a, b), x in {(r[0], r[1]): int(r[2]) for r in wants.where("_m > 0").groupBy("shard", "_to").agg(F.sum("_m")).collect()}.items():
            load[a] -= x
            load[b] += x
    return cells, load


def filled(load: list[float], more: float) -> list[float]:
    """How much of `more` each shard takes, so that the lowest are raised to one level."""
    level, left = 0.0, more
    order = sorted(load)
    for i, x in enumerate(order):
        room = (order[i + 1] - x) * (i + 1) if i + 1 < len(order) else float("inf")
        if left <= room:
            level = x + left / (i + 1)
            break
        left -= room
    return [max(0.0, level - x) for x in load]


def _interval(at: Column, ends: list[float]) -> Column:
    """The index of the first end above `at`."""
    out = F.lit(len(ends) - 1)
    for i in reversed(range(len(ends) - 1)):
        out = F.when(at < ends[i], i).otherwise(out)
    return out.cast("int")


def sharded(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", rounds: int = 4) -> DataFrame:
    """docs' other columns with size, text_crc32, shard and slot; the text itself is not carried."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    rows = cut(
        docs.select(
            F.struct(*[c for c in docs.columns if c not in (text, "size", "text_crc32", "shard", "slot")]).alias("_row"),
            (F.octet_length(t) + 1).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.struct(F.xxhash64(t), F.crc32(t.cast("binary")), F.octet_length(t)).cast("string").alias("_g"),
            F.xxhash64(F.lit(5), d, t).alias("_h"),
        )
    ).withColumn("_start", F.pmod("_h", F.lit(shards)).cast("int"))
    texts = cut(rows.groupBy("_g", "_start").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("bytes")))
    many = texts.groupBy("_g").agg(F.sum("_n").alias("_docs")).where("_docs > 1").select("_g", "_docs")
    n, total = texts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cells = cut(texts.join(many.drop("_docs"), "_g").select("_g", F.col("_start").alias("shard"), "bytes"))
    load = [0] * shards
    for s, b in cells.groupBy("shard").agg(F.sum("bytes")).collect():
        load[s] = int(b)
    cells, load = propagated(cells, load, shards, rounds, total / shards)

    # Where documents of a text go: by their place in the text's bytes. Texts that hold over a
    # thousandth of the rows are fewer than a thousand, so their table may be broadcast.
    split = cells.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("shard", "bytes"))).alias("_cells"))
    split = cut(split.join(many, "_g"))
    heavy = split.where(F.col("_docs") * 1000 > n)
    light = split.where(F.col("_docs") * 1000 <= n)
    marked = rows.join(F.broadcast(heavy), "_g", "left")
    hot = marked.where("_cells is not null")
    rest = marked.where("_cells is null").drop("_cells", "_docs").join(light, "_g", "left")
    linked = hot.unionByName(rest.where("_cells is not null"))
    linked = linked.withColumn("_b", F.pmod(F.shiftright("_h", 8), F.when(F.col("_docs") * 1000 > n, fine_buckets(n)).otherwise(1)).cast("int"))
    linked = before_sum(linked, ["_g"], ["_b"], ["_h"], "size", "_at")
    picked = F.expr(
        "aggregate(_cells, named_struct('end', 0L, 'shard', -1), (a, c) -> named_struct('end', a.end + c.bytes,"
        " 'shard', IF(a.shard < 0 AND _at < a.end + c.bytes, c.shard, a.shard)), a -> a.shard)"
    )
    linked = linked.withColumn("shard", F.greatest(picked, F.lit(0)).cast("int")).drop("_cells", "_docs", "_b", "_at")
    single = rest.where("_cells is null").drop("_cells", "_docs").withColumn("shard", F.col("_start"))
    both = cut(linked.withColumn("_one", F.lit(False)).unionByName(single.withColumn("_one", F.lit(True))))

    # Documents without links: those above a share of a shard stay, smaller ones level the shards.
    share = max(1.0, float(total) / shards)
    ends = [0.04 * share, 0.003 * share]
    kind = F.when(~F.col("_one") | (F.col("size") > ends[0]), 0).when(F.col("size") > ends[1], 1).otherwise(2)
    both = both.withColumn("_kind", kind)
    sums = {(r[0], r[1]): int(r[2]) for r in both.groupBy("_kind", "shard").agg(F.sum("size")).collect()}
    now = [float(sums.get((0, s), 0)) for s in range(shards)]
    out = both.where("_kind = 0")
    placed = both.where("_kind > 0").withColumn("_b", F.pmod(F.shiftright("_h", 8), F.lit(fine_buckets(n))).cast("int"))
    placed = before_sum(placed, ["_kind"], ["_b"], ["_h"], "size", "_at")
    shard = F.col("shard")
    for k in (1, 2):
        take = filled(now, float(sum(x for (kk, _), x in sums.items() if kk == k)))
        now = [a + b for a, b in zip(now, take, strict=True)]
        upto = [sum(take[: i + 1]) for i in range(shards)]
        shard = F.when(F.col("_kind") == k, _interval(F.col("_at") + F.col("size") / 2, upto)).otherwise(shard)
    placed = placed.withColumn("shard", shard).drop("_b", "_at")
    done = cut(out.unionByName(placed))
    done = done.withColumn("_b", F.pmod(F.shiftright("_h", 16), F.lit(fine_buckets(n))).cast("int")).withColumn("_1", F.lit(1))
    done = before_sum(done, ["shard"], ["_b"], ["_h"], "_1", "slot")
    return done.select("_row.*", "size", "text_crc32", "shard", "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
