"""Mixing sources to target weights.

plan_mix() turns weights into word targets, targets into exact numbers of
blocks (hash-permuted groups of a source's documents; an epoch draws each block
once), and splits those numbers among output shards by a multivariate-
hypergeometric tree: every node hands half of its blocks to the left, drawn
without replacement over all sources, and the rest to the right; how many come
of a source is one hypergeometric draw, by inversion from the mode on, so its
cost grows with the standard deviation and not with the blocks.  A shard then
takes the next blocks of each source's permuted sequence, so draws are
disjoint, and orders its documents by a hash of its own.  DataFrame functions
only; everything random is a hash of the seed, so reruns agree.

Of the last epoch of a source, whole blocks are taken while they fit; of the
next block every document, in hash order, that still fits, then the one that
comes nearest to what is missing, if taking it comes nearer.  Of TRIES hash
orders of that one block the one that comes nearest to the target counts.

Defined cases: a null text has size 0; a null source is a source, last in
order; a source without words has target 0.  Rows with a null id or rows that
repeat are mixed like others; equal rows of the last, partly taken block are
taken together.  An empty table gives an empty mix.  Extra columns are carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 1 << 20  # mean words of a block at most
BLOCK_DOCS = 512  # mean documents of a block at most
SHARDS = 16  # at least; a power of two
SHARD_WORDS = 1 << 28  # words of a shard at most, on average
SLICES = 10  # bits of a hash by which long orders are cut into slices
TRIES = 32
SEED = 7


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, idx, source_size, weight, target.  The whole
    table is one row per source, so one task can order it."""
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = total.withColumn("idx", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    # Water filling: with sources in the order of limit / weight, the first whose
    # share of what the fuller ones leave lies within its limit sets the level.
    by = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("idx"))
    everything = Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "idx", "level"))
    s = s.withColumn("level", F.coalesce(F.min(fits).over(everything)["level"], F.lit(float("inf"))))
    return s.select("source", "idx", "source_size", "n_docs", "weight", F.least(F.col("limit"), F.col("level") * F.col("weight")).alias("target"))


def _block(idx: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), idx, F.col("id"), F.col("size")), blocks)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


_EXACT = [0.0]  # ln n! of small n
for _n in range(1, 16):
    _EXACT.append(_EXACT[-1] + math.log(_n))


def _ln_factorial(n: Column) -> Column:
    """By table below 16, by Stirling's series from there on."""
    x = n.cast("double")
    y = 1 / (x * x)
    series = x * F.log(x) - x + 0.5 * F.log(x * (2 * math.pi)) + (1 / 12 - y * (1 / 360 - y / 1260)) / x
    return F.when(n < 16, F.element_at(F.lit(_EXACT), n.cast("int") + 1)).otherwise(series)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of draws out of total are among the good ones, for a uniform u:
    probabilities are taken off u from the mode on, upwards and downwards in turn,
    over ten standard deviations."""

    def walk(c: Column) -> Column:
        n, k, d = c["n"], c["k"], c["d"]
        mode = c["mode"]
        share = k.cast("double") / n
        spread = F.sqrt(d * share * (1 - share) * (n - d) / F.greatest(n - 1, F.lit(1)))
        steps = F.least(F.least(d, k).cast("double"), F.ceil(10 * spread) + 10).cast("int")
        over, under = (k, n - k, d, n - d), (mode, k - mode, d - mode, n - k - d + mode, n)  # factorials of a fraction
        parts = F.transform(F.array(*over, *under), lambda x, i: F.when(i < len(over), 1).otherwise(-1) * _ln_factorial(x))
        p = F.exp(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))
        state = lambda left, up, pu, dn, pd, got: F.struct(
            left.alias("left"), up.cast("long").alias("up"), pu.alias("pu"), dn.cast("long").alias("dn"), pd.alias("pd"), got.cast("long").alias("got")
        )
        start = state(c["u"] - p, mode, p, mode, p, F.when(c["u"] < p, mode))

        def step(a: Column, _: Column) -> Column:
            up, dn = a["up"].cast("double"), a["dn"].cast("double")
            pu = a["pu"] * (k - up) * (d - up) / ((up + 1) * (n - k - d + up + 1))
            pd = a["pd"] * dn * (n - k - d + dn) / ((k - dn + 1) * (d - dn + 1))
            got = F.coalesce(a["got"], F.when(a["left"] < pu, a["up"] + 1), F.when(a["left"] < pu + pd, a["dn"] - 1))
            return state(a["left"] - pu - pd, a["up"] + 1, pu, a["dn"] - 1, pd, got)

        walked = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["got"])
        return F.coalesce(walked, mode)

    n, k, d = total.cast("long"), good.cast("long"), draws.cast("long")
    mode = F.floor((d + 1).cast("double") * (k + 1) / (n + 2)).cast("long")
    mode = F.least(F.greatest(mode, F.lit(0).cast("long"), d - (n - k)), d, k)
    given = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), u.cast("double").alias("u"), mode.alias("mode"))
    certain = F.when((draws == 0) | (good == 0), F.lit(0).cast("long")).when(good == total, draws.cast("long"))
    return F.coalesce(certain, _let(given, walk))


def _split(node: Column, quotas: Column, seed: int) -> Column:
    """How many blocks of each source go left: of half of a node's blocks without
    replacement, source by source what the ones before have left open."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(F.floor(total / 2).cast("long").alias("need"), total.alias("left"), F.array().cast("array<long>").alias("got"))

    def source(a: Column, q: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), node, F.size(a["got"])), F.lit(1 << 53)) / F.lit(float(1 << 53))
        taken = hypergeometric(a["left"], q, a["need"], u)
        return _let(taken, lambda x: F.struct((a["need"] - x).alias("need"), (a["left"] - q).alias("left"), F.array_append(a["got"], x).alias("got")))

    return F.aggregate(quotas, start, source)["got"]


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(idx, quota) to (idx, shard, lo, quota): lo is the rank of a shard's
    first block of the source.  One row holds a node's quotas of all sources."""
    if shards & (shards - 1):
        raise ValueError("shards is not a power of two")
    # Nodes are numbered as in a heap: 1, then 2 and 3, so each draws of its own.
    tree = quotas.agg(F.sort_array(F.collect_list(F.struct("idx", "quota"))).alias("q"))
    tree = tree.select(F.lit(1).cast("long").alias("node"), F.transform("q", lambda x: x["quota"]).alias("quotas"), F.transform("q", lambda x: x["idx"]).alias("ids"))
    go, rest, level = _split(F.col("node"), F.col("quotas"), seed), F.zip_with("quotas", "go", lambda q, g: q - g), 1
    while level < shards:
        if level > 1 and level.bit_length() % 4 == 1:  # every four levels, so that plans stay small
            tree = materialize(tree.repartition("node"), "mix-tree")
        tree = tree.withColumn("go", go).select(F.posexplode(F.array(F.col("go"), rest)).alias("side", "quotas"), "node", "ids")
        tree = tree.select((F.col("node") * 2 + F.col("side")).alias("node"), "quotas", "ids")
        level *= 2
    leaf = tree.select((F.col("node") - shards).alias("shard"), F.explode(F.arrays_zip("ids", "quotas")).alias("z"))
    leaf = leaf.select("shard", F.col("z.ids").alias("idx"), F.col("z.quotas").alias("quota"))
    until = F.sum("quota").over(Window.partitionBy("idx").orderBy("shard"))
    return leaf.select("idx", "shard", "quota", (until - F.col("quota")).alias("lo"))


def _fill(items: Column, room: Column) -> Column:
    """(off, got): the documents of one block (BLOCK_DOCS on average) that fill its
    room, each that fits, in order, and at last the nearest one; and what is amiss."""
    none = F.array().cast("array<struct<h:long,id:long,size:long,words:long>>")
    start = F.struct(room.cast("double").alias("room"), none.alias("got"), none.alias("left"))

    def step(a: Column, x: Column) -> Column:
        fits = x["words"] <= a["room"]
        return F.struct(
            F.when(fits, a["room"] - x["words"]).otherwise(a["room"]).cast("double").alias("room"),
            F.when(fits, F.array_append(a["got"], x)).otherwise(a["got"]).alias("got"),
            F.when(fits, a["left"]).otherwise(F.array_append(a["left"], x)).alias("left"),
        )

    def nearest(a: Column) -> Column:
        off = F.transform(a["left"], lambda x: F.struct(F.abs(x["words"] - a["room"]).alias("off"), x.alias("x")))
        best = F.filter(F.array(F.array_min(off)), lambda y: y["off"] < a["room"])
        amiss = F.coalesce(F.array_min(F.transform(best, lambda y: y["off"])), a["room"])
        return F.struct(amiss.alias("off"), F.concat(a["got"], F.transform(best, lambda y: y["x"])).alias("got"))

    return F.aggregate(items, start, step, nearest)


def _ordered(blocks: DataFrame, keys: list[str], h: Column) -> DataFrame:
    """blocks with rank and before (the words before) in the order of a hash h,
    within keys.  The order is cut into slices of the hash, so that no task holds
    all blocks of a source."""
    cut = blocks.withColumn("_h", h).withColumn("_slice", F.shiftright("_h", 64 - SLICES))
    sums = cut.groupBy(*keys, "_slice").agg(F.sum("words").alias("_w"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select(*keys, "_slice", F.coalesce(F.sum("_w").over(ahead), zero).alias("_w"), F.coalesce(F.sum("_n").over(ahead), zero).alias("_n"))
    within = Window.partitionBy(*keys, "_slice").orderBy("_h", "block")
    cut = cut.withColumn("before", F.sum("words").over(within) - F.col("words")).withColumn("rank", F.row_number().over(within) - 1)
    cut = cut.join(sums, [*keys, "_slice"])
    return cut.withColumns({"before": F.col("before") + F.col("_w"), "rank": F.col("rank") + F.col("_n")}).drop("_h", "_slice", "_w", "_n")


def plan_mix(rows: DataFrame, shards: int | None = None, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: id, source, size.  Returns
    sources: source, idx, source_size, target, blocks;
    draws: idx, block, epoch, shard, part (true: only what picks names);
    picks: idx, block, id, size.
    shards: by default as many as SHARD_WORDS asks for, SHARDS at least."""
    s = targets(rows, weights)
    size = F.col("source_size")
    s = s.withColumn("blocks", F.greatest(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.ceil(size / BLOCK_WORDS)).cast("long"))
    s = s.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    sources = materialize(s.withColumn("rest", F.col("target") - F.col("epochs") * size), "mix-sources")
    if shards is None:
        words = sources.agg(F.sum("source_size")).first()[0] or 0
        shards = max(SHARDS, 1 << (-(-words // SHARD_WORDS) - 1).bit_length())
    dealt = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("id", "size", "idx", "blocks", "epochs", "rest")
    dealt = dealt.withColumn("block", _block(F.col("idx"), F.col("blocks"), seed))
    # One row per block that has documents.
    blocks = dealt.groupBy("idx", "block").agg(F.sum("size").alias("words"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    blocks = materialize(blocks, "mix-blocks")
    # Blocks of the last epoch: the first ones of their order, as many as have room.
    last = _ordered(blocks.where("words > 0"), ["idx"], F.xxhash64(F.lit(seed), F.lit("last"), "idx", "block")).where("before < rest")
    last = materialize(last.withColumn("part", F.col("before") + F.col("words") > F.col("rest")), "mix-last")
    counted = blocks.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    full = blocks.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    full = _ordered(full, ["idx", "epoch"], F.xxhash64(F.lit(seed), "epoch", "idx", "block")).withColumn("part", F.lit(False))
    left = last.select("idx", "block", F.col("epochs").alias("epoch"), "rank", "part")
    drawn = full.select("idx", "block", "epoch", "rank", "part").unionByName(left)
    drawn = drawn.join(counted, "idx").withColumn("rank", F.col("epoch") * F.col("n") + F.col("rank"))
    drawn = materialize(drawn.select("idx", "block", "epoch", "rank", "part"), "mix-draws")
    shares = split_quotas(drawn.groupBy("idx").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    ranks = shares.where("quota > 0").select("idx", "shard", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("quota") - 1)).alias("rank"))
    draws = materialize(drawn.join(ranks, ["idx", "rank"]).select("idx", "block", "epoch", "shard", "part"), "mix-shards")
    # Documents of the one partly taken block of each source.
    part = last.where("part").select("idx", "block", (F.col("rest") - F.col("before")).alias("room"))
    some = dealt.select("id", "size", "idx", "block").where("size > 0").join(part, ["idx", "block"])
    same = some.groupBy("idx", "block", "id", "size").agg(F.first("room").alias("room"), F.sum("size").alias("words"))
    item = F.struct(F.xxhash64(F.lit(seed), F.lit("doc"), "id", "size").alias("h"), "id", "size", "words")
    order = lambda t, x: F.struct(F.xxhash64(x["h"], t).alias("h"), x["id"].alias("id"), x["size"].alias("size"), x["words"].alias("words"))
    fills = F.transform(F.sequence(F.lit(1), F.lit(TRIES)), lambda t: _fill(F.array_sort(F.transform("items", lambda x: order(t, x))), F.col("room")))
    lists = same.groupBy("idx", "block").agg(F.first("room").alias("room"), F.sort_array(F.collect_list(item)).alias("items"))
    picks = lists.select("idx", "block", F.explode(F.array_min(fills)["got"]).alias("x")).select("idx", "block", "x.id", "x.size")
    picks = materialize(picks, "mix-picks")
    return sources, draws, picks


def _dealt(rows: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame], seed: int) -> DataFrame:
    """rows with the draws of their blocks and whether picks names them.  The
    tables of the plan hold a row per source or block: small, and Spark checks
    their size before it broadcasts one."""
    sources, draws, picks = plan
    s = sources.select(F.col("source").alias("_source"), "idx", "source_size", "target", "blocks")
    d = rows.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("block", _block(F.col("idx"), F.col("blocks"), seed))
    by_block = draws.groupBy("idx", "block").agg(F.collect_list(F.struct("epoch", "shard", "part")).alias("drawn"))
    d = d.join(by_block, ["idx", "block"], "left")
    p = picks.select(F.col("idx").alias("_i"), F.col("block").alias("_b"), F.col("id").alias("_id"), F.col("size").alias("_s"), F.lit(True).alias("picked"))
    on = (F.col("idx") == F.col("_i")) & (F.col("block") == F.col("_b")) & (F.col("size") == F.col("_s")) & F.col("id").eqNullSafe(F.col("_id"))
    d = d.join(p, on, "left").drop("_i", "_b", "_id", "_s")
    mine = F.filter(F.coalesce("drawn", F.array().cast("array<struct<epoch:long,shard:long,part:boolean>>")), lambda x: ~x["part"] | F.coalesce("picked", F.lit(False)))
    return d.withColumn("drawn", mine).drop("picked", "blocks", "block", "idx")


def _place(seed: int, shard: Column, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), shard, epoch, F.col("id"), F.col("size"))


def mix(docs: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame], seed: int = SEED) -> DataFrame:
    """docs (id, source, size and any columns) as the mix takes them: one row per
    draw with epoch, shard and place, the order within the shard."""
    d = _dealt(docs, plan, seed).withColumn("x", F.explode("drawn"))
    d = d.withColumns({"epoch": F.col("x.epoch"), "shard": F.col("x.shard")})
    return d.withColumn("place", _place(seed, F.col("shard"), F.col("epoch"))).drop("x", "drawn", "source_size", "target")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards: of each time the document is taken epoch, shard and place in the
    shard's order, as epoch:shard:place, comma-joined."""
    rows = materialize(sizes(read_table(spark, sf_dir, "documents")), "mix-sizes")
    taken = F.size("drawn") * F.col("size")
    where = F.transform(
        F.array_sort("drawn"),
        lambda x: F.concat_ws(":", x["epoch"].cast("string"), x["shard"].cast("string"), _place(SEED, x["shard"], x["epoch"]).cast("string")),
    )
    return _dealt(rows, plan_mix(rows), SEED).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"), F.array_join(where, ",").alias("shards")
    )


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them, whole rows.  Cases
    are those of the module: texts without words come as often as their block."""
    plan = plan_mix(materialize(sizes(docs), "mix-sizes"))
    inner = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")
    rows = docs.select(inner, F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"))
    return mix(rows, plan).repartition("shard", F.pmod("place", F.lit(64))).sortWithinPartitions("shard", "place").select("doc.*")
