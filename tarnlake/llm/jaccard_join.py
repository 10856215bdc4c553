"""Word n-gram Jaccard join, size-aware.

Two documents link when 100 * intersection >= percent * union of their sets of
distinct n-word shingles.  Equal sets form a class first; classes are joined.

All sets are ordered alike, shingles of rare words first, those frequent in the
corpus last.  Two linked sets share a shingle among the first n - o + 1 of each
(o: the least overlap that a set of n can have with a partner) and, where o is 2
or more, two of the first n - o + 2.  Small sets therefore meet in lists keyed by
every 2-subset of that prefix, large sets in the inverted lists of its single
shingles; sets just below the boundary are in both.  The boundary is where the
subsets of a set cost more than the entries of the lists it would scan.  The
place of a key in a set's order bounds the size of the partners that it can have
there; late keys only lead to smaller sets, so no two late entries are paired.

In a list, every set is compared with the list's smallest id first; the links
give components, and only sets of different components are compared further, as
a link inside a component changes nothing.  No candidate is dropped: a pair goes
only where what its prefixes share, and all that is left of the set whose prefix
ends first, cannot make the overlap.  Whole sets are read for the other pairs.

The order needs word and shingle frequencies of the whole corpus; two hashed
tables of CELLS counters hold them.  They only order: a wrong count costs time.

Defined cases: a null or empty text has an empty set, is linked with nothing
and is its own component; rows with a null id link with nothing and have a null
component.  Rows that share an id have the links of all of them: different texts
under one id are joined as nodes of their own, and their components then united.
Empty tables give an empty result, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, releasing, small_batches, text_or_empty, texts_of
from .components import components

CELLS = 1 << 20  # counters of each table
COMMON = 1 << 15  # a word is common from one in so many
CHUNKS = 64  # parts in which the tables are summed
BEFORE = 24  # keys before an entry that are kept to see whether a pair has met already

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh3_64_digest

    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    return np.frombuffer(b"".join(map(xxh3_64_digest, words)), "<u8")


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """A hash per window of k words; fewer words are one window."""
    if not len(w):
        return w
    m = max(1, len(w) - k + 1)
    used = min(k, len(w))
    h = np.full(m, (used * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(used):
        h = (h ^ (h >> np.uint64(29))) * _B + w[j : j + m] * _A
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(31))


def _common_words(w: np.ndarray, k: int, common: np.ndarray) -> np.ndarray:
    """Number of common words in each window."""
    c = common[(w >> np.uint64(44)).astype(np.int64)].astype(np.int64)
    if len(w) < k:
        return c.sum(keepdims=True)
    s = np.concatenate([[0], np.cumsum(c)])
    return s[k:] - s[:-k]


def least_overlap(n: int, percent: int) -> int:
    """Smallest intersection of a set of n with any partner."""
    return -(-percent * n // 100)


def needed_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


# --- one pass over the texts: nodes and frequency tables -------------------------


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """Rows with kind 0: id, n, print of the set; kind 1: a chunk of the counts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, CELLS), np.int64)
        waiting: tuple[list, list] = ([], [])
        size = 0

        def count():
            nonlocal size
            for t in (0, 1):
                if waiting[t]:
                    tables[t] += np.bincount(np.concatenate(waiting[t]), minlength=CELLS)
                    waiting[t].clear()
            size = 0

        def batch_of(kind, ids, ns, prints, chunks, counts):
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(ns), pa.int32()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(prints, pa.binary()), pa.array(chunks, pa.int32()), pa.array(counts, pa.binary())],
                names=["kind", "id", "n", "print", "chunk", "counts"],
            )

        for batch in batches:
            ns, prints = [], []
            for text in batch.column(1).to_pylist():
                w = word_hashes(text)
                s = np.unique(shingles(w, k))
                ns.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                waiting[0].append((w >> np.uint64(44)).astype(np.int32))
                waiting[1].append((s >> np.uint64(44)).astype(np.int32))
                size += len(w)
                if size > 1_000_000:
                    count()
            yield batch_of(0, batch.column(0), ns, prints, [None] * len(ns), [None] * len(ns))
        count()
        if tables.any():
            width = 2 * CELLS // CHUNKS
            parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in tables.ravel().reshape(CHUNKS, width)]
            yield batch_of(1, [None] * CHUNKS, [0] * CHUNKS, [None] * CHUNKS, list(range(CHUNKS)), parts)

    return docs.mapInArrow(releasing(run), "kind int, id long, n long, print binary, chunk int, counts binary")


def _tables(scan: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Which cells hold common words, how frequent the shingles of a cell are (0:
    no more than chance), and the mean length of a list.  The driver gets CELLS
    numbers of each table."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "counts": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    def combine(df: DataFrame) -> DataFrame:
        return df.groupBy("chunk").applyInPandas(add, "chunk int, counts binary")

    got = combine(scan.where("kind = 1").select("chunk", "counts")).collect()
    flat = np.zeros((CHUNKS, 2 * CELLS // CHUNKS), np.int64)
    for r in got:
        flat[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    words, shings = flat.ravel().reshape(2, CELLS)
    mean = shings.mean()
    common = (words > max(8, words.sum() / COMMON)).astype(np.uint8)
    over = (shings - mean) / (3 * math.sqrt(mean) + 4)
    level = np.where(over > 1, np.log2(np.maximum(over, 1)) + 1, 0).astype(np.uint8)
    light = shings[level == 0].astype(float)
    spread = float((light**2).sum() / max(1.0, light.sum()) - light.mean()) if len(light) else 1.0
    return common, level, max(1.0, spread)


# --- candidate lists ---------------------------------------------------------------


def boundary(percent: int, list_length: float) -> int:
    """The first size whose 2-subsets outnumber the list entries that it would scan."""
    for n in range(2, 100_000):
        p = n - least_overlap(n, percent) + 1
        if math.comb(p + 1, 2) > p * (1 + list_length):
            return n
    return 100_000


def _prefixes(docs: DataFrame, k: int, percent: int, common: np.ndarray, level: np.ndarray) -> DataFrame:
    """(id, n, prefix): the first n - o + 2 shingles of each set.  Equal sets of a task are named once."""
    tables = docs.sparkSession.sparkContext.broadcast((common, level))  # 2 * CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_common, frequent = tables.value
        seen: set[bytes] = set()
        for batch in batches:
            ids, ns, firsts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = word_hashes(text)
                s, at = np.unique(shingles(w, k), return_index=True)
                n = len(s)
                if n < 2 or doc is None:  # a set of one only links with its equals
                    continue
                mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if mark in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(mark)
                rank = _common_words(w, k, is_common)[at] + (k + 1) * frequent[(s >> np.uint64(44)).astype(np.int64)].astype(np.int64)
                ids.append(doc)
                ns.append(n)
                firsts.append(s[np.lexsort((s, rank))[: n - least_overlap(n, percent) + 2]].view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            flat = pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "n", "prefix"])

    return docs.mapInArrow(releasing(run), "id long, n int, prefix array<long>")


def _keys(prefixes: DataFrame, percent: int, limit: int) -> DataFrame:
    """(key, id, size): the lists that a set is in; size has the set's own size
    and, in its lower half, that of the largest partner it can have there."""

    def sized(n: int, place: np.ndarray) -> np.ndarray:
        return (n << 32) + np.maximum((n - place) * (100 + percent) // percent - n, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, n, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                first = prefix.values.to_numpy().view(np.uint64)
                own = []
                if n < limit:
                    i, j = np.triu_indices(len(first), 1)
                    a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
                    own.append(((a ^ (b >> np.uint64(7))) * _A + b * _B, sized(n, j - 1)))  # i < j
                if n >= least_overlap(limit, percent):
                    p = n - least_overlap(n, percent) + 1
                    own.append((first[:p], sized(n, np.arange(p))))
                for key, size in own:
                    keys.append(key.view(np.int64))
                    sizes.append(size)
                    ids.append(np.full(len(key), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, sizes)], names=["key", "id", "size"])

    return prefixes.mapInArrow(releasing(run), "key long, id long, size long")


def _own(size: Column) -> Column:
    return F.shiftright(size, 32)


def _most(size: Column) -> Column:
    return size.bitwiseAND((1 << 32) - 1)


def _pairable(a: Column, b: Column, percent: int) -> Column:
    """Whether entries of these sizes can be those of a link."""
    n, m = _own(a), _own(b)
    return (m <= _most(a)) & (n <= _most(b)) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, text) to batches of (id, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sets = [np.unique(shingles(word_hashes(t), k)).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "s"])

    return run


def _promising(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that by their prefixes may link."""
    side = lambda x: prefixes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}"))
    x = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("p_a", "p_b"))
    left = F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b"))
    x = x.select("a", "b", (shared + left).alias("most"), (F.col("n_a") + F.col("n_b")).alias("both"))
    return x.where(F.col("most") * (100 + percent) >= F.col("both") * percent).select("a", "b").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets pass."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(texts_of(texts, ids, _sets(k), "id long, s array<long>"), "join-sets")
    x = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b").join(sets.withColumnRenamed("id", "a"), "a")
    both = F.size(F.array_intersect("s", "t"))
    x = x.select("a", "b", both.alias("i"), (F.size("s") + F.size("t")).alias("sum"))
    return x.where(F.col("i") * 100 >= (F.col("sum") - F.col("i")) * percent).select("a", "b")


def jaccard_join(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n, component."""
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    counted = texts.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    shared = materialize(counted, "join-shared-ids")
    if shared.isEmpty():
        return _join(texts, k, percent)
    # The different texts of a shared id become nodes with numbers above all ids.
    digest = F.sha2("text", 256)
    rows = materialize(texts.join(shared, "id", "left_semi").select("id", digest.alias("digest"), "text"), "join-shared")
    top = texts.agg(F.max("id")).first()[0] + 1
    own = rows.dropDuplicates(["id", "digest"]).withColumn("node", F.monotonically_increasing_id() + F.lit(top).cast("long"))
    own = materialize(own, "join-shared-nodes")  # so that the numbers stay
    alone = texts.join(shared, "id", "left_anti")
    found = materialize(_join(alone.unionByName(own.select(F.col("node").alias("id"), "text")), k, percent), "join-nodes")
    # Components that an id's texts lie in are one; its name is the smallest id in it.
    of = own.select("node", F.col("id").alias("real"), "digest").join(found.withColumnRenamed("id", "node"), "node")
    low = of.groupBy("real").agg(F.min("component").alias("b"))
    united = components(of.join(low, "real").select(F.col("component").alias("a"), "b"), "join-united")
    part = of.select("component").distinct().join(united.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    part = materialize(part.select("component", F.coalesce("whole", "component").alias("whole")), "join-parts")  # components with a shared id
    reals = alone.select("id").join(found.select("id", "component"), "id").select("component", F.col("id").alias("real")).unionByName(of.select("component", "real"))
    names = reals.join(part, "component").groupBy("whole").agg(F.min("real").alias("name"))
    name = part.join(names, "whole").select("component", "name")
    plain = found.where(F.col("id").isNull() | (F.col("id") < top)).join(name, "component", "left").select("id", "n", F.coalesce("name", "component").alias("component"))
    again = rows.select("id", "digest").join(of.select(F.col("real").alias("id"), "digest", "n", "component"), ["id", "digest"]).join(name, "component")
    return plain.unionByName(again.select("id", "n", F.col("name").alias("component")))


def _join(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """jaccard_join of (id, text), where ids that are not null are different."""
    scan = materialize(_scan(texts, k), "join-scan")
    common, level, length = _tables(scan)
    nodes = scan.where("kind = 0").select("id", "n", "print")
    classes = nodes.where("n > 0 and id is not null").groupBy("print").agg(F.min("id").alias("rep"))
    member = materialize(nodes.join(classes, "print", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "join-classes")
    rep = member.where("id is not null").select("id", "rep")

    prefixes = materialize(_prefixes(texts, k, percent, common, level), "join-prefixes")
    keys = _keys(prefixes, percent, boundary(percent, length)).repartition("key")
    early = _most(F.col("size")) >= _own(F.col("size"))
    several = (F.col("lo") < F.col("hi")) & F.col("early")
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(early).alias("early")).where(several).select("key")
    listed = keys.join(shared, "key").join(rep, "id").select("key", F.col("rep").alias("id"), "size").distinct()
    listed = materialize(listed, "join-listed")
    pivot = F.min(F.when(early, F.struct("id", "size"))).alias("pivot")
    pivots = listed.groupBy("key").agg(pivot, F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi and pivot is not null")
    listed = materialize(listed.join(pivots.select("key", F.col("pivot.id").alias("pivot"), F.col("pivot.size").alias("pivot_size")), "key"), "join-lists")
    # A class is named by its smallest id, whose prefix another task may have named for it.
    own = prefixes.join(rep, "id").select(F.col("rep").alias("id"), "n", "prefix").dropDuplicates(["id", "n"])
    own = materialize(own.join(listed.select("id").distinct(), "id", "left_semi"), "join-own")

    star = listed.where((F.col("id") != F.col("pivot")) & _pairable(F.col("size"), F.col("pivot_size"), percent))
    star = star.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    star = materialize(_promising(star, own, percent), "join-star")
    links = materialize(_linked(star, texts, k, percent), "join-links")
    found = components(links, "join-round")

    left = listed.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = materialize(left.join(mixed, "key").where("id <> pivot").select("key", "id", "size", "component"), "join-left")
    # The pivot has been compared with all; of two others one is early.  A pair is
    # made where it first meets: not if the keys just before have one in common.
    at = F.expr("int(array_position(prefix, key))")
    before = F.when(at > 1, F.slice("prefix", F.greatest(F.lit(1), at - BEFORE), F.least(F.lit(BEFORE), at - 1))).otherwise(F.array().cast("array<long>"))
    left = left.join(own.select("id", "prefix"), "id").withColumn("before", before).drop("prefix")
    other = left.where(early).select("key", F.col("id").alias("b"), F.col("size").alias("other_size"), F.col("component").alias("other"), F.col("before").alias("other_before"))
    fresh = (F.col("component") != F.col("other")) & ~F.arrays_overlap("before", "other_before")
    rest = left.join(other, (left["key"] == other["key"]) & fresh & _pairable(F.col("size"), F.col("other_size"), percent))
    rest = rest.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
    rest = materialize(_promising(rest, own, percent), "join-rest")
    more = materialize(_linked(rest, texts, k, percent).unionByName(links), "join-links")
    final = components(more, "join-final").withColumnRenamed("node", "rep")
    out = member.join(final, "rep", "left")
    return out.select("id", "n", F.coalesce("component", "rep").alias("component"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join(read_table(spark, sf_dir, "documents"), 3, 90)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component (five words, 0.8) the smallest id stays, with
    all rows that have it.  Rows with a null id stay, as do texts without words."""
    out = jaccard_join(docs, 5, 80).where("id = component or id is null").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(out, docs["doc_id"].eqNullSafe(out["doc_id"]), "left_semi")
