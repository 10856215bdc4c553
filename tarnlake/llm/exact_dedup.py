"""Exact dedup against immutable snapshots.

write_snapshot() stores the distinct digests of a set of documents in buckets,
one folder each, and one static binary-fuse filter per bucket; a snapshot is
written once and never changed.  dedup_batch() groups the digests of an incoming
batch among themselves, screens them by the filters of all snapshots, and reads
only the buckets that positives hit; there normalised texts are compared byte by
byte.

exact_dedup() divides one table into a snapshot and a batch and merges both.

Defined cases: a null text counts as empty; all empty texts are equal.  Rows
with a null id are rows like any other, and rank after other ids in a tie; the
byte check finds their texts by digest.  Repeated rows are members of their
group.  An empty table gives an empty snapshot and an empty result.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, fresh_path, materialize, read_table, small_batches, text_or_empty, texts_of

BUCKET_KEYS = 100_000  # mean number of distinct digests in a bucket


# --- the filter -----------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    h = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for n keys."""
    length = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
    return length, max(3, math.ceil(n * factor / length) + 2)


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    base = first * np.uint64(length)
    a = base + (h & mask)
    b = base + np.uint64(length) + ((h >> np.uint64(18)) & mask)
    c = base + np.uint64(2 * length) + ((h * _M1 >> np.uint64(40)) & mask)
    return np.stack([a, b, c]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFFFF)).astype(np.uint16)


def build_fuse(keys: np.ndarray) -> bytes:
    """A binary-fuse filter with 16-bit fingerprints over distinct uint64 keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    length, segments = _shape(n)
    for seed in range(1, 200):
        if seed % 20 == 0:
            segments += max(1, segments // 10)
        h = _mix(keys, seed)
        slots = _slots(h, length, segments)
        size = segments * length
        count = np.bincount(slots.ravel(), minlength=size)
        member = np.zeros(size, np.int64)  # xor of the indices of the keys in a slot
        index = np.arange(n, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(member, row, index)
        order, alone = [], np.flatnonzero(count == 1)
        done = np.zeros(n, bool)
        while len(alone):
            key = member[alone]
            key, at = np.unique(key, return_index=True)
            fresh = ~done[key]
            key, slot = key[fresh], alone[at][fresh]
            if not len(key):
                break
            done[key] = True
            order.append((key, slot))
            touched = slots[:, key]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(member, row, key)
            alone = np.unique(touched.ravel())
            alone = alone[count[alone] == 1]
        if done.all():
            table, prints = np.zeros(size, np.uint16), _prints(h)
            for key, slot in reversed(order):
                s = slots[:, key]
                table[slot] = 0
                table[slot] = prints[key] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
            return np.array([seed, length, segments], np.int64).tobytes() + table.tobytes()
    raise ValueError("no seed gives a filter")


def probe_fuse(blob: bytes, keys: np.ndarray) -> np.ndarray:
    seed, length, segments = (int(x) for x in np.frombuffer(blob[:24], np.int64))
    table = np.frombuffer(blob[24:], np.uint16)
    h = _mix(keys.astype(np.uint64), seed)
    s = _slots(h, length, segments)
    return (table[s[0]] ^ table[s[1]] ^ table[s[2]]) == _prints(h)


def _key64(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x)[8:16] for x in digests), ">u8").astype(np.uint64)


# --- the operator ---------------------------------------------------------------


def normalised(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest (SHA-256 of the normalised text), length."""
    t = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        digest(t).alias("digest"),
        F.char_length(t).cast("long").alias("length"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """One row per digest; the best row has the longest text, then the smallest
    id; rep is a member with an id, where there is one."""
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("id").isNull().alias("n"), F.col("id").alias("i")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size"), F.min("id").alias("rep"))


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def build_filters(groups: DataFrame) -> DataFrame:
    """(bucket, filter): one filter per bucket of (bucket, digest)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "filter": [build_fuse(_key64(pdf["digest"]))]})

    return groups.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


GROUP = "digest binary, best struct<l:long,n:boolean,i:long>, size long, rep long"


@dataclass(frozen=True)
class Snapshot:
    """A set of digests on disk: digests/bucket=<n>/ and filters/."""

    path: str
    buckets: int

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("bucket int, filter binary").parquet(f"{self.path}/filters")

    def groups(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """(digest, best, size, rep, bucket) of all buckets, or of some: only their folders are read."""
        found = spark.read.schema(f"{GROUP}, bucket int").parquet(f"{self.path}/digests")
        return found if buckets is None else found.where(F.col("bucket").isin(buckets)) if buckets else found.where("false")


def write_snapshot(rows: DataFrame, path: str, buckets: int | None = None) -> Snapshot:
    """The distinct digests of rows (digests()) as a snapshot at path."""
    spark = rows.sparkSession
    buckets = buckets or max(1, math.ceil(rows.count() / BUCKET_KEYS))
    groups = _groups(rows).withColumn("bucket", _bucket(buckets))
    groups.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/digests")
    build_filters(Snapshot(path, buckets).groups(spark)).write.parquet(f"{path}/filters")
    return Snapshot(path, buckets)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(bucket, digest) of the incoming digests that a snapshot's filters do not rule out."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.iloc[:0]
        return left.loc[probe_fuse(bytes(right["filter"].iloc[0]), _key64(left["digest"]))]

    incoming = groups.select(_bucket(snapshot.buckets).alias("bucket"), "digest")
    filters = snapshot.filters(groups.sparkSession)
    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "bucket int, digest binary")


def _same_bytes(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, same): whether the representatives' normalised texts are equal,
    byte by byte; groups without any id are represented by all their rows."""
    wanted = pairs.select("digest", F.explode(F.array("rep", "rep_s")).alias("id")).where("id is not null")
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    picked = texts_of(texts, wanted.select("id").distinct()).select("id", normalised(F.col("text")).alias("t"))
    seen = wanted.join(picked, "id").where(F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)) == F.col("digest")).select("digest", "t")
    nameless = pairs.where("rep is null or rep_s is null").select("digest").distinct()
    if not nameless.isEmpty():
        rows = texts.where("id is null").select(digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("t"))
        seen = seen.unionByName(rows.join(nameless, "digest", "left_semi"))
    return seen.groupBy("digest").agg((F.count_distinct("t") == 1).alias("same"))


def match(batch: DataFrame, snapshots: list[Snapshot], docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the batch's groups that a snapshot has too, after the byte
    check: digest, best_m and size_m over all of them.  docs holds the texts of
    both sides."""
    spark, found = docs.sparkSession, None
    for snapshot in snapshots:
        positive = materialize(screen(batch, snapshot), "dedup-screened")
        # A number per bucket of BUCKET_KEYS digests at most.
        hit = [r["bucket"] for r in positive.select("bucket").distinct().collect()]
        exact = snapshot.groups(spark, hit).select("digest", F.col("best").alias("best_s"), F.col("size").alias("size_s"), F.col("rep").alias("rep_s"))
        pairs = positive.select("digest").join(batch, "digest").join(exact, "digest")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return spark.createDataFrame([], "digest binary, best_m struct<l:long,n:boolean,i:long>, size_m long")
    pairs = materialize(found, "dedup-positives")
    same = _same_bytes(pairs, docs, id_col, text_col).where("same").select("digest")
    merged = pairs.join(same, "digest").groupBy("digest")
    return merged.agg(F.min(F.least("best", "best_s")).alias("best_m"), (F.first("size") + F.sum("size_s")).alias("size_m"))


def dedup_batch(docs: DataFrame, snapshots: list[Snapshot], known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document of a batch: id, keep_id, group_size, kept, digest,
    over the batch and the snapshots.  known holds the texts behind the snapshots."""
    rows = materialize(digests(docs, id_col, text_col), "dedup-digests")
    batch = materialize(_groups(rows), "dedup-batch")
    only = lambda df: df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    both = match(batch, snapshots, only(docs).unionByName(only(known)), id_col, text_col)
    return _answer(rows, batch.join(both, "digest", "left"), ["digest"])


def _answer(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    ends = ends.select(*keys, F.coalesce("best_m", "best")["i"].alias("keep_id"), F.coalesce("size_m", "size").cast("long").alias("group_size"))
    return rows.join(ends, keys).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_snapshot: Column | None = None, buckets: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest.

    in_snapshot tells which rows form the immutable snapshot; the rest is the
    incoming batch.  By default a hash of the id deals each row to one of the
    two.  The result does not depend on the division."""
    spark = docs.sparkSession
    if in_snapshot is None:
        in_snapshot = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    rows = materialize(digests(docs, id_col, text_col).withColumn("old", F.coalesce(in_snapshot, F.lit(False))), "dedup-digests")
    snapshot = write_snapshot(rows.where("old"), fresh_path(spark, "dedup-snapshot"), buckets)
    batch = materialize(_groups(rows.where("not old")), "dedup-batch")
    both = materialize(match(batch, [snapshot], docs, id_col, text_col), "dedup-matched")
    old = snapshot.groups(spark).select("digest", "best", "size", F.lit(True).alias("old"))
    ends = old.unionByName(batch.select("digest", "best", "size", F.lit(False).alias("old")))
    return _answer(rows, ends.join(both, "digest", "left"), ["digest", "old"])


# --- queries --------------------------------------------------------------------


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row that exact_dedup keeps stays.  Rows
    that share an id stay or go together; rows with a null id are told apart by
    their digests, which only they need here."""
    lone = lambda i, d: F.when(i.isNull(), d)
    kept = exact_dedup(docs).where("kept").select(F.col("id").alias("kept_id"), lone(F.col("id"), F.col("digest")).alias("kept_digest")).distinct()
    own = lone(docs["doc_id"], digest(F.coalesce(docs["text"], F.lit(""))))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & own.eqNullSafe(kept["kept_digest"]), "left_semi")
