"""Removal of repeated byte strings by a common-prefix-aware merge sort.

A byte goes when a SPAN-byte string covering it also starts earlier (in a
document of smaller rank, or earlier in the same one).  The rank of a document is
its id and, for rows without an id or with one that is not theirs alone, a number
among them.

Of all suffixes only those at anchors are sorted: the anchor of a SPAN-byte
string is the place of the smallest hash among its GRAM-byte substrings, the
leftmost of equals, so equal strings have the same anchor at the same offset.
The strings of one anchor start in one stretch; the bytes they cover, from the
anchor on and then those before it, are the anchor's key.

1. Count the GRAM hashes at all anchors.  A gram that occurs once cannot be in
   a repeated string; the others set a bit in a map of 2^MAP_BITS bits.
2. Tasks sort the keys of the remaining anchors into runs and write equal ones
   once: the later ones are repeated as a whole.  Runs are front-coded (length of the
   common prefix with the key before, and the rest) and dealt by ranges of the
   gram hash that leads each key.
3. A task merges the runs of a range with a loser tree.  A run's prefix lengths
   are those against the key just taken, so a comparison starts where the known
   prefixes end, and mostly needs no bytes at all.  Equal keys meet.  Of unequal
   keys of one gram the common prefixes tell which share the bytes from the anchor
   on; only the bytes before it are looked at.
4. Of the few grams that a task would get more of than it can hold (total /
   HOT_GRAMS or HOT_LEAST) every string is a key of its own, led by its own hash,
   so they go through the same runs and merges but over all ranges.

Defined cases: a null or empty text has no bytes.  A null id ranks after all
others.  Rows without an id, and rows that repeat one, are documents of their own,
in order of the SHA-256 of their texts; of equal ones the first keeps the text.
Empty tables give an empty result, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, small_batches, text_or_empty

SPAN, GRAM = 100, 32
MAP_BITS = 27  # the broadcast map has 2^MAP_BITS / 8 bytes, whatever the input
HOT_LEAST, HOT_GRAMS = 20_000, 1_000_000
LARGE = 1000  # keys of one gram that are compared with all their strings at once
RUN_KEYS = 120_000  # that a task holds before it sorts and writes a run
HOT_STRINGS = 100_000  # strings of hot grams to a run
CHUNK = 1 << 22  # starts handled at a time in a very long text
LAST = (1 << 63) - 1  # stands for a null id

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte substring, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(31)
    power, width = _P, 1
    while width < GRAM:
        h = h[:-width] * power + h[width:]
        power, width = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * width
    return _mix(h)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, the first and last start of the strings they stand for, and
    the hashes of their grams."""
    found = []
    total = len(data) - SPAN + 1  # strings
    low = np.uint64(0xFFFFFF)
    for base in range(0, max(0, total), CHUNK):
        part = data[base : min(len(data), base + CHUNK + SPAN - 1)]
        h = gram_hashes(part)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
        width, wanted = 1, SPAN - GRAM + 1
        while 2 * width <= wanted:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < wanted:
            m = np.minimum(m[: len(m) - (wanted - width)], m[wanted - width :])
        at = (m & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        found.append((at[first] + base, first + base, last + base, _mix(h[at[first]] ^ _P)))  # anew, as these are small hashes
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


# --- 1: grams that occur twice ---------------------------------------------------


def _count_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, grams, counts): the distinct gram hashes of a stretch of input, sorted, in bucket order."""
    shift = np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            nonlocal size
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            size = 0
            b = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            ends = [*cut[1:].tolist(), len(h)]
            n = np.minimum(n, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays(
                [pa.array(b[cut].astype(np.int32)), pa.array([h[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()), pa.array([n[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())],
                names=["bucket", "grams", "counts"],
            )

        for batch in batches:
            for text in batch.column(1):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if len(data) >= SPAN:
                    held.append(anchors(data)[3])
                    size += len(held[-1])
                    if size > 1_500_000:
                        yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, grams binary, counts binary")


def _repeated_grams(counted: DataFrame, buckets: int, hot_least: int) -> tuple[bytes, np.ndarray]:
    """The bit map of grams that occur twice, and the hashes of the hottest ones."""
    bits = (1 << MAP_BITS) // buckets  # of the map, per bucket

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["grams"]])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["counts"]]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total, h = np.add.reduceat(n, cut), h[cut]
        flags = np.zeros(bits, np.uint8)
        flags[((h[total > 1] >> np.uint64(64 - MAP_BITS)) & np.uint64(bits - 1)).astype(np.int64)] = 1
        hot = total >= hot_least
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "map": [zlib.compress(np.packbits(flags).tobytes(), 1)], "hot": [h[hot].tobytes()], "hot_n": [total[hot].astype(np.int64).tobytes()], "n": [int(total.sum())]})

    rows = counted.groupBy("bucket").applyInPandas(merge, "bucket int, map binary, hot binary, hot_n binary, n long").collect()
    parts = [bytes(bits // 8)] * buckets
    for r in rows:
        parts[r["bucket"]] = zlib.decompress(r["map"])
    least = max(hot_least, sum(r["n"] for r in rows) // HOT_GRAMS)
    hot = [np.frombuffer(r["hot"], np.uint64)[np.frombuffer(r["hot_n"], np.int64) >= least] for r in rows]
    return b"".join(parts), np.sort(np.concatenate([*hot, np.zeros(0, np.uint64)]))


# --- 2: sorted, front-coded runs ---------------------------------------------------


def _common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def encode_run(keys: list[bytes], right: list[int], ids: list[int], places: list[int], nums: list[int] | None = None) -> bytes:
    """A sorted run: per key the common prefix with the one before and the rest."""
    prefix, rest, before = [], [], b""
    for k in keys:
        c = _common_prefix(before, k)
        prefix.append(c)
        rest.append(k[c:])
        before = k
    heads = [np.array(prefix, np.uint8), np.array([len(r) for r in rest], np.uint8), np.array(right, np.uint8), np.array(places, np.int64), np.array(ids, np.int64), np.array(nums or [0] * len(keys), np.int64)]
    return zlib.compress(len(keys).to_bytes(4, "little") + b"".join(x.tobytes() for x in heads) + b"".join(rest), 1)


class Run:
    """Reads a run key by key."""

    def __init__(self, blob: bytes):
        raw = zlib.decompress(blob)
        n = int.from_bytes(raw[:4], "little")
        take = lambda at, kind, size: np.frombuffer(raw, kind, n, at).tolist() if n else []
        self.prefix, self.size, self.right = (take(4 + j * n, np.uint8, 1) for j in range(3))
        self.place, self.rank = take(4 + 3 * n, np.int64, 8), list(zip(take(4 + 11 * n, np.int64, 8), take(4 + 19 * n, np.int64, 8)))
        self.raw, self.n, self.at, self.i, self.key = raw, n, 4 + 27 * n, -1, b""

    def step(self) -> int:
        """Moves on; the common prefix with the key before, or -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            self.key = None
            return -1
        c, m = self.prefix[self.i], self.size[self.i]
        self.key = self.key[:c] + self.raw[self.at : self.at + m]
        self.at += m
        return c


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, Run]]:
    """(common prefix with the key before, run at its key), in order of keys.

    Every loser in the tree knows its common prefix with the key that beat it.
    Of two that know theirs with the same key, the longer prefix is the smaller
    key; only equal prefixes need bytes, and those from the prefix on."""
    k = 1
    while k < len(runs):
        k *= 2
    known = [r.step() for r in runs] + [-1] * (k - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] > known[b]:
            return a, b
        if known[a] < known[b]:
            return b, a
        if known[a] < 0:
            return a, b
        x, y = runs[a].key, runs[b].key
        c = _common_prefix(x, y, known[a])
        if x <= y:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    tree, winners = [0] * k, [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        winners[i], tree[i] = play(winners[2 * i], winners[2 * i + 1])
    top = winners[1] if k > 1 else 0
    while known[top] >= 0:
        yield known[top], runs[top]
        known[top] = runs[top].step()
        i = (top + k) // 2
        while i:
            a, b = tree[i], top
            if known[a] > known[b]:
                top, tree[i] = a, b
            elif known[a] == known[b] and known[a] >= 0:
                top, tree[i] = play(b, a)
            i //= 2


def _spans_of(starts: list[int]) -> list[tuple[int, int]]:
    """Byte spans of the strings at sorted starts."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + SPAN)
        else:
            out.append((s, s + SPAN))
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _offsets(key: bytes, right: int) -> range:
    """Offsets of the anchor in the strings that a key stands for."""
    left = len(key) - 8 - right
    return range(max(0, SPAN - right), left + 1)


def _strings(key: bytes, right: int) -> Iterator[tuple[int, bytes]]:
    """(offset of the anchor, string) of the strings that a key stands for."""
    text = key[8 + right :] + key[8 : 8 + right]  # bytes before the anchor, and from it on
    left = len(key) - 8 - right
    for o in _offsets(key, right):
        yield o, text[left - o : left - o + SPAN]


_PIECES = "kind int, part int, blob binary, id long, num long, first long, last long"
_SPAN_ROW, _RUN_ROW = 0, 1


def _runs(docs: DataFrame, bitmap: bytes, hot: np.ndarray, parts: int) -> DataFrame:
    """Spans already known to repeat, and runs by part."""
    sent = docs.sparkSession.sparkContext.broadcast((zlib.compress(bitmap, 1), hot.tobytes()))  # bounded: see MAP_BITS, HOT_GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, heat = np.frombuffer(zlib.decompress(sent.value[0]), np.uint8), frozenset(np.frombuffer(sent.value[1], np.uint64).tolist())
        entries: list[tuple[bytes, int, tuple[int, int], int]] = []  # key, bytes from the anchor on, rank, place of the anchor

        names = [x.split()[0] for x in _PIECES.split(", ")]
        kinds = (pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4)

        def sorted_runs(entries: list[tuple], hot: list[tuple] | None):
            """Spans and runs of (key, right, rank, place).  Of equal keys the first
            stays; those of hot grams that stay go to hot, if given, and not to a run."""
            entries.sort()
            chosen: dict[int, list[tuple]] = {}
            gone: dict[tuple[int, int], list[tuple[int, int]]] = {}
            before = None
            for e in entries:
                k, r, rank, place = e
                if before is not None and k == before[0] and r == before[1]:
                    if (rank, place) != before[2:]:
                        gone.setdefault(rank, []).append((place - (len(k) - 8 - r), place + r))
                    continue
                before = e
                h = int.from_bytes(k[:8], "big")
                if hot is not None and h in heat:
                    hot.append(e)
                else:
                    chosen.setdefault(h * parts >> 64, []).append(e)
            rows = [(_SPAN_ROW, None, None, *rank, a, b) for rank, spans in gone.items() for a, b in _joined(spans)]
            for part, own in chosen.items():
                blob = encode_run([e[0] for e in own], [e[1] for e in own], [e[2][0] for e in own], [e[3] for e in own], [e[2][1] for e in own])
                rows.append((_RUN_ROW, part, blob, *[None] * 4))
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 20_000]), kinds)], names=names)

        def flush():
            hot: list[tuple] = []
            yield from sorted_runs(entries, hot)
            entries.clear()
            strings: list[tuple] = []
            for k, r, rank, place in hot:  # a key per string: its hash and its bytes
                strings += [(hashlib.blake2b(s, digest_size=8).digest() + s, SPAN, rank, place - o) for o, s in _strings(k, r)]
                if len(strings) > HOT_STRINGS:
                    yield from sorted_runs(strings, None)
                    strings.clear()
            if strings:
                yield from sorted_runs(strings, None)

        for batch in batches:
            for rank, text in zip(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()), batch.column(1)):
                buffer = text.as_buffer()
                data = np.frombuffer(buffer, np.uint8)
                if len(data) < SPAN:
                    continue
                at, first, last, h = anchors(data)
                bit = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                hit = np.flatnonzero(flags[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                if not len(hit):
                    continue
                raw, heads = buffer.to_pybytes(), h[hit].astype(">u8").tobytes()
                for j, (p, a, b) in enumerate(zip(at[hit].tolist(), first[hit].tolist(), last[hit].tolist())):
                    entries.append((heads[8 * j : 8 * j + 8] + raw[p : b + SPAN] + raw[a:p], b + SPAN - p, rank, p))
                if len(entries) > RUN_KEYS:
                    yield from flush()
        if entries:
            yield from flush()

    return docs.mapInArrow(run, _PIECES)


# --- 3: merge ------------------------------------------------------------------------


def _merge_part(blobs: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(id, num, first, last) of repeated spans in one range of keys."""
    group: list[list] = []  # keys of one gram in order: key, right, rank, place, common prefix with the one before

    def close():
        if len(group) < 2:
            return
        # Strings with the anchor at offset o are equal if their keys share the
        # SPAN - o bytes from the anchor on, as the prefixes tell, and the o bytes
        # before it.  A string has one offset, so many keys can be compared offset
        # by offset, to hold fewer of them at a time.
        turns = [range(SPAN)] if len(group) <= LARGE else [range(o, o + 1) for o in range(SPAN)]
        late: list[list[int]] = [[] for _ in group]
        for turn in turns:
            first: dict[tuple, tuple[tuple[int, int], int]] = {}
            same = [0] * (SPAN + 1)  # by offset, the first key with those bytes
            found = []
            for i, (key, right, doc, place, common) in enumerate(group):
                fresh = min(SPAN + 1, max(0, 8 + SPAN - common))
                same[:fresh] = [i] * fresh
                for o in _offsets(key, right) if len(turns) == 1 else [o for o in turn if o in _offsets(key, right)]:
                    s, at = (o, same[o], key[len(key) - o :] if o else b""), (doc, place - o)
                    found.append((i, s, at))
                    if s not in first or at < first[s]:
                        first[s] = at
            for i, s, at in found:
                if first[s] < at:
                    late[i].append(at[1])
        for (_, _, doc, _, _), starts in zip(group, late):
            for a, b in _spans_of(sorted(starts)):
                yield *doc, a, b

    for common, r in merge_runs([Run(b) for b in blobs]):
        key, right, doc, place = r.key, r.right[r.i], r.rank[r.i], r.place[r.i]
        if common < 8 + GRAM:
            yield from close()
            group = []
        same = None
        if group and common == len(key):
            for g in reversed(group):  # equal keys stand together
                if g[0] != key:
                    break
                if g[1] == right:
                    same = g
                    break
        if same is None:
            group.append([key, right, doc, place, common if group else 0])
            continue
        if (doc, place) < (same[2], same[3]):
            doc, place, same[2], same[3] = same[2], same[3], doc, place
        if (doc, place) != (same[2], same[3]):
            yield *doc, place - (len(key) - 8 - right), place + right
    yield from close()


def repeated_spans(docs: DataFrame, parts: int | None = None, hot_least: int = HOT_LEAST) -> DataFrame:
    """docs (id, text as binary, num) to (id, num, first, last): spans of repeated
    bytes, which may overlap.  No two rows have the same id and num."""
    spark = small_batches(docs).sparkSession
    parts = parts or max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 1 << max(4, (parts - 1).bit_length())
    bitmap, hot = _repeated_grams(_count_grams(docs, buckets), buckets, hot_least)
    pieces = materialize(_runs(docs, bitmap, hot, parts), "suffix-runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int]] = []

        def packed():
            columns = zip(*rows) if rows else [[]] * 4
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "num", "first", "last"])
            rows.clear()
            return got

        def merged(blobs):
            for row in _merge_part(blobs):
                rows.append(row)
                if len(rows) > 20_000:
                    yield packed()

        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part:
                    yield from merged(blobs)
                    part, blobs = p, []
                blobs.append(blob)
        yield from merged(blobs)
        yield packed()

    runs = pieces.where(f"kind = {_RUN_ROW}").select("part", "blob").repartition(parts, "part").sortWithinPartitions("part")
    merged = runs.mapInArrow(merge, "id long, num long, first long, last long")
    known = pieces.where(f"kind = {_SPAN_ROW}").select("id", "num", "first", "last")
    return merged.unionByName(known)


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text as binary) to (id, text, num, doc_id): num is 0 where an id
    is of one row, and numbers the rows of a repeated or absent one from 1."""
    rows = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text", "doc_id")
    shared = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("id") == LAST)).select("id")
    shared = materialize(shared, "suffix-shared-ids")
    if shared.isEmpty():
        return rows.select("id", "text", F.lit(0).cast("long").alias("num"), "doc_id")
    order = ["id", "absent", "digest"]
    own = rows.join(shared, "id", "left_semi").select("*", F.col("doc_id").isNull().alias("absent"), F.sha2("text", 256).alias("digest"))
    texts = own.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))  # ranked without the texts themselves
    before = F.sum("n").over(Window.partitionBy("id").orderBy("absent", "digest").rowsBetween(Window.unboundedPreceding, -1))
    texts = texts.select(*order, F.coalesce(before, F.lit(0)).alias("before"))
    copy = F.row_number().over(Window.partitionBy(*order).orderBy("digest"))
    own = own.withColumn("copy", copy).join(texts, order).select("id", "text", (F.col("before") + F.col("copy")).alias("num"), "doc_id")
    alone = rows.join(shared, "id", "left_anti").select("id", "text", F.lit(0).cast("long").alias("num"), "doc_id")
    return alone.unionByName(materialize(own, "suffix-shared"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, hot_least: int = HOT_LEAST) -> DataFrame:
    """One row per document: doc_id, kept (bytes), n_bytes, n_removed, n_spans."""
    texts = _ranked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("text")))
    spans = materialize(repeated_spans(texts.select("id", "text", "num"), parts, hot_least), "suffix-spans")
    by_doc = spans.groupBy("id", "num").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))  # of one document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                kept, sizes, removed, runs = [], [], [], []
                for text, found in zip(part.column(1), part.column(2).to_pylist()):
                    raw, out, at, n = text.as_py(), [], 0, 0
                    for x in found or ():
                        a, b = max(x["first"], 0), min(x["last"], len(raw))
                        if a > at or (not n and b > a):
                            out.append(raw[at:a])
                            n += 1
                        at = max(at, b)
                    out.append(raw[at:])
                    kept.append(b"".join(out))
                    sizes.append(len(raw))
                    removed.append(len(raw) - len(kept[-1]))
                    runs.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)]],
                    names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
                )

    rows = texts.join(by_doc, ["id", "num"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
