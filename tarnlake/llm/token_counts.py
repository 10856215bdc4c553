"""Token counts that follow edits.

A text is cut into leaves at places where the pre-tokenizer always cuts: before
a space between a visible character and a letter.  A segment tree holds the sums
of the leaves' token counts.  An edit re-encodes only the leaves it touches,
with the neighbour whose boundary it changes, cuts what comes of them into leaves
again, and updates the sums above them.

A TreeStore keeps the trees: version 0 has one tree per row, every later version
the trees of the rows that its batch of edits changed.  Folders of a version are
written once.  A batch of edits loads the trees of the edited rows only and
encodes nothing but the touched regions.

op9 counts every document into a store, then redacts e-mail addresses and long
numbers as a batch of edits and counts again.

Defined cases: a null or empty text has 0 tokens and no leaves.  Edits of a text
must not overlap; an edit may delete everything.  A tree belongs to an id and the
SHA-256 of its text, so rows with a null id and different texts under one id are
told apart, and rows that repeat both share a tree and its edits.  Edits whose id
and digest no row has are left out.  Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, read_table, small_batches, text_or_empty

LEAF = 512  # characters of a leaf at least, but for the last one of a region
DIGEST_BYTES = 16  # of the SHA-256 that tells the texts of an id apart

#: What op9 edits: pattern and replacement.
REDACTIONS = ((r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"), (r"[0-9]{13,19}", "<NUMBER>"))
_EDIT = re.compile("|".join(f"({p})" for p, _ in REDACTIONS))

_ENCODERS: dict[str, object] = {}  # one per worker process


def encoder(path: str):
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def safe(text: str, i: int) -> bool:
    """Whether the pre-tokenizer always cuts before text[i]."""
    return 0 < i < len(text) - 1 and text[i] == " " and not text[i - 1].isspace() and text[i + 1].isalpha()


def leaves(text: str, size: int = LEAF) -> list[str]:
    out, start = [], 0
    while start < len(text):
        at = text.find(" ", start + size)
        while at != -1 and not safe(text, at):
            at = text.find(" ", at + 1)
        if at == -1:
            out.append(text[start:])
            break
        out.append(text[start:at])
        start = at
    return out


class CountTree:
    """Leaves of a text and a segment tree of their token counts: sums[1] is the
    total, sums[i] covers sums[2i] and sums[2i + 1], the leaves come last."""

    def __init__(self, parts: list[str], counts: list[int], count: Callable[[list[str]], list[int]], size: int = LEAF):
        self.parts, self.count, self.size = list(parts), count, size
        self.encoded = 0  # characters encoded again by edits
        self._build(list(counts))

    @classmethod
    def stored(cls, text: str, lengths: list[int], sums: list[int], count: Callable[[list[str]], list[int]], size: int = LEAF) -> CountTree:
        """The tree of a text from its stored leaf lengths and sums."""
        tree = cls.__new__(cls)
        tree.parts, at = [], 0
        for n in lengths:
            tree.parts.append(text[at : at + n])
            at += n
        if at != len(text):
            raise ValueError("the stored leaves are of another text")
        tree.count, tree.size, tree.encoded = count, size, 0
        tree.sums, tree.width = list(sums), len(sums) // 2
        return tree

    def _build(self, counts: list[int]) -> None:
        self.width = 1 << max(0, (len(counts) - 1).bit_length())
        self.sums = [0] * self.width + counts + [0] * (self.width - len(counts))
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def set(self, leaf: int, value: int) -> None:
        i = self.width + leaf
        self.sums[i] = value
        while i > 1:
            i //= 2
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def edit(self, edits: list[tuple[int, int, str]]) -> int:
        """Applies (start, end, replacement)s of the text as it is now; returns the new total."""
        ends, at = [], 0
        for p in self.parts:
            at += len(p)
            ends.append(at)
        regions: list[list] = []  # first leaf, last leaf, edits
        for start, end, new in sorted(edits):
            a = max(0, min(bisect_right(ends, start), len(ends) - 1))
            b = max(a, min(bisect_right(ends, max(start, end - 1)), len(ends) - 1))
            if a and start < ends[a - 1] + 2:  # the leaf's first two characters make it a leaf
                a -= 1
            while b < len(ends) - 1 and end >= ends[b] - 1:  # its end makes the next one a leaf
                b += 1
            if regions and a <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], b)
                regions[-1][2].append((start, end, new))
            else:
                regions.append([a, b, [(start, end, new)]])
        firsts = {r[0] for r in regions}
        changed = []  # first leaf, leaves before, leaves now, their counts
        for a, b, inside in regions:
            base = ends[a - 1] if a else 0
            old, out, at = "".join(self.parts[a : b + 1]), [], base
            for start, end, new in inside:
                out += [old[at - base : start - base], new]
                at = end
            text = "".join(out) + old[at - base :]
            if len(text) < self.size // 2 and b < len(ends) - 1 and b + 1 not in firsts:
                b += 1  # too short for a leaf: with the next one
                text += self.parts[b]
            pieces = leaves(text, self.size)
            self.encoded += len(text)
            changed.append((a, b + 1 - a, pieces, self.count(pieces)))
        if all(n == len(pieces) for _, n, pieces, _ in changed):
            for a, n, pieces, counts in changed:
                self.parts[a : a + n] = pieces
                for k, value in enumerate(counts):
                    self.set(a + k, value)
        else:  # other leaves: the sums are added up anew, nothing else is encoded
            values = self.sums[self.width : self.width + len(self.parts)]
            for a, n, pieces, counts in reversed(changed):
                self.parts[a : a + n] = pieces
                values[a : a + n] = counts
            self._build(values)
        return self.total


def redactions(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), REDACTIONS[m.lastindex - 1][1]) for m in _EDIT.finditer(text)]


#: A tree: leaf_chars are the leaves' lengths, sums the segment tree; was is the digest of the text before.
TREE = "doc_id long, digest binary, n_tokens long, leaf_chars array<int>, sums array<long>"
EDITED = TREE + ", was binary, n_edits long, n_chars_encoded_again long, text string"
EDITS = "doc_id long, digest binary, edits array<struct<start:int,end:int,new:string>>"


def text_digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, DIGEST_BYTES)


def _digest(text: str) -> bytes:
    import hashlib

    return hashlib.sha256(text.encode()).digest()[:DIGEST_BYTES]


def _arrow(schema: str) -> pa.Schema:
    edit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds.get(kind, edit)) for name, kind in (x.split(" ") for x in schema.split(", "))])


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def find_edits(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = redactions, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The edits that a function finds in texts, as EDITS; texts without edits have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(EDITS)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := edits(text):
                    rows.append((doc, _digest(text), [{"start": a, "end": b, "new": new} for a, b, new in found]))
            yield _packed(rows, schema)

    return _texts(docs, id_col, text_col).mapInArrow(run, EDITS)


class TreeStore:
    """Trees on disk, one folder per version.  now() is the trees as they stand."""

    def __init__(self, spark: SparkSession, root: str, vocabulary: str | None = None):
        self.spark, self.root, self.vocabulary, self.versions = spark, root, vocabulary or vocabulary_path(), 0

    def version(self, number: int) -> DataFrame:
        schema = TREE if not number else EDITED
        return self.spark.read.schema(schema).parquet(f"{self.root}/version={number}")

    def _counter(self):
        path = self.vocabulary
        return lambda: (lambda parts: [len(x) for x in encoder(path).encode_ordinary_batch(parts, num_threads=1)])

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Version 0: one tree per row of docs.  Encodes every text."""
        make = self._counter()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, schema = make(), _arrow(TREE)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = []
                for k in range(0, len(texts), 64):
                    split = [leaves(t) for t in texts[k : k + 64]]
                    counts, at = count([p for parts in split for p in parts]), 0
                    for doc, text, parts in zip(ids[k : k + 64], texts[k : k + 64], split):
                        tree = CountTree(parts, counts[at : at + len(parts)], count)
                        at += len(parts)
                        rows.append((doc, _digest(text), tree.total, [len(p) for p in parts], tree.sums))
                yield _packed(rows, schema)

        _texts(docs, id_col, text_col).mapInArrow(run, TREE).write.parquet(f"{self.root}/version=0")
        self.versions = 1
        return self.version(0)

    def now(self) -> DataFrame:
        """The trees as they stand: of each row that edits changed, the last version."""
        trees = self.version(0)
        for k in range(1, self.versions):
            new = self.version(k)
            old = new.select(F.col("doc_id").alias("_id"), F.col("was").alias("_was"))
            on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_was"))
            # As many rows as there were: rows that share a tree share its edits.
            moved = trees.select("doc_id", F.col("digest").alias("was")).join(new.withColumnRenamed("doc_id", "_id"), "was")
            moved = moved.where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "digest", "n_tokens", "leaf_chars", "sums")
            trees = trees.join(old, on, "left_anti").unionByName(moved)
        return trees

    def apply(self, edits: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The next version: one row per edited id and digest, with the new tree,
        text and digest.  edits: EDITS.  docs: the texts as they stand; only edited
        ones leave the scan."""
        make = self._counter()
        # Rows that share a tree share its edits.
        edits = materialize(edits.groupBy("doc_id", "digest").agg(F.first("edits").alias("edits")), "token-edits")
        keys = edits.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        wanted = _texts(docs, id_col, text_col).join(edits.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        texts = wanted.withColumn("digest", text_digest(F.col("text"))).groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
        mine = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
        trees = self.now().join(keys, mine, "left_semi").groupBy("doc_id", "digest").agg(F.first("leaf_chars").alias("leaf_chars"), F.first("sums").alias("sums"))
        named = lambda df: df.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
        rows = edits.join(named(texts), mine).drop("_id", "_digest").join(named(trees), mine).select("doc_id", "digest", "edits", "text", "leaf_chars", "sums")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, schema = make(), _arrow(EDITED)
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    tree = CountTree.stored(r["text"], r["leaf_chars"], r["sums"], count)
                    total = tree.edit([(e["start"], e["end"], e["new"]) for e in r["edits"]])
                    text = tree.text
                    out.append((r["doc_id"], _digest(text), total, [len(p) for p in tree.parts], tree.sums, r["digest"], len(r["edits"]), tree.encoded, text))
                yield _packed(out, schema)

        rows.mapInArrow(run, EDITED).write.parquet(f"{self.root}/version={self.versions}")
        self.versions += 1
        return self.version(self.versions - 1)


def count_tokens(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = redactions, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_leaves, and by the edits found in
    it n_edits, n_tokens_edited, n_chars_encoded_again."""
    store = TreeStore(docs.sparkSession, fresh_path(docs.sparkSession, "token-trees"), path)
    trees = store.build(docs, id_col, text_col)
    new = store.apply(find_edits(docs, edits, id_col, text_col), docs, id_col, text_col)
    new = new.select(F.col("doc_id").alias("_id"), F.col("was"), F.col("n_tokens").alias("n_new"), "n_edits", "n_chars_encoded_again")
    rows = trees.join(new, (F.col("digest") == F.col("was")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "doc_id", "n_tokens", F.size("leaf_chars").cast("long").alias("n_leaves"), zero("n_edits"),
        F.coalesce("n_new", "n_tokens").alias("n_tokens_edited"), zero("n_chars_encoded_again"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
