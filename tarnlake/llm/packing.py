"""Packing token ids into windows by the online sum-of-squares rule.

A document's ids are cut at window length; the last piece goes to the fill
level that keeps the sum of squares of the numbers of partly filled windows
least.  A level array holds those numbers, a stack per level the windows.  At
the end of a task the windows still open are emptied into one another from the
emptiest on, cutting pieces, and the last one is cut at powers of two, which
need no padding.

A task packs only the rows it reads, so packing needs no shuffle; a window is
identified by its task's number and a counter.  Input of many small tasks is read
by fewer, of LEAST_DOCS documents or more, so that few windows are emptied; column
rule tells which pieces were cut at window length (full), placed by the rule
(sum_of_squares) or moved at the end of a task (emptied).

Defined cases: a null text is empty and consists of the end id alone.  Rows
with a null id or that repeat are packed as documents of their own.  Empty
tables give an empty result, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, releasing, small_batches, text_or_empty

WINDOW = 4096
END_ID = 2
STAGE_CACHE_WORDS = 150_000
LEAST_DOCS = 4096  # documents of a task, on average
CACHE_WORDS = 1_500_000  # words whose ids a worker remembers; a full cache keeps the short ones

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, rule string"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII marks but for the apostrophe, which some rules of the vocabulary begin with.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space before it splits, and merges never cross
    it, so the ids of a text are those of its words one after another.  Words
    not seen lately are encoded together.  Words of lower-case letters need no
    normalising and no splitting, so a plainer tokenizer with the same merges
    takes them; their ends are the tokens that the vocabulary marks as word ends."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.plain, self.light = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = self.light.encode_special_tokens = True
        self.light.normalizer = normalizers.Sequence([])
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.most = most

    def _encode(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words.  Marks after letters are split off and taken as one,
        and case is dropped, so most new words are forms of a known one."""
        cache, forms, stems = self.cache, [], set()
        for w in words:
            stem = w.rstrip(_MARKS)
            mark = w[len(stem) :]
            if not stem.isalpha():  # other than ASCII letters
                text = stem.decode()
                low = text.lower()
                if not (text.isalpha() and low.isalpha() and max(text) < "\u0180"):  # Latin letters are normal as they are
                    cache[w] = self._encode(w.decode())
                    continue
                stem = low.encode()
            else:
                stem = stem.lower()
            forms.append((w, stem, mark))
            if stem not in cache:
                stems.add(stem)
            if mark and mark not in cache:
                cache[mark] = self._encode(mark.decode())
        order = list(stems)
        for k in range(0, len(order), 5000):
            part = order[k : k + 5000]
            ids = np.array(self.light.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cut) != len(part):
                raise ValueError("a word without an end token")
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, cut.tolist()):
                cache[w] = raw[at:end]
                at = end
        for w, stem, mark in forms:
            if w != stem:
                cache[w] = cache[stem] + cache[mark] if mark else cache[stem]

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        split = [t.split() for t in texts]
        cache = self.cache
        if len(cache) > self.most:
            for w in [w for w in cache if len(w) > 7]:
                del cache[w]
            if len(cache) > self.most // 2:
                cache.clear()
        found = [list(map(cache.get, words)) for words in split]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        new = {words[i] for words, gap in zip(split, gaps) for i in gap}
        if new:
            self._learn(list(new))
        for words, ids, gap in zip(split, found, gaps):
            for i in gap:
                ids[i] = cache[words[i]]
        return [b"".join(ids) for ids in found]


_CODERS: dict[tuple[str, int], WordIds] = {}  # one per worker process, so that its tasks share the cache


def coder(path: str, most: int) -> WordIds:
    if (path, most) not in _CODERS:
        _CODERS[path, most] = WordIds(path, most)
    return _CODERS[path, most]


class SumOfSquares:
    """Windows of a task.  put() gives the window and offset of a short piece."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # open windows by fill level; 0 and full stay 0
        self.stacks: dict[int, list[int]] = {}
        self.fill: dict[int, int] = {}
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, size: int) -> tuple[int, int]:
        w, n = self.window, self.count
        # Change of the sum of squares when a window moves from level h to h + size.
        to = 2 * n[size : w + 1] + 1
        to[-1] = 0  # a full window no longer counts
        cost = to - 2 * n[: w + 1 - size] + 1
        cost[0] = to[0]  # a new window leaves no level
        cost[1:][n[1 : w + 1 - size] == 0] = np.iinfo(np.int64).max
        level = int(cost.argmin())
        if level:
            at = self.stacks[level].pop()
            n[level] -= 1
        else:
            at = self.new()
        full = level + size
        if full < w:
            n[full] += 1
            self.stacks.setdefault(full, []).append(at)
            self.fill[at] = full
        else:
            self.fill.pop(at, None)
        return at, level


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def close_open(pieces: dict[int, list[list[int]]], fill: dict[int, int], packer: SumOfSquares) -> list[tuple[int, int, int, int, int, bool]]:
    """(document, start, length, window, offset, moved) of the pieces in open
    windows, after the emptiest have been poured into the fullest."""
    order = sorted(fill, key=lambda w: (-fill[w], w))
    out, i, j = [], 0, len(order) - 1
    was = {p[0]: (w, p[2]) for w in pieces for p in pieces[w]}  # window and length by the rule
    place = lambda doc, start, n, w, off: out.append((doc, start, n, w, off, was[doc] != (w, n))) if n else None
    for w in order:
        fill[w] = sum(p[2] for p in pieces[w])
    while i < j:
        room = packer.window - fill[order[i]]
        if not room:
            i += 1
            continue
        if not pieces[order[j]]:
            j -= 1
            continue
        doc, start, n = pieces[order[j]].pop()
        take = min(n, room)
        pieces[order[i]].append([doc, start + n - take, take])
        fill[order[i]] += take
        fill[order[j]] -= take
        if take < n:
            pieces[order[j]].append([doc, start, n - take])
    for k, w in enumerate(order):
        total = sum(p[2] for p in pieces[w])
        if total == packer.window or not total:
            off = 0
            for doc, start, n in pieces[w]:
                place(doc, start, n, w, off)
                off += n
            continue
        parts, left, at = [], 0, w
        queue = list(pieces[w])
        for size in _powers(total):
            off = 0
            while off < size:
                doc, start, n = queue[0]
                take = min(n, size - off)
                place(doc, start, take, at, off)
                off += take
                queue[0] = [doc, start + take, n - take]
                if take == n:
                    queue.pop(0)
            at = packer.new()
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, cache_words: int = CACHE_WORDS, give_back: bool = False, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per piece; columns as in SCHEMA.  give_back: workers return unused
    memory at the end of each task, for some CPU time."""
    path = tokenizer or tokenizer_path()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, packer, base = coder(path, cache_words), SumOfSquares(window), TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4").tobytes()
        tails: dict[int, tuple] = {}  # documents with a piece in an open window: id, tokens, place and ids of the tail
        held: dict[int, list[list[int]]] = {}
        rows: list[tuple] = []
        number = 0

        def emit(doc, start, data, total, w, off, rule):
            rows.append((doc, start, len(data) // 4, zlib.crc32(data), total, base + w, off, rule))

        def flush():
            kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)
            rows.clear()
            return got

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for k in range(0, len(texts), 256):
                for doc, data in zip(ids[k : k + 256], words.encode_batch(texts[k : k + 256])):
                    data += end
                    total = len(data) // 4
                    start = 0
                    while total - start >= window:
                        emit(doc, start, data[4 * start : 4 * (start + window)], total, packer.new(), 0, "full")
                        start += window
                    if start < total:
                        n = total - start
                        w, _ = packer.put(n)
                        tails[number] = (doc, total, start, data[4 * start :])
                        held.setdefault(w, []).append([number, start, n])
                        if w not in packer.fill:  # full: its pieces are final
                            off = 0
                            for d, s, m in held.pop(w):
                                name, whole, first, own = tails.pop(d)
                                emit(name, s, own[4 * (s - first) : 4 * (s - first + m)], whole, w, off, "sum_of_squares")
                                off += m
                        number += 1
                if len(rows) > 4000:
                    yield flush()
        for d, s, m, w, off, moved in close_open(held, packer.fill, packer):
            name, whole, first, own = tails[d]
            emit(name, s, own[4 * (s - first) : 4 * (s - first + m)], whole, w, off, "emptied" if moved else "sum_of_squares")
        yield flush()

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    tasks = max(1, docs.count() // least_docs)  # read from the footers of Parquet files
    if rows.rdd.getNumPartitions() > tasks:
        rows = rows.coalesce(tasks)
    return rows.mapInArrow(releasing(run) if give_back else run, SCHEMA)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as packed pieces; a document that comes several
    times is packed as often.  Its workers have run the stages before and keep some
    of their memory, so the word cache is small."""
    return pack(docs, cache_words=STAGE_CACHE_WORDS, give_back=True)
