"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every contract: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
BLANK_RE = r"[\x20\x09-\x0D]+"


_MADE: list[str] = []  # folders of this process below the shared one, oldest first


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it
    is unset, a local master (tests, one machine) gets a temporary one of our own;
    on a cluster that is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Removes at its end the folders that operators made within it, but for kept
    ones: what they served must have been written by then."""
    began = len(_MADE)
    yield
    for path in _MADE[began:]:
        if path not in kept:
            remove_path(spark, path)
    _MADE[began:] = [path for path in _MADE[began:] if path in kept]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is
    cut, later stages survive a lost executor, and sizes are known to AQE.  The
    folder stays until the scratch() around the call ends, or for good."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text that is not null."""
    t = F.btrim(text, F.lit(BLANKS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, BLANK_RE))).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding rows and bytes of an Arrow batch of its session: whole
    texts go to Python, and some are very long.  Plans are made when a result is
    used, so the bounds stay in the session; smaller ones of its own hold."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = _bytes(conf.get(f"spark.sql.execution.arrow.{key}"))
        if now <= 0 or now > most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


def _bytes(setting: str) -> int:
    """A number of a setting, which may have a unit."""
    digits = setting.strip().lower().rstrip("bkmgtp")
    unit = setting.strip().lower()[len(digits) :].rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]


Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: workers
    live on, and what they keep counts against the executor's later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def releasing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, with release() at the end of a task."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        release()

    return wrapped


MAPPED_IDS = 1 << 20  # up to so many documents are picked by a bit map of 2^24 bits, more by a join
MAP_BITS = 24


def texts_of(texts: DataFrame, ids: DataFrame, make: Callable[[Batches], Batches] | None = None, schema: str = "id long, text string") -> DataFrame:
    """The texts of ids and, where a bit map picks them, some others.  make, if
    given, turns their batches into others in the worker that picks them."""
    if ids.count() > MAPPED_IDS:
        found = texts.join(ids, "id", "left_semi")
        return found.mapInArrow(releasing(make), schema) if make else found
    place = F.shiftrightunsigned(F.xxhash64("id"), 64 - MAP_BITS)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << (MAP_BITS - 6), np.uint8)
        bits[pdf["bit"].to_numpy() & (len(bits) - 1)] = 1
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    at = ids.select(place.alias("bit")).distinct().withColumn("part", F.shiftright("bit", MAP_BITS - 6).cast("int"))
    rows = at.groupBy("part").applyInPandas(mark, "part int, bits binary").collect()  # 64 parts of 2^15 bytes
    parts = [bytes(1 << (MAP_BITS - 9))] * 64
    for r in rows:
        parts[r["part"]] = zlib.decompress(r["bits"])
    sent = texts.sparkSession.sparkContext.broadcast(b"".join(parts))

    def pick(batches: Batches) -> Batches:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select([0, 1])

    return texts.where("id is not null").withColumn("bit", place).mapInArrow(releasing(lambda batches: make(pick(batches)) if make else pick(batches)), schema)
