"""Progressive indexing: tables by priority, rows as micro-batches.

The scheduler lives on the driver and holds one item per table that is not yet
indexed; rows stay in Spark.  A ProgressiveIndex takes the rows that the scheduler
names next, links them in one batch and appends their mentions; between batches
queries see what is there and may raise the priority of the tables they return.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import path_exists

MENTION = "uri string, table_id string, row_idx int, col_idx int"


class Event(Enum):
    INDEX = "index"
    INSERTION = "insertion"
    SEARCH = "search"


@dataclass
class Item:
    """A table: rows left to index, and the next one."""

    table_id: str
    remaining: int
    priority: float = 1.0
    next_row: int = 0

    @property
    def indexed(self) -> bool:
        return self.remaining <= 0


@dataclass
class PriorityScheduler:
    """Highest priority first, then table_id.  A popped row lowers its table's
    priority by the rows of the largest table by the rows that are left."""

    items: dict[str, Item] = field(default_factory=dict)
    largest: int = 0
    _heap: list[tuple[float, str]] = field(default_factory=list)

    def add(self, table_id: str, rows: int, priority: float | None = None, first_row: int = 0) -> None:
        """New tables come at the current maximum."""
        if rows <= 0:
            return
        self.items[table_id] = Item(table_id, rows, self.max_priority() if priority is None else priority, first_row)
        self.largest = max(self.largest, rows)
        self._push(table_id)

    def _push(self, table_id: str) -> None:
        heapq.heappush(self._heap, (-self.items[table_id].priority, table_id))

    def _settle(self) -> None:
        while self._heap and (self._heap[0][1] not in self.items or -self._heap[0][0] != self.items[self._heap[0][1]].priority):
            heapq.heappop(self._heap)

    def max_priority(self) -> float:
        self._settle()
        return -self._heap[0][0] if self._heap else 1.0

    def update(self, table_id: str, priority: float) -> None:
        if table_id in self.items:
            self.items[table_id].priority = priority
            self._push(table_id)

    def boost(self, scores: dict[str, float]) -> None:
        """After a query: each result table gets the maximum times 1 + score."""
        top = self.max_priority()
        for table_id, score in scores.items():
            self.update(table_id, top * (1 + score))

    def pop(self, rows: int = 1) -> tuple[str, int, int] | None:
        """(table, first row, row after the last) of the next rows to index: up to
        rows of them of the table that is ahead."""
        self._settle()
        if not self._heap:
            return None
        item = self.items[self._heap[0][1]]
        heapq.heappop(self._heap)
        first = item.next_row
        for _ in range(min(rows, item.remaining)):
            item.remaining -= 1
            item.next_row += 1
            item.priority -= self.largest / max(1, item.remaining)
        if item.indexed:
            del self.items[item.table_id]
        else:
            self._push(item.table_id)
        return item.table_id, first, item.next_row

    def pop_row(self) -> str | None:
        """The table whose next row is to be indexed."""
        found = self.pop()
        return found and found[0]


class ProgressiveIndex:
    """Indexes the rows of a lake in order of the scheduler.

    link: (text, uri).  Mentions are appended below out, a folder per batch."""

    def __init__(self, spark: SparkSession, link: DataFrame, out: str, rows_per_pop: int = 1, listener: Callable[[Event, object], None] | None = None):
        self.spark, self.link, self.out, self.rows_per_pop = spark, link, out.rstrip("/"), rows_per_pop
        self.scheduler, self.cells, self._done_rows, self.batches = PriorityScheduler(), None, {}, 0
        self._tell = listener or (lambda event, what: None)
        if path_exists(spark, f"{self.out}-spans"):  # a driver that starts again goes on where the last one was
            spans = spark.read.schema("table_id string, _from int, _to int, batch int").parquet(f"{self.out}-spans")
            self._done_rows = {r["table_id"]: r["end"] for r in spans.groupBy("table_id").agg(F.max("_to").alias("end")).collect()}
            self.batches = spans.agg(F.max("batch")).first()[0] or 0

    def add_tables(self, new: DataFrame, cells: DataFrame | None = None) -> None:
        """Tables to index; cells, if given, holds all tables added so far.  The
        driver gets a name and two numbers per table."""
        self.cells = cells if cells is not None else new if self.cells is None else self.cells.unionByName(new)
        sizes = new.groupBy("table_id").agg(F.min("row_idx").alias("first"), (F.max("row_idx") + 1).alias("end"))
        for r in sorted(sizes.collect()):
            first = max(r["first"], self._done_rows.get(r["table_id"], 0))
            self.scheduler.add(r["table_id"], r["end"] - first, first_row=first)
            self._tell(Event.INSERTION, r["table_id"])

    @property
    def done(self) -> bool:
        return not self.scheduler.items

    def step(self, pops: int) -> int:
        """Indexes the rows of the next pops in one batch; the number of rows."""
        spans: dict[str, list[int]] = {}
        taken = 0
        for _ in range(pops):
            found = self.scheduler.pop(self.rows_per_pop)
            if found is None:
                break
            table_id, first, end = found
            spans.setdefault(table_id, [first, end])[1] = end  # rows of a table come one after another
            taken += end - first
        if not spans:
            return 0
        wanted = self.spark.createDataFrame([(t, a, b) for t, (a, b) in spans.items()], "table_id string, _from int, _to int")
        rows = self.cells.join(wanted, "table_id").where("row_idx >= _from and row_idx < _to")
        found = rows.join(self.link, "text").select("uri", "table_id", "row_idx", "col_idx")
        self.batches += 1
        found.write.mode("overwrite").parquet(f"{self.out}/batch={self.batches}")
        wanted.write.mode("overwrite").parquet(f"{self.out}-spans/batch={self.batches}")
        self._tell(Event.INDEX, taken)
        return taken

    def boost(self, scores: dict[str, float]) -> None:
        """After a search: its tables come first."""
        self._tell(Event.SEARCH, scores)
        self.scheduler.boost(scores)

    def run_for(self, seconds: float, pops: int) -> None:
        """Steps until the time is up; a step that has begun is finished."""
        until = time.monotonic() + seconds
        while not self.done and time.monotonic() < until:
            self.step(pops)

    def finish(self, pops: int) -> DataFrame:
        """All rows that are left; the whole index."""
        while not self.done:
            self.step(pops)
        return self.mentions()

    def mentions(self) -> DataFrame:
        """The index so far."""
        return mentions_so_far(self.spark, self.out)


def mentions_so_far(spark: SparkSession, out: str) -> DataFrame:
    if not path_exists(spark, out):
        return spark.createDataFrame([], MENTION)
    return spark.read.schema(f"{MENTION}, batch int").parquet(out).drop("batch")


def index_stream(
    spark: SparkSession, cells_path: str, schema, index: ProgressiveIndex, checkpoint: str, pops: int, files: int = 1, after: Callable[[int], None] | None = None
) -> StreamingQuery:
    """New cell files add their tables to the index as they come, at the highest
    priority; after each one a step is made, then after(batch) may search and
    boost.  A table comes whole in one file.  Rows that are left when the stream ends are for finish()."""

    def arrive(batch: DataFrame, epoch: int) -> None:
        path = f"{index.out}-staged/batch={epoch}"
        rows = batch.repartition("table_id").sortWithinPartitions("table_id", "row_idx")
        rows.write.mode("overwrite").parquet(path)  # a batch that runs again replaces its own
        staged = lambda at: spark.read.schema(batch.schema).parquet(at)
        index.add_tables(staged(path), staged(f"{index.out}-staged"))
        index.step(pops)
        if after:
            after(epoch)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(cells_path)
    return stream.writeStream.foreachBatch(arrive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Uses of endpoints by day of a stream (ts, endpoint)."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "endpoint").agg(F.count(F.lit(1)).alias("uses"))
