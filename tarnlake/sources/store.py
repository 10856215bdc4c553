"""Tables, embeddings and usage logs on disk.

Every change is an append of a new version: readers see whole versions, and a
task that runs again leaves nothing behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, remove_path
from .readers import CELL, read_embeddings

LOG = "table_id string, version long, present boolean"


class _Versions:
    """A folder of numbered Parquet folders."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _numbers(self) -> list[int]:
        if not path_exists(self.spark, self.root):
            return []
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)
        names = [x.getPath().getName() for x in found]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))

    def append(self, df: DataFrame) -> int:
        number = max(self._numbers(), default=0) + 1
        df.write.parquet(f"{self.root}/version={number}")
        return number

    def read(self) -> DataFrame:
        if not self._numbers():
            return self.spark.createDataFrame([], f"{self.schema}, version long")
        return self.spark.read.schema(f"{self.schema}, version long").parquet(self.root)

    def clear(self) -> None:
        remove_path(self.spark, self.root)


class LakeStore:
    """Tables by name: insert, names, count, cells, remove, clear.

    An insert refuses names that are present; a name that was removed may come
    again.  Removing writes a tombstone, so no data are rewritten."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._cells = _Versions(spark, f"{self.root}/cells", CELL)
        self._log = _Versions(spark, f"{self.root}/log", "table_id string, number long, present boolean")

    def _alive(self) -> DataFrame:
        """(table_id, number): present tables and the version that holds their cells."""
        last = self._log.read().groupBy("table_id").agg(F.max_by(F.struct("number", "present"), "version").alias("x"))
        return last.where("x.present").select("table_id", "x.number")

    def insert(self, cells: DataFrame) -> list[str]:
        """Stores the tables of cells; returns the names refused, as they are present."""
        new = cells.select("table_id").distinct()
        refused = [r["table_id"] for r in new.join(self._alive(), "table_id", "left_semi").collect()]  # names only
        fresh = cells.join(self._alive(), "table_id", "left_anti") if refused else cells
        # Sorted by table, so that row groups of other tables are skipped.
        number = self._cells.append(fresh.select(*[x.split()[0] for x in CELL.split(", ")]).repartition("table_id").sortWithinPartitions("table_id", "row_idx", "col_idx"))
        written = self._cells.read().where(F.col("version") == number).select("table_id").distinct()
        self._log.append(written.select("table_id", F.lit(number).cast("long").alias("number"), F.lit(True).alias("present")))
        return sorted(refused)

    def remove(self, table_id: str) -> bool:
        """Whether the table was there."""
        if not self._alive().where(F.col("table_id") == table_id).take(1):
            return False
        self._log.append(self.spark.createDataFrame([(table_id, 0, False)], "table_id string, number long, present boolean"))
        return True

    def names(self, predicate=None) -> DataFrame:
        """(table_id); predicate: a Column over table_id."""
        found = self._alive().select("table_id")
        return found if predicate is None else found.where(predicate)

    def count(self) -> int:
        return self._alive().count()

    def cells(self) -> DataFrame:
        alive = self._alive().withColumnRenamed("number", "version")
        return self._cells.read().join(alive, ["table_id", "version"], "left_semi").drop("version")

    def table(self, table_id: str) -> DataFrame:
        return self.cells().where(F.col("table_id") == table_id)

    def clear(self) -> None:
        self._cells.clear()
        self._log.clear()


class EmbeddingStore:
    """Embeddings by uri: of several of one uri the last inserted holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._rows = spark, _Versions(spark, root, "uri string, embedding array<double>")

    def insert(self, embeddings: DataFrame) -> None:
        rows = embeddings.select("uri", F.col("embedding").cast("array<double>").alias("embedding"))
        self._rows.append(rows.repartition("uri").sortWithinPartitions("uri"))

    def load(self, path: str, delimiter: str = " ") -> None:
        """Bulk load of a text file."""
        self.insert(read_embeddings(self.spark, path, delimiter))

    def all(self) -> DataFrame:
        rows = self._rows.read()
        if len(self._rows._numbers()) < 2:
            return rows.drop("version").dropDuplicates(["uri"])
        return rows.groupBy("uri").agg(F.max_by("embedding", "version").alias("embedding"))

    def get(self, uri: str) -> list[float] | None:
        """One embedding; the filter reaches the scan."""
        found = self._rows.read().where(F.col("uri") == uri).orderBy(F.desc("version")).select("embedding").take(1)
        return found[0]["embedding"] if found else None

    def get_many(self, uris: DataFrame) -> DataFrame:
        """(uri, embedding) of the given uris that have one."""
        return self.all().join(uris.select("uri").distinct(), "uri", "left_semi")

    def dimension(self) -> int:
        found = self._rows.read().select(F.size("embedding").alias("n")).take(1)
        return found[0]["n"] if found else 0

    def clear(self) -> None:
        self._rows.clear()


class UsageLog:
    """Uses of endpoints, appended one by one or in bulk, counted when read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._rows = spark, _Versions(spark, root, "ts timestamp, endpoint string")

    def add(self, uses: DataFrame) -> None:
        self._rows.append(uses.select("ts", "endpoint"))

    def record(self, endpoint: str) -> None:
        self.add(self.spark.range(1).select(F.current_timestamp().alias("ts"), F.lit(endpoint).alias("endpoint")))

    def read(self) -> DataFrame:
        return self._rows.read().drop("version")

    def clear(self) -> None:
        self._rows.clear()
