"""A semantic data lake in one object.

    lake = Engine(spark, "hdfs://…/lake")
    lake.load_embeddings("…/vectors.txt")
    lake.load_graph("…/graph.nt")
    lake.ingest("…/tables", table_prefix="", kg_prefix="")
    lake.search("kg:A<>kg:B#kg:C", k=10, similarity="TYPES")

Tables, graph and embeddings are stored below the root; index() derives a
snapshot of all that searches need, and searches read that snapshot only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, keyword, linking, prefilter, search, stats, tables
from .operators.search import Options, Query, QueryEntity
from .session import fresh_path, path_exists, remove_path, stored
from .sources import readers
from .sources.store import EmbeddingStore, LakeStore, UsageLog
from .streaming.progressive import Event, ProgressiveIndex

#: Names of similarities, with the cosine function where the name tells it.
SIMILARITIES = {
    "TYPES": ("TYPES", None), "PREDICATES": ("PREDICATES", None), "EMBEDDINGS": ("EMBEDDINGS", None),
    "JACCARD_TYPES": ("TYPES", None), "JACCARD_PREDICATES": ("PREDICATES", None),
    "EMBEDDINGS_NORM": ("EMBEDDINGS", "NORM_COS"), "EMBEDDINGS_ABS": ("EMBEDDINGS", "ABS_COS"), "EMBEDDINGS_ANG": ("EMBEDDINGS", "ANG_COS"),
    "COSINE_NORM": ("EMBEDDINGS", "NORM_COS"), "COSINE_ABS": ("EMBEDDINGS", "ABS_COS"), "COSINE_ANG": ("EMBEDDINGS", "ANG_COS"),
}
PREFILTERS = ("NONE", "HNSW", "LSH_TYPES", "LSH_PREDICATES", "LSH_EMBEDDINGS")

SNAPSHOT = {
    "link": "text string, uri string",
    "mention": "uri string, table_id string, row_idx int, col_idx int",
    "posting": "uri string, table_id string, col_idx int, n long",
    "pattern": "table_id string, cols array<int>, n long",
    "entity": "uri string, types array<string>, predicates array<string>, embedding array<double>, idf double, type_weight double",
    "type_idf": "type string, idf double",
    "tables": "table_id string, n_rows long, linked_rows long",
}


@dataclass(frozen=True)
class Config:
    """Settings of an engine."""

    neighbours: int = 10_000  # of a query entity, in the HNSW prefilter
    hashes: int = 8  # of a MinHash signature, and hyperplanes of a projection
    bands: int = 4
    votes: int = 1  # bands in which a table must meet the query
    column_wise: bool = False  # LSH signatures per column of a table
    aggregated: bool = False  # one LSH probe per column of the query
    keyword_hits: int = 10
    most_query_cells: int = 10_000  # a query enters plans as literals
    header_as_row: bool = True


@dataclass(frozen=True)
class Snapshot:
    """The derived tables of a lake, as Parquet below a path."""

    spark: SparkSession
    path: str

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SNAPSHOT:
            raise AttributeError(name)
        return self.spark.read.schema(SNAPSHOT[name]).parquet(f"{self.path}/{name}")

    @staticmethod
    def write(cells: DataFrame, kg: DataFrame, link: DataFrame, embeddings: DataFrame, path: str, mention: DataFrame | None = None) -> Snapshot:
        """Derives and writes everything; what later tables need is read back.

        Postings are sorted by entity and mentions by table, so that lookups skip
        the row groups of others."""
        spark = cells.sparkSession
        put = lambda name, df: stored(df.select(*[F.col(x.split()[0]).cast(" ".join(x.split()[1:])) for x in SNAPSHOT[name].split(", ")]), f"{path}/{name}")
        links = put("link", link)
        found = linking.mentions(cells, links) if mention is None else mention
        found = put("mention", found.repartition("table_id").sortWithinPartitions("table_id", "row_idx", "col_idx"))
        posting = put("posting", linking.postings(found).sortWithinPartitions("uri", "table_id"))
        pattern = put("pattern", linking.linked_patterns(found))
        rows = pattern.groupBy("table_id").agg(F.sum("n").alias("linked_rows"))
        sizes = cells.groupBy("table_id").agg(F.count_distinct("row_idx").alias("n_rows"))
        zero = F.coalesce("linked_rows", F.lit(0)).alias("linked_rows")
        tables = put("tables", sizes.join(rows, "table_id", "left").select("table_id", "n_rows", zero))
        n_tables = tables.agg(F.count(F.lit(1)).alias("n"))
        # A posting has one row per entity, table and column.
        idf = linking.entity_idf(posting.select("uri", "table_id").distinct(), n_tables)
        profile = linking.entity_profile(idf, kg, embeddings)
        plain = stored(profile.select("uri", "types", "predicates", "embedding", "idf"), f"{path}/_entity")
        weights = put("type_idf", linking.type_idf(plain))
        entity = plain.join(linking.type_weights(plain, weights), "uri", "left")
        put("entity", entity.withColumn("type_weight", F.coalesce("type_weight", F.lit(0.0))).sortWithinPartitions("uri"))
        remove_path(spark, f"{path}/_entity")
        return Snapshot(spark, path)

    @property
    def uris(self) -> DataFrame:
        return self.entity.select("uri")


def parse_query(query: str | Sequence[Sequence[str]]) -> tuple[tuple[str, ...], ...]:
    """Rows of cells; a text is 'a<>b#c'.  Rows without a cell are left out."""
    if isinstance(query, str):
        query = [r.split("<>") for r in query.split("#")]
    return tuple(r for r in (tuple(c for c in row if c) for row in query) if r)


def resolve_query(rows: tuple[tuple[str, ...], ...], snapshot: Snapshot, kg: DataFrame, embeddings: DataFrame) -> Query:
    """What the lake, and else the graph, knows of the cells of a query: an entity
    that neither knows has no types, no embedding and the idf 1."""
    spark = snapshot.spark
    asked = spark.createDataFrame([(u,) for u in sorted({u for r in rows for u in r})], "uri string")
    known = snapshot.entity.select("uri", "idf", F.lit(True).alias("known"))
    only = lambda df, key: df.join(asked.select(F.col("uri").alias(key)), key, "left_semi")
    found = linking.entity_profile(asked, only(kg, "s"), only(embeddings, "uri")).join(only(known, "uri"), "uri", "left")
    entities = {}
    for r in found.select("uri", "types", "predicates", "embedding", "idf", "known").collect():  # the cells of one query
        vector = None if r["embedding"] is None else tuple(r["embedding"])
        entities[r["uri"]] = QueryEntity(r["uri"], tuple(r["types"]), tuple(r["predicates"]), vector, 1.0 if r["idf"] is None else r["idf"], bool(r["known"]))
    return Query(rows, entities)


def type_weights(snapshot: Snapshot, query: Query) -> dict[str, float]:
    wanted = sorted({t for e in query.distinct for t in e.types})
    return {r["type"]: r["idf"] for r in snapshot.type_idf.where(F.col("type").isin(wanted)).collect()}


def candidates(query: Query, snapshot: Snapshot, method: str, config: Config) -> DataFrame | None:
    """(table_id) of the tables that a prefilter leaves; None without one.  A long
    query is split, and its parts vote."""
    if method == "NONE":
        return None
    if method not in PREFILTERS:
        raise ValueError(f"no prefilter {method}: one of {', '.join(PREFILTERS)}")
    parts = prefilter.split_rows(query.rows)
    entity, posting = snapshot.entity, snapshot.posting
    found = []
    if method == "HNSW":
        near = stored(prefilter.nearest(query.distinct, entity, config.neighbours).select("q_uri", "uri"), fresh_path(snapshot.spark, "near"))
        for k, part in enumerate(parts):
            own = near.where(F.col("q_uri").isin(sorted({u for r in part for u in r})))
            found.append(prefilter.tables_of(own, posting).withColumn("split", F.lit(k)))
    else:
        kind = method.removeprefix("LSH_")
        size = next((len(e.embedding) for e in query.distinct if e.embedding is not None), 0)
        index = prefilter.LshIndex(entity, posting, kind, config.hashes, config.bands, config.column_wise, size)
        for k, part in enumerate(parts):
            found.append(index.search(Query(part, query.entities), config.votes, config.aggregated).select("table_id").withColumn("split", F.lit(k)))
    return prefilter.voted(reduce(DataFrame.unionByName, found), len(parts))


@dataclass(frozen=True)
class Result:
    """A search's tables (rank is their order) and what it took."""

    tables: DataFrame
    reduction: float
    runtime: int  # nanoseconds until the plan was made, candidates included

    def json(self, cells: DataFrame, message: str | None = None) -> DataFrame:
        return readers.result_json(self.tables.select("table_id", "score"), cells, self.runtime, self.reduction, message)


def run_search(
    rows: tuple[tuple[str, ...], ...], snapshot: Snapshot, kg: DataFrame, embeddings: DataFrame, options: Options = Options(), k: int | None = 10,
    method: str = "NONE", config: Config = Config(), with_stats: bool = False,
) -> Result:
    """Scores all tables, or those that the prefilter leaves; the best k, or all."""
    began = time.monotonic_ns()
    query = resolve_query(rows, snapshot, kg, embeddings)
    if options.weighted:
        options = replace(options, type_weights=type_weights(snapshot, query))
    tables, entity, posting, mention, pattern = snapshot.tables, snapshot.entity, snapshot.posting, snapshot.mention, snapshot.pattern
    left = candidates(query, snapshot, method, config)
    reduction = 0.0
    if left is not None:
        # Used several times: written once, and of a size that Spark knows.
        left = stored(left, fresh_path(snapshot.spark, "candidates"))
        n = tables.count()
        reduction = 1 - left.count() / n if n else 0.0
        only = lambda df: df.join(left, "table_id", "left_semi")
        tables, posting, mention, pattern = only(tables), only(posting), only(mention), only(pattern)
    scores = search.score_tables(query, options, entity, posting, mention, pattern)
    if not with_stats:
        scores = scores.select("table_id", "score")
    if k is None:
        k = (1 << 31) - 1
    best = search.top_k(scores, tables, k)
    if with_stats:
        sizes = snapshot.tables.select("table_id", F.col("linked_rows").alias("entity_mapped_rows"), (F.col("linked_rows") / F.col("n_rows")).alias("mapped_fraction"))
        best = best.join(sizes, "table_id").orderBy(F.desc("score"), "table_id")
    return Result(best, reduction, time.monotonic_ns() - began)


class Graph:
    """The knowledge graph of an engine."""

    def __init__(self, engine: Engine):
        self._engine = engine

    @property
    def triples(self) -> DataFrame:
        return self._engine.triples

    def types(self, uri: str) -> DataFrame:
        return linking.entity_types(self.triples.where(F.col("s") == uri))

    def predicates(self, uri: str) -> DataFrame:
        return linking.entity_predicates(self.triples.where(F.col("s") == uri))

    def size(self) -> DataFrame:
        return graph.size(self.triples)

    def exists(self, uris: DataFrame) -> DataFrame:
        return graph.exists(uris, self.triples)

    def from_wiki_link(self, links: DataFrame) -> DataFrame:
        return graph.from_wiki_link(links, self.triples)

    def subgraph(self, uris: DataFrame) -> DataFrame:
        return graph.neighbourhood(uris, self.triples)

    def search(self, text: str, k: int = 10, per_triple: bool = False) -> DataFrame:
        return keyword.top_hits(keyword.bm25(graph.documents(self.triples, per_triple), text), k)

    def insert(self, path: str) -> None:
        self._engine.load_graph(path)

    def export(self, path: str, cypher: bool = False) -> None:
        if cypher:
            graph_lines = readers.cypher_lines(self.triples)
            graph_lines.write.mode("overwrite").text(path)
        else:
            readers.write_triples(self.triples, path)


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), listener: Callable[[Event, object], None] | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self.store, self.embeddings = LakeStore(spark, f"{self.root}/lake"), EmbeddingStore(spark, f"{self.root}/embeddings")
        self.usage = UsageLog(spark, f"{self.root}/usage")
        self.kg = Graph(self)
        self.progressive: ProgressiveIndex | None = None
        self._listener = listener

    # --- graph and embeddings ---------------------------------------------------------

    @property
    def triples(self) -> DataFrame:
        schema = "s string, p string, o string, o_kind string"
        path = f"{self.root}/graph"
        return self.spark.read.schema(schema).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def add_triples(self, triples: DataFrame) -> None:
        """Appends what the graph does not have yet."""
        new = triples.select("s", "p", "o", "o_kind").distinct()
        if path_exists(self.spark, f"{self.root}/graph"):
            new = new.join(self.triples, ["s", "p", "o", "o_kind"], "left_anti")
        new.write.mode("append").parquet(f"{self.root}/graph")

    def load_graph(self, path: str, screened: bool = False) -> None:
        """N-Triples or Turtle of one triple a line.  screened: only lines that begin
        with a web address and an IRI, made ASCII, as a first import takes them."""
        self.add_triples(readers.read_screened_triples(self.spark, path) if screened else readers.read_triples(self.spark, path))

    def load_embeddings(self, path: str, delimiter: str = " ") -> None:
        if not delimiter:
            raise ValueError("a delimiter is missing")
        self.embeddings.load(path, delimiter)

    # --- tables -----------------------------------------------------------------------

    def ingest(self, path: str, table_prefix: str = "", kg_prefix: str = "", progressive: bool = False, link: DataFrame | None = None) -> list[str]:
        """CSV files below path; returns the names that were there already."""
        return self.ingest_cells(readers.read_csv_lake(self.spark, path, self.config.header_as_row), table_prefix, kg_prefix, progressive, link)

    def ingest_cells(self, cells: DataFrame, table_prefix: str = "", kg_prefix: str = "", progressive: bool = False, link: DataFrame | None = None) -> list[str]:
        """Stores tables and indexes the lake, or sets up a progressive index over
        it: step() that, then finish().  link: (text, uri), whose texts and uris must
        begin with the prefixes; else texts with the table prefix are linked, without
        it, to labels and names of the graph's entities with the other one."""
        if not self.embeddings.dimension():
            raise ValueError("load embeddings before tables")
        refused = self.store.insert(cells)
        link = self._links(self.store.cells(), table_prefix, kg_prefix) if link is None else self._checked(link, table_prefix, kg_prefix)
        if progressive:
            self.progressive = ProgressiveIndex(self.spark, stored(link, f"{self.root}/progressive-link"), f"{self.root}/progressive", listener=self._listener)
            self.progressive.add_tables(self.store.cells())
        else:
            self.index(link)
        return refused

    def _links(self, cells: DataFrame, table_prefix: str = "", kg_prefix: str = "") -> DataFrame:
        """(text, uri): a label of the graph in full, else the best hit by its words."""
        triples = self.triples.where(F.col("s").startswith(kg_prefix))
        labels = graph.labels(triples)
        exact = labels.groupBy(F.col("label").alias("text")).agg(F.min("uri").alias("uri"))
        texts = cells.where(F.col("text").startswith(table_prefix)).select(tables.strip_prefix(F.col("text"), table_prefix).alias("text")).distinct()
        known = texts.join(exact, "text")
        rest = texts.join(exact, "text", "left_anti")
        hits = keyword.link_mentions(rest, graph.documents(triples)).where("uri <> 'None'")
        found = known.select("text", "uri").unionByName(hits.select("text", "uri"))
        return found.select(tables.add_prefix(F.col("text"), table_prefix).alias("text"), "uri")

    def _checked(self, link: DataFrame, table_prefix: str, kg_prefix: str) -> DataFrame:
        """link; a text or a uri without its prefix is an error."""
        whole = lambda c, prefix: tables.add_prefix(tables.strip_prefix(F.col(c), prefix), prefix).alias(c)
        return link.select(whole("text", table_prefix), whole("uri", kg_prefix))

    def index(self, link: DataFrame | None = None, mention: DataFrame | None = None) -> Snapshot:
        """Derives a new snapshot of the lake as it is; older ones go."""
        number = int(time.time() * 1000)
        cells = self.store.cells()
        link = self._links(cells) if link is None else link
        snapshot = Snapshot.write(cells, self.triples, link, self.embeddings.all(), f"{self.root}/index/at={number}", mention)
        self.spark.createDataFrame([(number,)], "at long").write.mode("append").parquet(f"{self.root}/index-log")
        for old in self._snapshots()[:-1]:
            remove_path(self.spark, f"{self.root}/index/at={old}")
        return snapshot

    def finish(self, pops: int = 100_000) -> Snapshot:
        """Ends a progressive index: what is left is indexed, then the snapshot made."""
        mention = self.progressive.finish(pops)
        snapshot = self.index(self.progressive.link, mention)
        self.progressive = None
        return snapshot

    def _snapshots(self) -> list[int]:
        path = f"{self.root}/index-log"
        if not path_exists(self.spark, path):
            return []
        return sorted(r["at"] for r in self.spark.read.schema("at long").parquet(path).collect())

    @property
    def snapshot(self) -> Snapshot:
        found = self._snapshots()
        if not found:
            raise ValueError("nothing is indexed yet")
        return Snapshot(self.spark, f"{self.root}/index/at={found[-1]}")

    def remove_table(self, table_id: str) -> bool:
        """The table and all that is derived from it."""
        if not self.store.remove(table_id):
            return False
        if self._snapshots():
            old = self.snapshot
            self.index(old.link, old.mention.where(F.col("table_id") != table_id))
        return True

    def clear(self) -> None:
        for name in ("lake", "index", "index-log", "progressive", "progressive-spans", "progressive-link"):
            remove_path(self.spark, f"{self.root}/{name}")
        self.progressive = None

    def clear_embeddings(self) -> None:
        self.embeddings.clear()

    # --- questions --------------------------------------------------------------------

    def search(
        self, query: str | Sequence[Sequence[str]], k: int = 10, similarity: str = "TYPES", aligned: bool = True, maximum: bool = True, measure: str = "EUCLIDEAN",
        weighted: bool = False, cosine: str = "NORM_COS", prefilter: str = "NONE", strict_coverage: bool = False, shared: bool = False, query_time: float = 0.0,
        same_alignment: bool = False, with_stats: bool = False,
    ) -> Result:
        """The k tables most like the query.  While a progressive index is at work
        it may go on for query_time seconds first; its tables that are found come
        first then."""
        rows = parse_query(query)
        if not rows:
            raise ValueError("the query has no cell")
        if sum(map(len, rows)) > self.config.most_query_cells:
            raise ValueError(f"a query has at most {self.config.most_query_cells} cells")
        if k <= 0:
            raise ValueError("k is not positive")
        if similarity.upper() not in SIMILARITIES:
            raise ValueError(f"no similarity {similarity}: one of {', '.join(SIMILARITIES)}")
        kind, own = SIMILARITIES[similarity.upper()]
        options = Options(kind, weighted, own or cosine, aligned, same_alignment, maximum, measure.upper(), shared, strict_coverage)
        snapshot = self._so_far(query_time) if self.progressive else self.snapshot
        found = run_search(rows, snapshot, self.triples, self.embeddings.all(), options, k, prefilter.upper(), self.config, with_stats)
        if self.progressive:
            self.progressive.boost({r["table_id"]: r["score"] for r in found.tables.select("table_id", "score").collect()})
        return found

    def _so_far(self, query_time: float) -> Snapshot:
        if query_time > 0:
            self.progressive.run_for(query_time, 10_000)
        return self.index(self.progressive.link, self.progressive.mentions())

    def keyword_search(self, text: str, k: int | None = None) -> DataFrame:
        return self.kg.search(text, k or self.config.keyword_hits)

    def count(self, uri: str) -> int:
        """Tables that contain an entity."""
        return self.snapshot.posting.where(F.col("uri") == uri).select("table_id").distinct().count()

    def stats(self) -> DataFrame:
        s = self.snapshot
        return stats.lake_stats(self.store.cells(), s.mention, s.entity, self.embeddings.all())

    def table_stats(self, table_id: str) -> DataFrame:
        s = self.snapshot
        return stats.table_stats(s.mention.where(F.col("table_id") == table_id), s.entity, self.embeddings.all())

    def profiles(self) -> DataFrame:
        return stats.table_profile(self.store.cells(), self.snapshot.mention)

    def link_mentions(self, texts: DataFrame) -> DataFrame:
        """(text) to (text, uri)."""
        return keyword.link_mentions(texts, graph.documents(self.triples))

    def link_table(self, table_id: str) -> DataFrame:
        return keyword.link_table(self.store.table(table_id), graph.documents(self.triples))

    def rank(self, scorer: Callable[[DataFrame, DataFrame], DataFrame], k: int = 10) -> DataFrame:
        """A ranking of one's own: scorer gets entities and postings and gives
        (table_id, score)."""
        s = self.snapshot
        return search.top_k(scorer(s.entity, s.posting), s.tables, k)

    def similar_entities(self, similarity: Callable[[Column, Column], Column], uri: str, column: str = "types") -> DataFrame:
        """(uri, sim) of all entities to one, by a function of two columns."""
        own = self.snapshot.entity.where(F.col("uri") == uri).select(F.col(column).alias("_own"))
        return self.snapshot.entity.join(own).select("uri", similarity(F.col("_own"), F.col(column)).alias("sim"))
