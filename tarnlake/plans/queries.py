"""The registered queries over the derived lake.

The lake is ingested once per application: its cells, graph and embeddings, and
the index snapshot that searches read, are written to the shared folder.  Queries
named after a step of the indexing run that step over all cells or triples."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Config, Snapshot, resolve_query, run_search, type_weights
from ..functions import similarity as sim
from ..operators import graph, keyword, linking, prefilter, search, stats, tables
from ..operators.search import Options, Query
from ..session import fresh_path, shared_dir, stored
from ..sources import readers
from ..sources.store import EmbeddingStore, LakeStore, UsageLog
from ..streaming.progressive import ProgressiveIndex
from . import lake

_LAKES: dict[tuple[str, str], Lake] = {}


class Lake:
    """The ingested lake of a folder of star tables."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        path = f"{shared_dir(spark)}/tarnlake-lake-{spark.sparkContext.applicationId}-{zlib.crc32(sf.encode()):08x}"
        self.cells = stored(lake.cells(spark, sf).repartition("table_id").sortWithinPartitions("table_id", "row_idx", "col_idx"), f"{path}/cells")
        self.kg = stored(lake.triples(spark, sf).repartition("s").sortWithinPartitions("s", "p"), f"{path}/kg")
        self.embeddings = stored(lake.embeddings(spark, sf, self.kg, f"{path}/numbers"), f"{path}/embeddings")
        self.path = path

    @classmethod
    def of(cls, spark: SparkSession, sf: str) -> Lake:
        key = (spark.sparkContext.applicationId, sf)
        if key not in _LAKES:
            _LAKES[key] = cls(spark, sf)
        return _LAKES[key]

    @cached_property
    def snapshot(self) -> Snapshot:
        return Snapshot.write(self.cells, self.kg, self.link, self.embeddings, f"{self.path}/index")

    @property
    def link(self) -> DataFrame:
        return lake.links(self.kg)

    @property
    def mention(self) -> DataFrame:
        return self.snapshot.mention

    @property
    def entity(self) -> DataFrame:
        return self.snapshot.entity

    @property
    def fresh_mention(self) -> DataFrame:
        """The inverted index, derived anew."""
        return linking.mentions(self.cells, self.link)

    @property
    def fresh_profile(self) -> DataFrame:
        return linking.entity_profile(self.fresh_mention.select("uri").distinct(), self.kg)

    @cached_property
    def names(self) -> dict[str, str]:
        """The entities that queries ask for."""
        t = lambda n: lake.table(self.spark, self.sf, n)
        first = lambda name, key, text: t(name).agg(F.min_by(text, key).alias("x")).select(F.lit(f"{name}.{text}").alias("k"), lake.uri("x").alias("uri"))
        home = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).agg(F.min_by("n_name", "s_suppkey").alias("x"))
        found = first("part", "p_partkey", "p_name").unionByName(first("part", "p_partkey", "p_brand")).unionByName(first("supplier", "s_suppkey", "s_name"))
        return {r["k"]: r["uri"] for r in found.unionByName(home.select(F.lit("home").alias("k"), lake.uri("x").alias("uri"))).collect()}

    @cached_property
    def rows(self) -> tuple[tuple[str, ...], ...]:
        """(part, brand), (supplier, nation of the first supplier)."""
        n = self.names
        return ((n["part.p_name"], n["part.p_brand"]), (n["supplier.s_name"], n["home"]))

    @property
    def ragged_rows(self) -> tuple[tuple[str, ...], ...]:
        """rows, and one of an entity that no one knows."""
        return (*self.rows, ("kg:nobody",))

    @cached_property
    def long_rows(self) -> tuple[tuple[str, ...], ...]:
        """Nine rows of one supplier each."""
        s = lake.table(self.spark, self.sf, "supplier").orderBy("s_suppkey").limit(9).select(lake.uri("s_name").alias("uri"))
        return tuple((r["uri"],) for r in s.collect())

    def query(self, rows: tuple[tuple[str, ...], ...] | None = None) -> Query:
        return resolve_query(rows or self.rows, self.snapshot, self.kg, self.embeddings)

    def query_cells(self, rows: tuple[tuple[str, ...], ...] | None = None) -> DataFrame:
        """(q_row, q_col, uri)."""
        return self.spark.createDataFrame([(i, j, u) for i, r in enumerate(rows or self.rows) for j, u in enumerate(r)], "q_row int, q_col int, uri string")

    def query_uris(self) -> DataFrame:
        """The cells of the ragged query, and an outer name of the first nation."""
        outer = self.names["home"].replace("kg:", "kg:ext_")
        return self.spark.createDataFrame([(u,) for u in sorted({u for r in self.ragged_rows for u in r} | {outer})], "uri string")


def _of(body: Callable[[Lake], DataFrame]):
    return lambda spark, sf: body(Lake.of(spark, sf))


def r6(c: str) -> Column:
    return search.rounded(F.col(c)).alias(c)


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _search(options: Options = Options(), ragged: bool = False, method: str = "NONE", config: Config = Config(), k: int = 10):
    def run(x: Lake) -> DataFrame:
        found = run_search(x.ragged_rows if ragged else x.rows, x.snapshot, x.kg, x.embeddings, options, k, method, config)
        return found.tables.select("table_id", r6("score")), found.reduction

    return run


def _plain(*args, **kwargs):
    return _of(lambda x: _search(*args, **kwargs)(x)[0])


def _reduced(*args, **kwargs):
    def run(x: Lake) -> DataFrame:
        found, reduction = _search(*args, **kwargs)(x)
        return found.withColumn("reduction", F.round(F.lit(reduction), 6))

    return _of(run)


def _stats_of_search(x: Lake) -> DataFrame:
    found = run_search(x.rows, x.snapshot, x.kg, x.embeddings, Options(), None, with_stats=True).tables
    at = lambda c, k: F.round(F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)), 6)
    vector = F.get("row_vectors", F.lit(1))
    return found.select(
        "table_id", "entity_mapped_rows", r6("mapped_fraction"), at("row_scores", 0).alias("score_0"), at("row_scores", 1).alias("score_1"),
        at(vector, 0).alias("vector_10"), at(vector, 1).alias("vector_11"),
    )


def _pairs(options: Options):
    def run(x: Lake) -> DataFrame:
        q, o = x.query(), options
        if o.weighted:
            o = Options("TYPES", True, type_weights=type_weights(x.snapshot, q))
        return search.pair_table(x.entity, q, o).select("q_uri", "uri", r6("sim"))

    return _of(run)


def _sums(x: Lake, options: Options = Options()) -> DataFrame:
    return search.column_sums(search.cell_scores(x.query_cells(), x.mention, search.pair_table(x.entity, x.query(), options)))


def _alignment_total(x: Lake) -> DataFrame:
    sums = stored(_sums(x), fresh_path(x.spark, "sums"))
    aligned = sums.join(search.align(sums), ["table_id", "q_row", "q_col", "col_idx"])
    return aligned.groupBy("table_id", "q_row").agg(F.round(F.sum("score"), 4).alias("total"))


def _coverage(x: Lake) -> DataFrame:
    sums = stored(_sums(x, Options("EMBEDDINGS")), fresh_path(x.spark, "sums"))
    return search.covered_rows(x.query_cells(), x.mention, search.align(sums)).groupBy("table_id", "q_row").agg(_count("rows"))


def _knn(x: Lake) -> DataFrame:
    return prefilter.tables_of(prefilter.nearest(x.query().distinct, x.entity, 20), x.snapshot.posting)


def _split_vote(x: Lake) -> DataFrame:
    from ..engine import candidates

    return candidates(x.query(x.long_rows), x.snapshot, "HNSW", Config(neighbours=20)).select("table_id")


def _lsh(kind: str, vote: int, aggregated: bool = False, column_wise: bool = False, hashes: int = 8, **kwargs):
    def run(x: Lake) -> DataFrame:
        index = prefilter.LshIndex(x.entity, x.snapshot.posting, kind, hashes, 4, column_wise, 64, **kwargs)
        return index.search(x.query(), vote, aggregated)

    return _of(run)


def _elements(x: Lake, column: str = "types") -> DataFrame:
    return x.entity.select("uri", F.explode(column).alias("element"))


def _rare_elements(x: Lake) -> DataFrame:
    """Types but the tenth that most entities have, by entity."""
    left = prefilter.without(_elements(x), prefilter.popular_by_percentile(_elements(x), 0.9))
    return left.groupBy("uri").agg(F.array_join(F.array_sort(F.collect_set("element")), ",").alias("elements"))


def _progressive(x: Lake) -> DataFrame:
    """The scheduler picks the rows; after the first step tables of suppliers are boosted as a search would."""
    index = ProgressiveIndex(x.spark, x.snapshot.link, fresh_path(x.spark, "progressive"), rows_per_pop=64)
    index.add_tables(x.cells)
    pops = max(64, sum(-(-i.remaining // 64) for i in index.scheduler.items.values()) // 3)
    index.step(pops)
    index.boost({t: 0.5 for t in list(index.scheduler.items) if t.startswith("supply_")})
    return index.finish(pops).groupBy("table_id").agg(_count("mentions"))


def _removed(x: Lake) -> DataFrame:
    """The index of a store from which a table has gone."""
    store = LakeStore(x.spark, fresh_path(x.spark, "store"))
    store.insert(x.cells)
    store.remove("customer_1.csv")
    return linking.mentions(store.cells(), x.link).groupBy("uri").agg(_count("n"))


def _stored_embeddings(x: Lake) -> DataFrame:
    """Embeddings of the query's entities from a store, of which some were inserted twice."""
    store = EmbeddingStore(x.spark, fresh_path(x.spark, "embeddings"))
    store.insert(x.embeddings)
    again = x.embeddings.where(F.col("uri").startswith("kg:Brand"))
    store.insert(again.withColumn("embedding", F.transform("embedding", lambda v: v * 2)))
    first = lambda k: F.round(F.get("embedding", F.lit(k)), 6)
    return store.get_many(x.query_uris()).select("uri", F.size("embedding").alias("dimension"), first(0).alias("first"), first(63).alias("last"))


def _usage_log(spark: SparkSession, sf: str) -> DataFrame:
    log = UsageLog(spark, fresh_path(spark, "usage"))
    events = lake.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"))
    log.add(events)
    return stats.usage(log.read())


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    d = lake.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return keyword.top_hits(keyword.bm25(d, "the password worthless"), 10).select("id", "score")


def _hits(docs: Callable[[Lake], DataFrame], words: str):
    return _of(lambda x: keyword.top_hits(keyword.bm25(docs(x), words), 10).select("id", "score"))


def _labels(x: Lake) -> DataFrame:
    return graph.labels(x.kg).select(F.col("uri").alias("id"), F.col("label").alias("text"))


def _ppr(x: Lake, **kwargs) -> DataFrame:
    e = x.kg.where("o_kind = 'iri' and p <> 'rdf:type'").select(F.col("s").alias("a"), F.col("o").alias("b"))
    seeds = x.query_cells().select(F.col("uri").alias("node"), F.lit(1.0).alias("weight"))
    return graph.personalised_pagerank(seeds, e, rounds=2, **kwargs).select("node", r6("mass"))


def _top_ppr(x: Lake) -> DataFrame:
    """Of 1000 particles, nodes with fewer than five keep theirs; the best parts."""
    parts = x.kg.where("p = 'rdf:type' and o = 'Part'").select(F.col("s").alias("node"))
    return _ppr(x, particles=1000.0, least=5.0, k=5, among=parts)


def _result(x: Lake) -> DataFrame:
    found = run_search(x.rows, x.snapshot, x.kg, x.embeddings, Options(), 5)
    document = found.json(x.cells, message="done")
    return readers.from_result_json(document).select("rank", "table_id", r6("score"), F.array_join("headers", ",").alias("headers"), "n_rows")


def _within(x: Lake) -> DataFrame:
    found = run_search(x.rows, x.snapshot, x.kg, x.embeddings, Options(), 10).tables.select("table_id", "score")
    found = stored(found, fresh_path(x.spark, "result"))
    sizes = readers.table_bytes(x.cells.join(found.select("table_id"), "table_id", "left_semi"))
    return readers.within_bytes(found, sizes, 60_000).select("table_id", r6("score"))


def _vectors(x: Lake) -> DataFrame:
    e = F.col("embedding")
    unit = sim.l1_normalise(e)
    return x.embeddings.select(
        "uri", F.round(sim.weighted_euclid(e, sim.hadamard(e, e), F.transform(e, lambda v: F.lit(0.5))), 6).alias("euclid"),
        F.round(F.aggregate(unit, F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias("l1"), F.round(F.get(sim.hadamard(e, e), F.lit(5)), 6).alias("square"),
        F.round(sim.log2(F.size(e).cast("double")), 6).alias("bits"),
    )


def _texts_of_uris(x: Lake) -> DataFrame:
    wiki = x.kg.where("p = 'foaf:isPrimaryTopicOf'").select(F.replace("o", F.lit("http:"), F.lit("https:")).alias("url"))
    name = sim.without_extension(F.concat(sim.uri_text(F.col("url")), F.lit(".old.csv")))
    return wiki.select("url", sim.uri_text(F.col("url")).alias("text"), name.alias("name"), sim.is_url(F.col("url")).alias("is_url"), sim.plain_http(F.col("url")).alias("plain"))


def _wiki_links(x: Lake) -> DataFrame:
    asked = x.kg.where("p = 'foaf:isPrimaryTopicOf'").select(F.replace("o", F.lit("http:"), F.lit("https:")).alias("link"))
    return graph.from_wiki_link(asked, x.kg)


def _decimals(x: Lake) -> DataFrame:
    return x.cells.where("row_idx > 0").groupBy("table_id", "col_idx").agg(F.count(F.when(sim.is_decimal(F.col("text")), 1)).alias("decimals"))


def _mean_length(x: Lake) -> DataFrame:
    """Mean length of the texts of a column, empty ones left out."""
    length = F.when(F.col("text") != "", F.char_length("text"))
    return tables.aggregate_column(x.cells, length, F.avg, "mean").select("table_id", "col_idx", r6("mean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # tables
    "cell_scan": _of(lambda x: x.cells.groupBy("table_id").agg(_count("n_cells"), F.max("row_idx").alias("last_row"))),
    "table_shape": _of(lambda x: tables.shape(x.cells)),
    "table_order": _of(lambda x: tables.by_row_count(x.cells)),
    "table_column": _of(lambda x: tables.column_named(x.cells, "brand")),
    "table_labels": _of(lambda x: tables.labels(x.cells)),
    "table_without_row": _of(lambda x: tables.as_lines(tables.without_row(x.cells, 1).where("row_idx < 3"))),
    "table_equality": _of(lambda x: tables.equal_tables(x.cells.unionByName(x.cells.withColumn("table_id", F.concat(F.lit("copy_"), "table_id"))))),
    "column_aggregate": _of(_mean_length),
    "decimal_cells": _of(_decimals),
    # linking and the index
    "link_cells": _of(lambda x: linking.link_cells(x.cells, x.link).groupBy("table_id", "col_idx").agg(F.count("uri").alias("linked"), _count("n_cells"))),
    "inverted_index": _of(lambda x: x.fresh_mention.groupBy("uri", "table_id").agg(_count("n"), F.min("row_idx").alias("first_row"))),
    "entity_locations": _of(lambda x: tables.locations(x.fresh_mention).select("uri", "table_id", F.size("places").alias("n"), F.get("places", F.lit(0))["row_idx"].alias("row_idx"), F.get("places", F.lit(0))["col_idx"].alias("col_idx"))),
    "linked_rows": _of(lambda x: tables.linked_rows(x.fresh_mention).select("table_id", "row_idx", F.array_join("uris", " ").alias("uris"))),
    "table_entities": _of(lambda x: tables.entities_of(x.mention, "customer_1.csv")),
    "uri_prefix": _of(lambda x: x.entity.select(tables.strip_prefix(F.col("uri"), "kg:").alias("name"), tables.add_prefix(F.col("uri"), "lake/").alias("named"))),
    "entity_profile": _of(lambda x: x.fresh_profile.select("uri", F.array_join("types", ",").alias("types"), F.array_join("predicates", ",").alias("predicates"))),
    "entity_idf": _of(lambda x: linking.entity_idf(x.fresh_mention, x.cells.agg(F.count_distinct("table_id").alias("n"))).select("uri", r6("idf"))),
    "type_idf": _of(lambda x: linking.type_idf(x.fresh_profile).select("type", r6("idf"))),
    "lake_types": _of(lambda x: stats.distinct_elements(x.entity, "types")),
    "uri_functions": _of(_texts_of_uris),
    "vector_functions": _of(_vectors),
    "hamming": _of(lambda x: x.entity.select("uri", sim.hamming(F.split("uri", ""), F.split(F.reverse("uri"), "")).alias("distance"))),
    "embedding_lookup": _of(_stored_embeddings),
    # similarities and search
    "jaccard_types": _pairs(Options()),
    "jaccard_types_weighted": _pairs(Options(weighted=True)),
    "jaccard_predicates": _pairs(Options("PREDICATES")),
    "cosine_norm": _pairs(Options("EMBEDDINGS")),
    "cosine_abs": _pairs(Options("EMBEDDINGS", cosine="ABS_COS")),
    "cosine_ang": _pairs(Options("EMBEDDINGS", cosine="ANG_COS")),
    "column_sim_sum": _of(lambda x: _sums(x).select("table_id", "q_row", "q_col", "col_idx", r6("score"))),
    "hungarian_align": _of(_alignment_total),
    "search_types_max_euclid": _plain(Options()),
    "search_types_mean_euclid": _plain(Options(maximum=False)),
    "search_types_cosine": _plain(Options(measure="COSINE")),
    "search_types_weighted": _plain(Options(weighted=True)),
    "search_predicates": _plain(Options("PREDICATES")),
    "search_embeddings_norm": _plain(Options("EMBEDDINGS")),
    "search_embeddings_strict": _plain(Options("EMBEDDINGS", strict_coverage=True), ragged=True),
    "search_embeddings_aligned": _plain(Options("EMBEDDINGS", aligned=True, maximum=False)),
    "search_ragged_unknown": _plain(Options(), ragged=True),
    "search_aligned": _plain(Options(aligned=True)),
    "search_aligned_mean": _plain(Options(aligned=True, maximum=False)),
    "search_compat_shared": _plain(Options(shared=True)),
    "search_stats": _of(_stats_of_search),
    "comparison_counters": _of(lambda x: search.comparisons(x.query(x.ragged_rows), x.entity, x.snapshot.pattern)),
    "embedding_coverage": _of(_coverage),
    # prefilters
    "knn_prefilter": _of(_knn),
    "split_vote_prefilter": _of(_split_vote),
    "prefiltered_search": _reduced(Options(), method="HNSW", config=Config(neighbours=20)),
    "prefiltered_lsh_search": _reduced(Options(), method="LSH_TYPES", config=Config(votes=4, aggregated=True)),
    "minhash_candidates": _lsh("TYPES", 2),
    "minhash_predicates": _lsh("PREDICATES", 3),
    "minhash_aggregated": _lsh("TYPES", 2, aggregated=True),
    "minhash_columns": _lsh("TYPES", 1, column_wise=True),
    "projection_candidates": _lsh("EMBEDDINGS", 2, hashes=16),
    "projection_aggregated": _lsh("EMBEDDINGS", 1, aggregated=True, column_wise=True, hashes=16),
    "element_popularity_table": _of(lambda x: prefilter.popularity(x.snapshot.posting, _elements(x)).select("element", "tables", r6("share"))),
    "element_popularity_percentile": _of(lambda x: prefilter.popular_by_percentile(_elements(x), 0.75)),
    "element_shingles": _of(lambda x: prefilter.shingles(_elements(x), ["uri"], 2).groupBy("element").agg(_count("entities"))),
    "rare_elements": _of(_rare_elements),
    # keywords
    "bm25_entities": _hits(_labels, "brand supplier"),
    "bm25_postfix": _hits(lambda x: graph.documents(x.kg), "Brand 23 CHINA"),
    "bm25_per_triple": _of(lambda x: keyword.bm25(graph.documents(x.kg, per_triple=True).select(F.monotonically_increasing_id().alias("id"), "text"), "Brand 23 CHINA").groupBy("score").agg(_count("n"))),
    "bm25_documents": _documents,
    "link_mentions": _of(lambda x: keyword.link_mentions(x.cells, _labels(x))),
    # statistics
    "lake_stats": _of(lambda x: stats.lake_stats(x.cells, x.mention, x.entity, x.embeddings)),
    "table_stats": _of(lambda x: stats.table_stats(x.mention, x.entity, x.embeddings)),
    "entity_count": _of(lambda x: stats.entity_count(x.mention)),
    "table_profile": _of(lambda x: stats.table_profile(x.cells, x.mention)),
    "entities_per_row": _of(lambda x: stats.entities_per_row(x.cells, x.mention)),
    "column_centroid": _of(lambda x: stats.column_centroid(x.mention, x.embeddings).select("table_id", "col_idx", "pos", r6("mean"))),
    "usage_by_week": _usage_log,
    # graph
    "kg_size": _of(lambda x: graph.size(x.kg)),
    "kg_degree": _of(lambda x: graph.degree(x.kg)),
    "kg_sameas_exists": _of(lambda x: graph.exists(x.query_uris(), x.kg)),
    "kg_wiki_links": _of(_wiki_links),
    "kg_subgraph": _of(lambda x: graph.subgraph(x.query_uris(), x.kg)),
    "kg_neighbourhood": _of(lambda x: graph.neighbourhood(x.query_uris(), x.kg)),
    "kg_export": _of(lambda x: readers.cypher_lines(x.kg)),
    "pagerank_ppr": _of(lambda x: _ppr(x, least=0.0)),
    "pagerank_top": _of(_top_ppr),
    # sinks, storage, increments
    "rdf_mentions": _of(lambda x: readers.rdf_mentions(x.mention)),
    "result_json": _of(_result),
    "result_within_bytes": _of(_within),
    "query_roundtrip": lambda spark, sf: readers.query_cells(spark.createDataFrame([("a<>b##c<>d##",)], "text string")),
    "progressive_index": _of(_progressive),
    "remove_table": _of(_removed),
}
