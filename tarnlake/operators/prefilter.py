"""Candidate tables before scoring: exact nearest neighbours, MinHash and
random-hyperplane buckets, and votes of split queries.

A query is known to the driver (search.Query), so its embeddings and elements
enter plans as literals; nothing is broadcast but what Spark itself finds small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine, dot
from .search import Query, QueryEntity

PRIME = 2147483647
SPLIT_FROM, SPLIT_ROWS, SPLIT_VOTES = 8, 3, 2
LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


# --- nearest neighbours -------------------------------------------------------------


def nearest(query: list[QueryEntity], embeddings: DataFrame, k: int) -> DataFrame:
    """(q_uri, uri, sim, rank): the k nearest entities of each query entity that has
    an embedding, exactly.  Every task keeps its own k best before the exchange, for
    which Spark's limit on such ranks is raised to k."""
    spark = embeddings.sparkSession
    if int(spark.conf.get(LIMIT_CONF)) < k:
        spark.conf.set(LIMIT_CONF, str(k))
    known = [e for e in query if e.embedding is not None]
    if not known:
        return spark.createDataFrame([], "q_uri string, uri string, sim double, rank int")
    vector = lambda e: F.array(*[F.lit(float(v)) for v in e.embedding])
    near = lambda e: F.struct(F.lit(e.uri).alias("q_uri"), F.round(cosine(vector(e), F.col("embedding")), 9).alias("sim"))
    rows = embeddings.where("embedding is not null").select("uri", F.explode(F.array(*[near(e) for e in known])).alias("x"))
    rank = F.row_number().over(Window.partitionBy("q_uri").orderBy(F.desc("sim"), "uri"))
    return rows.select("x.q_uri", "uri", "x.sim").withColumn("rank", rank).where(F.col("rank") <= k)


def tables_of(entities: DataFrame, posting: DataFrame) -> DataFrame:
    return posting.join(entities.select("uri").distinct(), "uri", "left_semi").select("table_id").distinct()


# --- split queries ------------------------------------------------------------------


def split_rows(rows: tuple[tuple[str, ...], ...]) -> list[tuple[tuple[str, ...], ...]]:
    """Sub-queries of SPLIT_ROWS rows if there are SPLIT_FROM rows or more, else the query."""
    if len(rows) < SPLIT_FROM:
        return [rows]
    return [rows[k : k + SPLIT_ROWS] for k in range(0, len(rows), SPLIT_ROWS)]


def voted(candidates: DataFrame, splits: int) -> DataFrame:
    """(split, table_id) to tables: of a split query those that SPLIT_VOTES
    sub-queries or more have found, however few of them have found any."""
    votes = candidates.groupBy("table_id").agg(F.count_distinct("split").alias("votes"))
    return votes.where(F.col("votes") >= (SPLIT_VOTES if splits > 1 else 1)).select("table_id")


def reduction(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """Share of the tables that need no scoring."""
    n, k = tables.agg(F.count_distinct("table_id").alias("n")), candidates.agg(F.count_distinct("table_id").alias("k"))
    return n.join(k).select(F.when(F.col("n") > 0, 1 - F.col("k") / F.col("n")).otherwise(0.0).alias("reduction"))


# --- element sets -------------------------------------------------------------------


def numbered(elements: DataFrame) -> DataFrame:
    """(element, element_id) of distinct elements, numbered from 1 in order.  Types
    and predicates belong to the schema of the graph; their number does not grow
    with the lake, so one task orders them."""
    number = F.row_number().over(Window.orderBy("element")).cast("long")
    return elements.select("element").distinct().withColumn("element_id", number)


def minhash(sets: DataFrame, keys: list[str], hashes: int, bands: int) -> DataFrame:
    """(keys, element_id) to (keys, band, bucket): smallest of linear hashes, grouped into bands."""
    per = hashes // bands
    low = [F.min(((F.lit(h) * 7919 + 104729) * F.col("element_id") + F.lit(h) * 15485863 + 1).cast("long") % PRIME).cast("string") for h in range(hashes)]
    signature = sets.groupBy(*keys).agg(*[c.alias(f"h{h}") for h, c in enumerate(low)])
    buckets = [F.struct(F.lit(b).alias("band"), F.concat_ws("-", *[f"h{b * per + j}" for j in range(per)]).alias("bucket")) for b in range(bands)]
    return signature.select(*keys, F.explode(F.array(*buckets)).alias("x")).select(*keys, "x.band", "x.bucket")


def shingles(sets: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, element) to (keys, element): all sets of k different elements, in
    order and joined; an entity's set is small."""
    own = sets.groupBy(*keys).agg(F.array_sort(F.collect_set("element")).alias("s"))
    made = F.transform("s", lambda x, i: F.struct(x.alias("text"), i.alias("last")))
    for _ in range(k - 1):
        longer = lambda a: F.transform(
            F.filter(F.transform("s", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["i"] > a["last"]),
            lambda y: F.struct(F.concat(a["text"], F.lit("|"), y["x"]).alias("text"), y["i"].alias("last")),
        )
        made = F.flatten(F.transform(made, longer))
    return own.select(*keys, F.explode(F.transform(made, lambda a: a["text"])).alias("element"))


def popularity(posting: DataFrame, elements: DataFrame) -> DataFrame:
    """(element, tables, share) of the tables that have an entity with the element."""
    n = posting.agg(F.count_distinct("table_id").alias("n"))
    found = posting.select("uri", "table_id").distinct().join(elements, "uri").groupBy("element").agg(F.count_distinct("table_id").alias("tables"))
    return found.join(n).select("element", "tables", (F.col("tables") / F.col("n")).alias("share"))


def popular_by_percentile(elements: DataFrame, percentile: float) -> DataFrame:
    """(element, entities): of the elements in order of how many entities have
    them, those from the percentile on; ties by name.  One task orders the
    elements, which belong to the schema of the graph."""
    if not 0 <= percentile <= 1:
        raise ValueError("a percentile lies between 0 and 1")
    found = elements.groupBy("element").agg(F.count_distinct("uri").alias("entities"))
    place = F.row_number().over(Window.orderBy("entities", "element")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return found.withColumns({"place": place, "n": n}).where(F.col("place") >= F.floor(F.lit(percentile) * F.col("n"))).select("element", "entities")


def without(elements: DataFrame, unimportant: DataFrame) -> DataFrame:
    """Elements that are not among the unimportant ones."""
    return elements.join(unimportant.select("element").distinct(), "element", "left_anti").select(*elements.columns)


# --- hyperplanes --------------------------------------------------------------------


def hyperplane(dimension: int, index: int) -> list[float]:
    """A fixed projection with entries in [-1, 1)."""
    return [((index * 7919 + j * 104729 + 12345) * 48271 % PRIME) / PRIME * 2 - 1 for j in range(dimension)]


def projections(embeddings: DataFrame, keys: list[str], dimension: int, bits: int, bands: int) -> DataFrame:
    """(keys, embedding) to (keys, band, bucket) of the signs of dot products with fixed hyperplanes."""
    per = bits // bands
    sign = lambda i: F.when(dot(F.col("embedding"), F.array(*[F.lit(x) for x in hyperplane(dimension, i)])) > 0, "1").otherwise("0")
    buckets = [F.struct(F.lit(b).alias("band"), F.concat(*[sign(b * per + i) for i in range(per)]).alias("bucket")) for b in range(bands)]
    return embeddings.where("embedding is not null").select(*keys, F.explode(F.array(*buckets)).alias("x")).select(*keys, "x.band", "x.bucket")


def centroid(embeddings: DataFrame, keys: list[str], dimension: int) -> DataFrame:
    """(keys, embedding, n) to (keys, embedding): element-wise mean over the n mentions of each embedding."""
    found = embeddings.where("embedding is not null").groupBy(*keys)
    mean = F.array(*[F.sum(F.get("embedding", F.lit(i)) * F.col("n")) / F.sum("n") for i in range(dimension)])
    return found.agg(mean.alias("embedding"))


# --- buckets ------------------------------------------------------------------------


def bucket_votes(probes: DataFrame, buckets: DataFrame, vote: int) -> DataFrame:
    """(table_id, votes): bands in which a table shares a bucket with a probe.
    probes: (band, bucket); buckets: (table_id, band, bucket)."""
    hits = buckets.join(probes.select("band", "bucket").distinct(), ["band", "bucket"])
    return hits.groupBy("table_id").agg(F.count_distinct("band").alias("votes")).where(F.col("votes") >= vote)


def entity_buckets(buckets: DataFrame, posting: DataFrame) -> DataFrame:
    """(uri, band, bucket) to (table_id, band, bucket)."""
    return posting.select("uri", "table_id").distinct().join(buckets, "uri").select("table_id", "band", "bucket").distinct()


class LshIndex:
    """Buckets of the tables of a lake by types, predicates or embeddings.

    column_wise: one signature per column of a table, of all its entities' elements
    or of the mean of their embeddings; else one per entity."""

    def __init__(self, entity: DataFrame, posting: DataFrame, kind: str = "TYPES", hashes: int = 8, bands: int = 4, column_wise: bool = False,
                 dimension: int = 0, shingle: int = 1, unimportant: DataFrame | None = None):
        self.entity, self.posting, self.kind, self.hashes, self.bands = entity, posting, kind, hashes, bands
        self.column_wise, self.dimension, self.shingle = column_wise, dimension, shingle
        if kind == "EMBEDDINGS":
            vectors = entity.select("uri", "embedding")
            if column_wise:
                vectors = centroid(posting.join(vectors, "uri"), ["table_id", "col_idx"], dimension)
            self.buckets = self._of_entities(projections(vectors, ["table_id", "col_idx"] if column_wise else ["uri"], dimension, hashes, bands))
            return
        self.column = {"TYPES": "types", "PREDICATES": "predicates"}[kind]
        elements = entity.select("uri", F.explode(self.column).alias("element"))
        if unimportant is not None:
            elements = without(elements, unimportant)
        if shingle > 1:
            elements = shingles(elements, ["uri"], shingle)
        self.ids = numbered(elements)
        sets = elements.join(self.ids, "element").select("uri", "element_id")
        keys = ["uri"]
        if column_wise:
            keys = ["table_id", "col_idx"]
            sets = posting.select("uri", *keys).join(sets, "uri").select(*keys, "element_id").distinct()
        self.buckets = self._of_entities(minhash(sets, keys, hashes, bands))

    def _of_entities(self, found: DataFrame) -> DataFrame:
        return found.select("table_id", "band", "bucket").distinct() if self.column_wise else entity_buckets(found, self.posting)

    def probes(self, groups: list[list[QueryEntity]]) -> DataFrame:
        """(band, bucket) of the signatures of groups of query entities: of the union
        of a group's elements, or of the mean of its embeddings."""
        spark = self.entity.sparkSession
        if self.kind == "EMBEDDINGS":
            rows = [(g, [float(v) for v in e.embedding]) for g, group in enumerate(groups) for e in group if e.embedding is not None]
            vectors = spark.createDataFrame(rows, "g int, embedding array<double>").withColumn("n", F.lit(1))
            return projections(centroid(vectors, ["g"], self.dimension), ["g"], self.dimension, self.hashes, self.bands)
        rows = [(g, str(k), x) for g, group in enumerate(groups) for k, e in enumerate(group) for x in getattr(e, self.column)]
        own = spark.createDataFrame(rows, "g int, uri string, element string")
        if self.shingle > 1:
            own = shingles(own, ["g", "uri"], self.shingle)
        return minhash(own.join(self.ids, "element").select("g", "element_id").distinct(), ["g"], self.hashes, self.bands)

    def search(self, query: Query, vote: int = 1, aggregated: bool = False) -> DataFrame:
        """(table_id, votes).  aggregated: one signature for each column of the query, else for each entity."""
        if not aggregated:
            return bucket_votes(self.probes([[e] for e in query.distinct]), self.buckets, vote)
        wide = max(map(len, query.rows))
        columns = [[query.entities[r[c]] for r in query.rows if c < len(r)] for c in range(wide)]
        found = [bucket_votes(self.probes([g]), self.buckets, vote) for g in columns]
        return reduce(DataFrame.unionByName, found).groupBy("table_id").agg(F.max("votes").alias("votes"))

