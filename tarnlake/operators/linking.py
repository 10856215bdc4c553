"""Linking cells to entities, and the entity dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("rdf:type", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type")


def first_mappings(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, text, uri) to (text, uri) and (uri, text): each text keeps its first
    uri and, independently, each uri its first text."""
    one = lambda key, other: pairs.groupBy(key).agg(F.min_by(other, "seq").alias(other))
    return one("text", "uri"), one("uri", "text")


def link_cells(cells: DataFrame, link: DataFrame) -> DataFrame:
    """Cells with uri, null where no entity has that text.  Spark decides by size whether link is broadcast."""
    return cells.join(link, "text", "left")


def mentions(cells: DataFrame, link: DataFrame) -> DataFrame:
    """The inverted index (uri, table_id, row_idx, col_idx)."""
    return cells.join(link, "text").select("uri", "table_id", "row_idx", "col_idx")


def disallowed(o: Column) -> Column:
    return o.endswith("owl#Thing") | o.endswith("/Q5")


def entity_types(kg: DataFrame) -> DataFrame:
    return kg.where(F.col("p").isin(*TYPES) & ~disallowed(F.col("o"))).groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set("o")).alias("types"))


def entity_predicates(kg: DataFrame) -> DataFrame:
    return kg.where("o_kind = 'iri'").groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set("p")).alias("predicates"))


def entity_profile(uris: DataFrame, kg: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """uris enriched by types, predicates and, if given, embedding."""
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    out = uris.join(entity_types(kg), "uri", "left").join(entity_predicates(kg), "uri", "left")
    out = out.select(*uris.columns, empty("types"), empty("predicates"))
    return out if embeddings is None else out.join(embeddings, "uri", "left")


def entity_idf(mention: DataFrame, n_tables: DataFrame) -> DataFrame:
    """log10(tables / tables with the entity) + 1.  n_tables: one row, column n."""
    found = mention.groupBy("uri").agg(F.count_distinct("table_id").alias("k"))
    return found.join(n_tables).select("uri", (F.log10(F.col("n") / F.col("k")) + 1).alias("idf"))


def type_idf(profile: DataFrame) -> DataFrame:
    """log2(entities / entities of the type)."""
    n = profile.agg(F.count(F.lit(1)).alias("n"))
    return profile.select(F.explode("types").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("k")).join(n).select("type", F.log2(F.col("n") / F.col("k")).alias("idf"))


def postings(mention: DataFrame) -> DataFrame:
    """(uri, table_id, col_idx, n): mentions without rows."""
    return mention.groupBy("uri", "table_id", "col_idx").agg(F.count(F.lit(1)).alias("n"))


def linked_patterns(mention: DataFrame) -> DataFrame:
    """(table_id, cols, n): sets of linked columns, and how many rows of a table have them."""
    rows = mention.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_set("col_idx")).alias("cols"))
    return rows.groupBy("table_id", "cols").agg(F.count(F.lit(1)).alias("n"))


def type_weights(profile: DataFrame, weights: DataFrame) -> DataFrame:
    """(uri, type_weight): the sum of the idf of an entity's types, those below 0 left out."""
    each = profile.select("uri", F.explode("types").alias("type")).join(weights, "type")
    return each.groupBy("uri").agg(F.sum(F.greatest("idf", F.lit(0.0))).alias("type_weight"))
