"""Lookups and random walks over the triple table (s, p, o, o_kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import uri_text

LABELS = ("rdfs:label", "http://www.w3.org/2000/01/rdf-schema#label")


def edges(kg: DataFrame) -> DataFrame:
    return kg.where("o_kind = 'iri'")


def size(kg: DataFrame) -> DataFrame:
    e = edges(kg)
    nodes = e.select("s").union(e.select("o")).distinct()
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(e.agg(F.count(F.lit(1)).alias("edges")))


def degree(kg: DataFrame) -> DataFrame:
    e = edges(kg)
    return e.select(F.col("s").alias("node")).union(e.select(F.col("o").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def from_wiki_link(links: DataFrame, kg: DataFrame) -> DataFrame:
    """(link) to (link, uri) by isPrimaryTopicOf; https counts as http."""
    topic = kg.where(F.contains("p", F.lit("isPrimaryTopicOf"))).select(F.col("o").alias("url"), F.col("s").alias("uri"))
    return links.withColumn("url", F.replace("link", F.lit("https://"), F.lit("http://"))).join(topic, "url").select("link", "uri")


def exists(uris: DataFrame, kg: DataFrame) -> DataFrame:
    """(uri, entity): itself if it has an outgoing edge, else the subject that is sameAs it, else null."""
    own = edges(kg).select(F.col("s").alias("uri")).distinct().withColumn("here", F.lit(True))
    same = kg.where(F.contains("p", F.lit("sameAs"))).groupBy(F.col("o").alias("uri")).agg(F.min("s").alias("same"))
    return uris.join(own, "uri", "left").join(same, "uri", "left").select("uri", F.when(F.col("here"), F.col("uri")).otherwise(F.col("same")).alias("entity"))


def labels(kg: DataFrame) -> DataFrame:
    return kg.where(F.col("p").isin(*LABELS)).select(F.col("s").alias("uri"), F.col("o").alias("label"))


def documents(kg: DataFrame, per_triple: bool = False) -> DataFrame:
    """(id, text) for keyword search: the words of a subject's uri after its last
    slash; one document per subject, or per triple."""
    found = kg.select("s") if per_triple else kg.select("s").distinct()
    return found.select(F.col("s").alias("id"), uri_text(F.col("s")).alias("text"))


def subgraph(uris: DataFrame, kg: DataFrame) -> DataFrame:
    """(uri, label, neighbours) of the given entities: how many they point to."""
    near = edges(kg).groupBy(F.col("s").alias("uri")).agg(F.count_distinct("o").alias("neighbours"))
    return uris.join(labels(kg), "uri", "left").join(near, "uri", "left").select("uri", "label", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def neighbourhood(uris: DataFrame, kg: DataFrame) -> DataFrame:
    """(uri, p, o, label): the edges of the given entities and the labels of their ends."""
    named = labels(kg).withColumnRenamed("uri", "o")
    return edges(kg).join(uris.select(F.col("uri").alias("s")).distinct(), "s").join(named, "o", "left").select(F.col("s").alias("uri"), "p", "o", "label")


def personalised_pagerank(
    seeds: DataFrame, links: DataFrame, rounds: int = 3, damping: float = 0.85, least: float = 1e-6, particles: float = 1.0, k: int | None = None, among: DataFrame | None = None
) -> DataFrame:
    """(node, mass): expected particles after so many rounds, out of particles.
    seeds (node, weight), links (a, b).  A node passes its mass on while it has
    least or more.  among (node): only these are returned; k: only the best k."""
    total = seeds.agg(F.sum("weight").alias("total"))
    start = seeds.join(total).select("node", (F.lit(particles) * F.col("weight") / F.col("total")).alias("mass"))
    out = links.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    step = links.join(out, "a").select("a", "b", (F.lit(damping) / F.col("deg")).alias("share"))
    mass, walking = start, start
    for _ in range(rounds):
        passed = walking.where(F.col("mass") >= least).join(step, walking["node"] == step["a"])
        walking = passed.groupBy(F.col("b").alias("node")).agg(F.sum(F.col("mass") * F.col("share")).alias("mass"))
        mass = mass.unionByName(walking)
    found = mass.groupBy("node").agg(F.sum("mass").alias("mass"))
    if among is not None:
        found = found.join(among.select("node").distinct(), "node", "left_semi")
    return found if k is None else found.orderBy(F.desc(F.round("mass", 9)), "node").limit(k)
