"""BM25 over tokenised texts, and linking of mentions by it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def postings(docs: DataFrame) -> DataFrame:
    """(id, text) to (id, term, tf, len)."""
    t = docs.select("id", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    return t.select("id", "len", F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def _weigh(tf: DataFrame) -> Column:
    """The part of a term in a document's score; tf: tf, df, n, len, mean."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))


def bm25(docs: DataFrame, query: list[str] | str) -> DataFrame:
    """(id, text) against the words of a query: (q, id, score), any word matching.
    Only the query's words are exploded; a document is tokenised once."""
    words = sorted({w for w in re.split(r"[\W_]+", query.lower()) if w} if isinstance(query, str) else set(query))
    wanted = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    t = docs.select("id", tokens(F.col("text")).alias("t"))
    found = t.select("id", F.size("t").alias("len"), F.filter("t", lambda x: F.array_contains(wanted, x)).alias("hits"))
    stats = found.agg(
        F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count(F.when(F.array_contains("hits", w), 1)).alias(f"df{k}") for k, w in enumerate(words)]
    )
    # One row of counts; terms of a document are counted in place.
    x = found.where(F.size("hits") > 0).join(stats)
    times = lambda w: F.size(F.filter("hits", lambda y: y == F.lit(w)))
    parts = [F.struct(times(w).alias("tf"), F.col(f"df{k}").alias("df")) for k, w in enumerate(words)]
    x = x.select("id", "len", "n", "mean", F.explode(F.array(*parts)).alias("p")).select("id", "len", "n", "mean", "p.tf", "p.df").where("tf > 0")
    return x.withColumn("part", _weigh(x)).groupBy("id").agg(F.round(F.sum("part"), 6).alias("score")).select(F.lit(0).alias("q"), "id", "score")


def top_hits(scores: DataFrame, k: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def link_mentions(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(text) to (text, uri): the first hit of each distinct text, or None.

    A text first meets the entities that have its rarest word.  Where the best of
    them scores more than all other words together could give, that is the hit;
    only the texts that are left meet the entities of all their words."""
    asked = texts.select("text").distinct()
    words = asked.select(F.col("text").alias("q"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    p = weighed_postings(entities)
    terms = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
    known = words.join(terms, "term")
    rare = known.groupBy("q").agg(F.min(F.struct("df", "term")).alias("r"), F.sum("most").alias("all"))
    rare = rare.join(terms.select("term", "most"), F.col("r.term") == F.col("term")).select("q", "term", (F.col("all") - F.col("most")).alias("others"))
    near = rare.join(p.select("term", "id"), "term").select("q", "id", "others")
    scores = near.join(words, "q").join(p.select("id", "term", "part"), ["id", "term"]).groupBy("q", "id", "others").agg(F.sum("part").alias("score"))
    best = F.min(F.struct((-F.round("score", 6)).alias("s"), "id")).alias("best")
    first = scores.groupBy("q").agg(best, F.max("score").alias("score"), F.first("others").alias("others"))
    sure = F.col("score") > F.col("others") + 1e-5
    left = words.join(first.where(~sure).select("q"), "q", "left_semi")
    rest = left.join(p.select("id", "term", "part"), "term").groupBy("q", "id").agg(F.sum("part").alias("score")).groupBy("q").agg(best)
    hits = first.where(sure).select("q", "best").unionByName(rest).select(F.col("q").alias("text"), F.col("best.id").alias("uri"))
    return asked.join(hits, "text", "left").select("text", F.coalesce("uri", F.lit("None")).alias("uri"))


def weighed_postings(docs: DataFrame) -> DataFrame:
    """(id, term, part): what a term adds to the score of a document."""
    p = postings(docs)
    stats = p.select("id", "len").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    x = p.join(p.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").join(stats)
    return x.select("id", "term", _weigh(x).alias("part"))


def link_table(cells: DataFrame, entities: DataFrame) -> DataFrame:
    """Cells with uri: link_mentions of their texts, None where nothing is found."""
    return cells.join(link_mentions(cells, entities), "text", "left").select(*cells.columns, "uri")


def bm25_join(docs: DataFrame, words: DataFrame) -> DataFrame:
    """bm25 for many queries (q, term): joins on terms."""
    found = words.join(weighed_postings(docs), "term")
    return found.groupBy("q", "id").agg(F.round(F.sum("part"), 6).alias("score"))
