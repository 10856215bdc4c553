"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large(e: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to its smallest neighbour, itself included."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b) of longs to (node, component): the smallest node reachable.
    Every round is written to the shared folder; nothing reaches the driver but
    a count and a checksum."""
    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    sign = _sign(e)
    while sign[0]:
        nxt = materialize(_small(_large(e)), name)
        new = _sign(nxt)
        if new == sign:
            break
        e, sign = nxt, new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
