"""Statistics of the lake, its tables and the use of endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lake_stats(cells: DataFrame, mention: DataFrame, profile: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: entities, types, predicates, embeddings, linked cells, tables."""
    n = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    return (
        n(mention, "uri", "entities").join(n(profile.select(F.explode("types").alias("t")), "t", "types"))
        .join(n(profile.select(F.explode("predicates").alias("t")), "t", "predicates")).join(n(embeddings, "uri", "embeddings"))
        .join(mention.agg(F.count(F.lit(1)).alias("linked_cells"))).join(n(cells, "table_id", "tables"))
    )


def table_stats(mention: DataFrame, profile: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per table: distinct entities, their types and predicates with multiplicity, and embeddings."""
    e = mention.select("table_id", "uri").distinct().join(profile.select("uri", "types", "predicates"), "uri")
    e = e.join(embeddings.select("uri", F.lit(1).alias("has")), "uri", "left")
    return e.groupBy("table_id").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.size("types")).alias("types"), F.sum(F.size("predicates")).alias("predicates"), F.count("has").alias("embeddings"))


def entity_count(mention: DataFrame) -> DataFrame:
    """Tables that contain each entity."""
    return mention.groupBy("uri").agg(F.count_distinct("table_id").alias("tables"))


def _listed(counts: DataFrame, place: str, name: str) -> DataFrame:
    """(table_id, place, k) to (table_id, name): 'place:k' in order, comma-joined."""
    word = lambda x: F.concat_ws(":", x[place].cast("string"), x["k"].cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct(place, "k")))
    return counts.groupBy("table_id").agg(F.array_join(F.transform(ordered, word), ",").alias(name))


def table_profile(cells: DataFrame, mention: DataFrame) -> DataFrame:
    """Per table: shape, distinct entities, linked cells and rows, and linked cells per column."""
    # A table has few columns, so a set of them is small; rows and entities are counted each by themselves.
    shape = cells.groupBy("table_id").agg(
        F.count_distinct("row_idx").alias("n_rows"), F.size(F.collect_set("col_idx")).cast("long").alias("n_cols"), F.count(F.lit(1)).alias("n_cells")
    )
    rows = mention.groupBy("table_id", "row_idx").agg(F.count(F.lit(1)).alias("k"))
    rows = rows.groupBy("table_id").agg(F.sum("k").alias("mapped_cells"), F.count(F.lit(1)).alias("mapped_rows"))
    m = rows.join(mention.groupBy("table_id").agg(F.count_distinct("uri").alias("entities")), "table_id")
    per = _listed(mention.groupBy("table_id", "col_idx").agg(F.count(F.lit(1)).alias("k")), "col_idx", "per_column")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return shape.join(m, "table_id", "left").join(per, "table_id", "left").select(
        "table_id", "n_rows", "n_cols", "n_cells", zero("entities"), zero("mapped_cells"), zero("mapped_rows"), F.coalesce("per_column", F.lit("")).alias("per_column")
    )


def entities_per_row(cells: DataFrame, mention: DataFrame) -> DataFrame:
    """(table_id, row_idx, entities): linked cells of every row, 0 where there are none."""
    linked = mention.groupBy("table_id", "row_idx").agg(F.count(F.lit(1)).alias("k"))
    rows = cells.select("table_id", "row_idx").distinct()
    return rows.join(linked, ["table_id", "row_idx"], "left").select("table_id", "row_idx", F.coalesce("k", F.lit(0)).alias("entities"))


def approximate_entities(mention: DataFrame, error: float = 0.01) -> DataFrame:
    """One row: about how many entities the lake has, from a sketch of bounded size."""
    return mention.agg(F.approx_count_distinct("uri", error).alias("entities"))


def write_profiles(profiles: DataFrame, path: str) -> None:
    """One JSON object per table."""
    profiles.write.mode("overwrite").json(path)


def distinct_elements(profile: DataFrame, column: str) -> DataFrame:
    """(element): all types or all predicates of the lake."""
    return profile.select(F.explode(column).alias("element")).distinct()


def usage(log: DataFrame) -> DataFrame:
    """(ts, endpoint) to counts by year, ISO week and endpoint."""
    return log.groupBy(F.year("ts").alias("year"), F.weekofyear("ts").alias("week"), "endpoint").agg(F.count(F.lit(1)).alias("uses"))


def column_centroid(mention: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(table_id, col_idx, pos, mean): element-wise mean of a column's embeddings."""
    e = mention.join(embeddings, "uri").select("table_id", "col_idx", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("table_id", "col_idx", "pos").agg(F.avg("x").alias("mean"))
