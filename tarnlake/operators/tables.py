"""Access to single tables of the lake, and their equality.

A table is its rows of lake_cell (table_id, row_idx, col_idx, text); the header
is row 0.  Missing cells of ragged tables have no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_table(cells: DataFrame, table_id: str) -> DataFrame:
    return cells.where(F.col("table_id") == table_id)


def row(cells: DataFrame, row_idx: int) -> DataFrame:
    """(table_id, col_idx, text) of one row of every table."""
    return cells.where(F.col("row_idx") == row_idx).select("table_id", "col_idx", "text")


def labels(cells: DataFrame) -> DataFrame:
    """(table_id, col_idx, label)."""
    return row(cells, 0).withColumnRenamed("text", "label")


def column(cells: DataFrame, col_idx: int) -> DataFrame:
    """(table_id, row_idx, text) of one column; rows that are too short are left out."""
    return cells.where(F.col("col_idx") == col_idx).select("table_id", "row_idx", "text")


def column_named(cells: DataFrame, label: str) -> DataFrame:
    """(table_id, row_idx, text) of the first column with that label, without it."""
    at = labels(cells).where(F.col("label") == label).groupBy("table_id").agg(F.min("col_idx").alias("col_idx"))
    return cells.where("row_idx > 0").join(at, ["table_id", "col_idx"]).select("table_id", "row_idx", "text")


def shape(cells: DataFrame) -> DataFrame:
    """(table_id, n_rows, n_cols): data rows, and the labels."""
    header = F.col("row_idx") == 0
    return cells.groupBy("table_id").agg(
        F.count_distinct(F.when(~header, F.col("row_idx"))).alias("n_rows"), F.count(F.when(header, 1)).alias("n_cols")
    )


def by_row_count(cells: DataFrame) -> DataFrame:
    """(table_id, n_rows), the longest table first, ties by name."""
    return shape(cells).select("table_id", "n_rows").orderBy(F.desc("n_rows"), "table_id")


def without_row(cells: DataFrame, row_idx: int) -> DataFrame:
    """Every table without that row; later rows move up."""
    left = cells.where(F.col("row_idx") != row_idx)
    return left.withColumn("row_idx", F.when(F.col("row_idx") > row_idx, F.col("row_idx") - 1).otherwise(F.col("row_idx")))


def rows_as_arrays(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, cells)."""
    ordered = F.array_sort(F.collect_list(F.struct("col_idx", "text")))
    return cells.groupBy("table_id", "row_idx").agg(F.transform(ordered, lambda x: x["text"]).alias("cells"))


def as_lines(cells: DataFrame, separator: str = " | ") -> DataFrame:
    """(table_id, row_idx, line): rows as text."""
    return rows_as_arrays(cells).select("table_id", "row_idx", F.array_join("cells", separator).alias("line"))


def equal_tables(cells: DataFrame) -> DataFrame:
    """(table_id, same_as): the smallest name among the tables with as many data
    rows and equal cells; names and labels do not count.  Tables are compared by
    two 64-bit hashes over their rows, so no table meets another one."""
    rows = rows_as_arrays(cells.where("row_idx > 0"))
    tables = rows.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row_idx", "cells")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("2"), "cells", "row_idx")).alias("h2")
    )
    key = F.coalesce(F.concat_ws(":", "n", "h1", "h2"), F.lit(""))
    names = cells.select("table_id").distinct().join(tables, "table_id", "left").select("table_id", key.alias("h"))
    first = names.groupBy("h").agg(F.min("table_id").alias("same_as"))
    return names.join(first, "h").select("table_id", "same_as")


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same data cells."""
    data = lambda t: t.where("row_idx > 0").select("row_idx", "col_idx", "text")
    return not data(a).exceptAll(data(b)).take(1) and not data(b).exceptAll(data(a)).take(1)


def aggregate_column(cells: DataFrame, mapper: Column, reducer, name: str = "value") -> DataFrame:
    """(table_id, col_idx, value): mapper over every data cell's text, nulls
    dropped, then an aggregate function of the rest."""
    mapped = cells.where("row_idx > 0").select("table_id", "col_idx", mapper.alias("x")).where("x is not null")
    return mapped.groupBy("table_id", "col_idx").agg(reducer(F.col("x")).alias(name))


def linked_rows(mention: DataFrame) -> DataFrame:
    """(table_id, row_idx, uris): the entities of a row, by column."""
    ordered = F.array_sort(F.collect_list(F.struct("col_idx", "uri")))
    return mention.groupBy("table_id", "row_idx").agg(F.transform(ordered, lambda x: x["uri"]).alias("uris"))


def locations(mention: DataFrame) -> DataFrame:
    """(uri, table_id, places): where an entity stands in a table."""
    return mention.groupBy("uri", "table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx"))).alias("places"))


def entities_of(mention: DataFrame, table_id: str) -> DataFrame:
    return mention.where(F.col("table_id") == table_id).select("uri").distinct()


def strip_prefix(text: Column, prefix: str) -> Column:
    """text without prefix; one that does not begin with it is an error."""
    if not prefix:
        return text
    wrong = F.raise_error(F.concat(F.lit(f"no prefix {prefix}: "), text)).cast("string")
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(wrong)


def add_prefix(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)
