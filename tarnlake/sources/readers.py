"""Sources and sinks of lakes, graphs, embeddings, queries and results."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "table_id string, row_idx int, col_idx int, text string"


def read_csv_lake(spark: SparkSession, path: str, header_as_row: bool = True) -> DataFrame:
    """All .csv files below path as lake_cell; ragged rows stay ragged.  One small
    table is one record; larger tables belong in the cell layout."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    rows = list(csv.reader(io.StringIO(bytes(raw).decode("utf-8"), newline=""), strict=True))
                except (csv.Error, UnicodeDecodeError):
                    continue  # a table that cannot be parsed is no table
                name = p.rsplit("/", 1)[-1]
                for at in range(0, len(rows), 10_000):
                    part = enumerate(rows[at : at + 10_000], at)
                    cells = [(name, i, j, x) for i, r in part if header_as_row or i for j, x in enumerate(r)]
                    yield pd.DataFrame(cells, columns=["table_id", "row_idx", "col_idx", "text"])

    return files.select("path", "content").mapInPandas(parse, CELL)


def matrix_cells(spark: SparkSession, table_id: str, rows: list[list[str]]) -> DataFrame:
    return spark.createDataFrame([(table_id, i, r) for i, r in enumerate(rows)], "table_id string, row_idx int, cells array<string>").select("table_id", "row_idx", F.posexplode("cells").alias("col_idx", "text"))


def read_json_tables(spark: SparkSession, path: str) -> DataFrame:
    """Single-object JSON tables (_id, headers, rows) as lake_cell."""
    cell = "array<struct<text:string>>"
    t = spark.read.schema(f"_id string, headers {cell}, rows array<{cell}>").option("multiLine", "true").json(path)
    both = t.select(F.col("_id").alias("table_id"), F.posexplode(F.concat(F.array("headers"), "rows")).alias("row_idx", "r"))
    return both.select("table_id", "row_idx", F.posexplode(F.col("r.text")).alias("col_idx", "text"))


def read_embeddings(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """Lines 'uri v1 ... vd'; the uri may hold the delimiter before its '://'.  A
    token after it that is no decimal is an error; lines without a uri are left out."""
    parts = F.split("value", rf"\Q{delimiter}\E")
    t = spark.read.text(path).where(F.contains("value", F.lit("://"))).withColumn("p", parts)
    first = F.expr("filter(sequence(0, size(p) - 1), i -> contains(p[i], '://'))[0]")
    t = t.withColumn("k", first)
    wrong = lambda x: F.raise_error(F.concat(F.lit("neither an entity nor a decimal: "), x)).cast("double")
    tokens = F.expr("filter(slice(p, k + 2, size(p)), x -> x <> '')")
    values = F.transform(tokens, lambda x: F.coalesce(x.try_cast("double"), wrong(x)))
    return t.select(F.array_join(F.expr("slice(p, 1, k + 1)"), delimiter).alias("uri"), values.alias("embedding"))


_TRIPLE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*$'


def triples_of(lines: DataFrame) -> DataFrame:
    """Lines (value) to kg_triple; malformed ones are left out, repeated ones count once."""
    part = lambda k: F.regexp_extract("value", _TRIPLE, k)
    t = lines.distinct().where(F.col("value").rlike(_TRIPLE))
    iri = part(3) != ""
    return t.select(part(1).alias("s"), part(2).alias("p"), F.when(iri, part(3)).otherwise(part(4)).alias("o"), F.when(iri, "iri").otherwise("literal").alias("o_kind")).distinct()


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or one-triple-a-line Turtle as kg_triple."""
    return triples_of(spark.read.text(path))


def read_screened_triples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of the lines that import_lines lets through."""
    return triples_of(import_lines(spark.read.text(path)))


def import_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) fit for import: made ASCII, beginning with a web address and an IRI, without the excluded host."""
    plain = lines.withColumn("value", F.regexp_replace("value", r"[^\x00-\x7F]", ""))
    return plain.where(F.col("value").rlike(r"^<http[^>]*>\s+<") & ~F.contains("value", F.lit("xn--b1aew")))


def subjects(kg: DataFrame) -> DataFrame:
    return kg.select("s").distinct()


def predicates(kg: DataFrame) -> DataFrame:
    return kg.select("p").distinct()


def objects(kg: DataFrame) -> DataFrame:
    return kg.select("o").distinct()


def parse_query(text: Column) -> Column:
    """'a<>b#c' to rows of cells; empty rows at the end go, inner ones stay."""
    return F.transform(F.split(F.regexp_replace(text, "#+$", ""), "#"), lambda r: F.split(r, "<>"))


def format_query(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "<>")), "#")


def query_cells(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(q_row, q_col, uri) of a query text."""
    rows = queries.select(F.posexplode(parse_query(F.col(text_col))).alias("q_row", "r"))
    return rows.select("q_row", F.posexplode("r").alias("q_col", "uri"))


def read_query_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("queries array<array<string>>").option("multiLine", "true").json(path).select(F.posexplode("queries").alias("q_row", "r"))
    return rows.select("q_row", F.posexplode("r").alias("q_col", "uri"))


CELLS = "array<array<struct<text:string>>>"
RESULT = f"struct<scores:array<struct<`table ID`:string,headers:array<string>,table:{CELLS},score:double>>,runtime:long,reduction:double,message:string>"


def result_json(scores: DataFrame, cells: DataFrame, runtime: int = 0, reduction: float = 0.0, message: str | None = None) -> DataFrame:
    """One row: the result document of the winners, best first.  scores has the k tables of a result."""
    text = lambda r: F.transform(r, lambda c: c["text"])
    rows = cells.join(scores.select("table_id"), "table_id").groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "text"))).alias("r"))
    tables = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "r"))).alias("rows"))
    heads = F.flatten(F.transform(F.filter("rows", lambda x: x["row_idx"] == 0), lambda x: text(x["r"])))
    body = F.transform("rows", lambda x: F.transform(x["r"], lambda c: F.struct(c["text"].alias("text"))))
    entry = F.struct((-F.col("score")).alias("o"), F.col("table_id"), F.struct(F.col("table_id").alias("table ID"), heads.alias("headers"), body.alias("table"), "score").alias("e"))
    all_in = scores.join(tables, "table_id", "left").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("scores"))
    rest = [F.lit(runtime).alias("runtime"), F.lit(reduction).alias("reduction")] + ([] if message is None else [F.lit(message).alias("message")])
    return all_in.select(F.to_json(F.struct("scores", *rest)).alias("json"))


def from_result_json(documents: DataFrame) -> DataFrame:
    """(rank, table_id, score, headers, n_rows) of the tables of a result document."""
    r = documents.select(F.from_json("json", RESULT).alias("r"))
    x = r.select(F.posexplode("r.scores").alias("rank", "x"))
    return x.select("rank", F.col("x.table ID").alias("table_id"), "x.score", "x.headers", F.size("x.table").alias("n_rows"))


def result_cells(documents: DataFrame) -> DataFrame:
    """The tables of a result document as lake_cell."""
    r = documents.select(F.explode(F.from_json("json", RESULT)["scores"]).alias("x"))
    rows = r.select(F.col("x.table ID").alias("table_id"), F.posexplode("x.table").alias("row_idx", "r"))
    return rows.select("table_id", "row_idx", F.posexplode(F.transform("r", lambda c: c["text"])).alias("col_idx", "text"))


def within_bytes(scores: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """The best tables whose sizes together stay within most bytes.  scores is a
    result of k tables, so one task can add them up."""
    from pyspark.sql import Window

    until = F.sum("bytes").over(Window.orderBy(F.desc("score"), "table_id").rowsBetween(Window.unboundedPreceding, 0))
    return scores.join(sizes, "table_id").withColumn("until", until).where(F.col("until") <= most).select("table_id", "score")


def table_bytes(cells: DataFrame) -> DataFrame:
    """(table_id, bytes): size of the cells' texts."""
    return cells.groupBy("table_id").agg(F.sum(F.octet_length("text")).alias("bytes"))


def write_triples(kg: DataFrame, path: str) -> None:
    """The graph as N-Triples; read_triples reads it back."""
    literal = F.concat(F.lit('"'), "o", F.lit('"'))
    end = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(literal)
    kg.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), end, F.lit(" ."))).write.mode("overwrite").text(path)


def cypher_lines(kg: DataFrame) -> DataFrame:
    """The graph as Cypher statements, one a line."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    name = F.concat(F.lit("`"), "p", F.lit("`"))
    edge = F.concat(F.lit("MERGE (a:Resource {uri: "), quoted("s"), F.lit("}) MERGE (b:Resource {uri: "), quoted("o"), F.lit("}) MERGE (a)-[:"), name, F.lit("]->(b);"))
    fact = F.concat(F.lit("MERGE (a:Resource {uri: "), quoted("s"), F.lit("}) SET a."), name, F.lit(" = "), quoted("o"), F.lit(";"))
    return kg.select(F.when(F.col("o_kind") == "iri", edge).otherwise(fact).alias("line"))


def rdf_mentions(mention: DataFrame, prefix: str = "lake:") -> DataFrame:
    """Turtle lines: tables, and the entities that they mention."""
    t = F.concat(F.lit(f"<{prefix}"), "table_id", F.lit(">"))
    said = mention.select(F.concat(t, F.lit(" <https://schema.org/mentions> <"), "uri", F.lit("> .")).alias("line"))
    kind = mention.select(F.concat(t, F.lit(" <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <https://schema.org/Table> .")).alias("line"))
    return said.unionByName(kind).distinct()
