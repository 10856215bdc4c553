"""Command line: python -m tarnlake --root FOLDER COMMAND …"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .engine import PREFILTERS, SIMILARITIES, Engine


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnlake")
    top.add_argument("--root", required=True, help="folder of the lake")
    commands = top.add_subparsers(dest="command", required=True)
    insert = commands.add_parser("insert", help="CSV files below a folder")
    insert.add_argument("path")
    insert.add_argument("--table-prefix", default="")
    insert.add_argument("--kg-prefix", default="")
    embeddings = commands.add_parser("embeddings", help="a text file of vectors")
    embeddings.add_argument("path")
    embeddings.add_argument("--delimiter", default=" ")
    commands.add_parser("graph", help="a file of triples").add_argument("path")
    search = commands.add_parser("search", help="tables like a query, as JSON")
    search.add_argument("query", help="a<>b#c<>d")
    search.add_argument("-k", type=int, default=10)
    search.add_argument("--similarity", choices=sorted(SIMILARITIES), default="TYPES")
    search.add_argument("--measure", choices=("EUCLIDEAN", "COSINE"), default="EUCLIDEAN")
    search.add_argument("--prefilter", choices=PREFILTERS, default="NONE")
    search.add_argument("--weighted", action="store_true")
    search.add_argument("--mean", action="store_true", help="the mean of a table's rows, not the best one")
    search.add_argument("--any-column", action="store_true", help="without an alignment of cells to columns")
    keyword = commands.add_parser("keyword", help="entities by words")
    keyword.add_argument("words")
    commands.add_parser("count", help="tables with an entity").add_argument("uri")
    commands.add_parser("stats", help="of the lake")
    commands.add_parser("table-stats", help="of a table").add_argument("table")
    commands.add_parser("remove-table").add_argument("table")
    commands.add_parser("clear")
    commands.add_parser("clear-embeddings")
    return top


def _rows(df: DataFrame) -> str:
    """A bounded result as JSON: hits, or one row of statistics."""
    return json.dumps([r.asDict() for r in df.collect()])


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = _parser().parse_args(arguments)
    lake = Engine(spark or SparkSession.builder.appName("tarnlake").getOrCreate(), a.root)
    if a.command == "search":
        found = lake.search(a.query, a.k, a.similarity, not a.any_column, not a.mean, a.measure, a.weighted, prefilter=a.prefilter)
        return found.json(lake.store.cells()).first()["json"]
    commands = {
        "insert": lambda: json.dumps({"refused": lake.ingest(a.path, a.table_prefix, a.kg_prefix)}),
        "embeddings": lambda: lake.load_embeddings(a.path, a.delimiter),
        "graph": lambda: lake.load_graph(a.path),
        "keyword": lambda: _rows(lake.keyword_search(a.words)),
        "count": lambda: json.dumps({"tables": lake.count(a.uri)}),
        "stats": lambda: _rows(lake.stats()),
        "table-stats": lambda: _rows(lake.table_stats(a.table)),
        "remove-table": lambda: json.dumps({"removed": lake.remove_table(a.table)}),
        "clear": lake.clear,
        "clear-embeddings": lake.clear_embeddings,
    }
    return commands[a.command]() or "{}"


if __name__ == "__main__":
    print(main())
