"""Semantic table search by example.

A query is a small table of entities, known to the driver.  Similarities are
computed once per (query entity, distinct lake entity), as one column for each
query entity, so rows are never multiplied by the cells of the query.  Scoring
runs on aggregates of the index: postings (uri, table_id, col_idx, n) and the
patterns of linked columns per table; only the mean without an alignment needs
rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim

KINDS = ("TYPES", "PREDICATES", "EMBEDDINGS")


@dataclass(frozen=True)
class QueryEntity:
    """What the graph and the index know of a cell of the query."""

    uri: str
    types: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    embedding: tuple[float, ...] | None = None
    idf: float = 1.0
    known: bool = False  # the lake has it


@dataclass(frozen=True)
class Options:
    """Search options; the defaults are those of a plain search by types."""

    kind: str = "TYPES"  # one of KINDS
    weighted: bool = False  # Jaccard of types weighted by their idf
    cosine: str = "NORM_COS"  # or ABS_COS, ANG_COS
    aligned: bool = False  # every query cell has one column of a table
    same_alignment: bool = False  # one alignment for all rows of the query
    maximum: bool = True  # best row of a table, else the mean of its rows
    measure: str = "EUCLIDEAN"  # or COSINE
    shared: bool = False  # one value for all cells of a query row
    strict_coverage: bool = False  # embeddings: query rows with an entity that the lake does not have count 0
    type_weights: dict[str, float] = field(default_factory=dict)  # idf of the query's types, for weighted

    def __post_init__(self):
        if self.kind not in KINDS or self.measure not in ("EUCLIDEAN", "COSINE") or self.cosine not in ("NORM_COS", "ABS_COS", "ANG_COS"):
            raise ValueError(f"no such search: {self.kind}, {self.measure}, {self.cosine}")


@dataclass(frozen=True)
class Query:
    rows: tuple[tuple[str, ...], ...]
    entities: dict[str, QueryEntity]

    @property
    def distinct(self) -> list[QueryEntity]:
        return [self.entities[u] for u in dict.fromkeys(u for r in self.rows for u in r)]

    def places(self) -> list[list[int]]:
        """Per row, the number of each cell's entity among the distinct ones."""
        number = {e.uri: i for i, e in enumerate(self.distinct)}
        return [[number[u] for u in r] for r in self.rows]

    def weights(self) -> list[list[float]]:
        """Per row, the idf of its entities by their sum."""
        idf = [[self.entities[u].idf for u in r] for r in self.rows]
        return [[x / sum(r) for x in r] if sum(r) else [0.0 for _ in r] for r in idf]


def _words(x: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in x]).cast("array<string>")


def similarity(e: QueryEntity, options: Options) -> Column:
    """Similarity of a query entity to the entity of a row (types, predicates, embedding, type_weight)."""
    if options.kind == "EMBEDDINGS":
        vector = F.lit(None).cast("array<double>") if e.embedding is None else F.array(*[F.lit(float(v)) for v in e.embedding])
        return sim.embedding_similarity(vector, F.col("embedding"), options.cosine)
    if options.kind == "PREDICATES":
        return sim.capped(sim.jaccard(_words(e.predicates), F.col("predicates")))
    if not options.weighted:
        return sim.capped(sim.jaccard(_words(e.types), F.col("types")))
    # Weights of the union: both sides' less what they share, so that only the
    # weights of the query's types are needed beside the entity's own total.
    own = {t: max(options.type_weights.get(t, 0.0), 0.0) for t in e.types}
    shared = F.lit(0.0)
    for t, w in own.items():
        shared = shared + F.when(F.array_contains("types", t), F.lit(w)).otherwise(F.lit(0.0))
    total = F.lit(float(sum(own.values()))) + F.col("type_weight") - shared
    return sim.capped(F.when(total > 0, shared / total).otherwise(0.0))


def similarities(entity: DataFrame, query: Query, options: Options) -> DataFrame:
    """(uri, s0, s1, ...): one column per distinct query entity."""
    return entity.select("uri", *[similarity(e, options).alias(f"s{i}") for i, e in enumerate(query.distinct)])


def pair_table(entity: DataFrame, query: Query, options: Options) -> DataFrame:
    """(q_uri, uri, sim)."""
    each = F.array(*[F.struct(F.lit(e.uri).alias("q_uri"), similarity(e, options).alias("sim")) for e in query.distinct])
    return entity.select("uri", F.explode(each).alias("x")).select("x.q_uri", "uri", "x.sim")


def _zero(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def _plain_vectors(base: DataFrame, mention: DataFrame, sims: DataFrame, n: int, maximum: bool) -> DataFrame:
    """(table_id, x): best or mean similarity of each query entity in a table."""
    if maximum:
        return base.groupBy("table_id").agg(F.array(*[_zero(F.max(f"s{i}")) for i in range(n)]).alias("x"))
    rows = mention.join(sims, "uri").groupBy("table_id", "row_idx").agg(*[_zero(F.max(f"s{i}")).alias(f"s{i}") for i in range(n)])
    return rows.groupBy("table_id").agg(F.array(*[F.avg(f"s{i}") for i in range(n)]).alias("x"))


def _column_scores(base: DataFrame, n: int) -> DataFrame:
    """(table_id, m): per linked column the sums and the best similarities; as
    many entries as a table has columns."""
    cols = base.groupBy("table_id", "col_idx").agg(
        F.array(*[F.round(F.sum(F.col(f"s{i}") * F.col("n")), 9) for i in range(n)]).alias("total"),
        F.array(*[_zero(F.max(f"s{i}")) for i in range(n)]).alias("best"),
    )
    return cols.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "total", "best"))).alias("m"))


def assign(score: np.ndarray) -> list[int]:
    """Column of each row of a score matrix in an assignment of most score, -1
    where there is none.  Of equal ones of up to three rows, that with the lowest
    columns first."""
    n, width = score.shape
    if n > 3 or width < n or width > 60:
        return hungarian(-score)
    if n == 1:
        return [int(score[0].argmax())]
    if n == 2:
        total = score[0][:, None] + score[1][None, :]
        total[np.arange(width), np.arange(width)] = -np.inf
        return [int(x) for x in divmod(int(total.argmax()), width)]
    total = score[0][:, None, None] + score[1][None, :, None] + score[2][None, None, :]
    i = np.arange(width)
    total[i, i, :], total[i, :, i], total[:, i, i] = -np.inf, -np.inf, -np.inf
    at = int(total.argmax())
    return [at // (width * width), at // width % width, at % width]


def _assigner(places: list[list[int]], n: int, same: bool):
    """An Arrow function: columns and flat totals of a table to the columns of all
    cells of the query, row after row."""

    @F.arrow_udf("array<int>")
    def run(cols: pa.Array, totals: pa.Array) -> pa.Array:
        out = []
        for at, flat in zip(cols.to_pylist(), totals.to_pylist()):
            score = np.zeros((n, max(at) + 1))
            score[:, at] = np.round(np.array(flat).reshape(len(at), n).T, 9)
            if same:
                # Cells of one query column stand for one: their scores are added.
                wide = max(map(len, places))
                merged = np.array([sum(score[r[c]] for r in places if c < len(r)) for c in range(wide)])
                one = assign(merged)
                out.append([x for r in places for x in one[: len(r)]])
            else:
                out.append([x for r in places for x in assign(score[r])])
        return pa.array(out, pa.list_(pa.int32()))

    return run


def _rows_that_count(aligned: Column | None) -> Column:
    """Rows with a linked cell, or with one in the aligned columns."""
    found = F.col("patterns") if aligned is None else F.filter("patterns", lambda x: F.arrays_overlap(x["cols"], aligned))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["k"])


def _aligned_vectors(base: DataFrame, patterns: DataFrame, query: Query, options: Options) -> DataFrame:
    """(table_id, x, rows): value of each query cell, row after row, and per query
    row the table rows that count.  patterns: (table_id, cols, n)."""
    places, n = query.places(), len(query.distinct)
    m = _column_scores(base, n)
    run = _assigner(places, n, options.same_alignment)
    m = m.withColumn("at", run(F.transform("m", lambda c: c["col_idx"]), F.flatten(F.transform("m", lambda c: c["total"]))))
    flat = [(i, j) for j, i in enumerate(i for r in places for i in r)]  # entity, place in the flat list
    of = lambda i, j, what: F.coalesce(F.get(F.filter("m", lambda c: c["col_idx"] == F.get("at", F.lit(j))), F.lit(0))[what][i], F.lit(0.0))
    p = patterns.groupBy("table_id").agg(F.collect_list(F.struct("cols", F.col("n").alias("k"))).alias("patterns"))
    m = m.join(p, "table_id")
    counts, j = [], 0
    for r in places:
        mine = F.slice("at", j + 1, len(r))
        counts.append(_rows_that_count(mine if options.kind == "EMBEDDINGS" else None))
        j += len(r)
    m = m.withColumn("rows", F.array(*counts))
    if options.maximum:
        return m.select("table_id", "rows", F.array(*[of(i, j, "best") for i, j in flat]).alias("x"))
    row_of = [k for k, r in enumerate(places) for _ in r]
    mean = [F.coalesce(F.try_divide(of(i, j, "total"), F.get("rows", F.lit(row_of[j]))), F.lit(0.0)) for i, j in flat]
    return m.select("table_id", "rows", F.array(*mean).alias("x"))


def relevance(x: list[Column], w: list[float], measure: str) -> Column:
    """Of one query row: x by cell, weights by cell."""
    add = lambda cs: sum(cs[1:], cs[0])
    if measure == "EUCLIDEAN":
        return 1 / (1 + F.sqrt(add([F.lit(v) * (c - 1) * (c - 1) for c, v in zip(x, w)])))
    return F.coalesce(F.try_divide(add(x), F.sqrt(add([c * c for c in x])) * F.lit(float(len(x)) ** 0.5)), F.lit(0.0))


def score_tables(query: Query, options: Options, entity: DataFrame, posting: DataFrame, mention: DataFrame, patterns: DataFrame) -> DataFrame:
    """(table_id, score, row_scores, row_vectors) of the tables with a linked cell.
    Scores have six decimals, so that ties do not depend on the order of sums.

    entity: uri, types, predicates, embedding, type_weight.  The others may be
    restricted to candidate tables."""
    sims = similarities(entity, query, options)
    base = posting.join(sims, "uri")
    places, weights = query.places(), query.weights()
    if options.aligned:
        vectors = _aligned_vectors(base, patterns, query, options)
        at = {(k, c): j for j, (k, c) in enumerate((k, c) for k, r in enumerate(places) for c in range(len(r)))}
        cell = lambda k, c: F.get("x", F.lit(at[k, c]))
    else:
        vectors = _plain_vectors(base, mention, sims, len(query.distinct), options.maximum)
        cell = lambda k, c: F.get("x", F.lit(places[k][c]))
    scores, cells = [], []
    for k, r in enumerate(places):
        x = [cell(k, c) for c in range(len(r))]
        if options.shared:
            one = F.greatest(*x) if options.maximum and len(x) > 1 else sum(x[1:], x[0]) / len(x)
            x = [one] * len(x)
        s = relevance(x, weights[k], options.measure)
        if options.kind == "EMBEDDINGS":
            if options.aligned:
                s = F.when(F.get("rows", F.lit(k)) > 0, s).otherwise(0.0)
            if options.strict_coverage and not all(query.entities[u].known for u in query.rows[k]):
                s = F.lit(0.0)
        scores.append(s)
        cells.append(F.array(*x))
    out = vectors.select("table_id", F.array(*scores).alias("row_scores"), F.array(*cells).alias("row_vectors"))
    total = F.aggregate("row_scores", F.lit(0.0), lambda a, s: a + s)
    return out.select("table_id", rounded(total / len(places)).alias("score"), "row_scores", "row_vectors")


def comparisons(query: Query, entity: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row of counters of a search by embeddings: pairs compared, pairs without
    both embeddings, query entities without one, linked rows of the lake."""
    q = query.distinct
    have = sum(e.embedding is not None for e in q)
    pairs = entity.agg(F.count(F.lit(1)).alias("entities"), F.count("embedding").alias("embedded"))
    rows = patterns.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked_rows"))
    return pairs.join(rows).select(
        (F.col("embedded") * have).alias("compared"), (F.col("entities") * len(q) - F.col("embedded") * have).alias("not_comparable"),
        F.lit(len(q) - have).cast("long").alias("query_without_embedding"), "linked_rows",
    )


def cell_scores(query: DataFrame, mention: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per query cell and linked lake cell: table_id, row_idx, col_idx, q_row, q_col, sim."""
    return mention.join(pairs, "uri").join(query.select("q_row", "q_col", F.col("uri").alias("q_uri")), "q_uri")


def column_sums(scored: DataFrame) -> DataFrame:
    return scored.groupBy("table_id", "q_row", "q_col", "col_idx").agg(F.sum("sim").alias("score"))


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in an assignment of least cost, -1 where there is none."""
    n, m = cost.shape
    size = max(n, m)
    a = np.zeros((size + 1, size + 1))
    a[1 : n + 1, 1 : m + 1] = cost
    u, v, match, way = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            gap = a[match[j0]] - u[match[j0]] - v
            better = ~used & (gap < least)
            better[0] = False
            least[better], way[better] = gap[better], j0
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            j1 = int(free.argmin())
            delta = free[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    row = [-1] * n
    for j in range(1, m + 1):
        if 1 <= match[j] <= n:
            row[match[j] - 1] = j - 1
    return row


def best_by_enumeration(cost: np.ndarray) -> float:
    """Least cost of an assignment by trying all; for tests."""
    n, m = cost.shape
    if n > m:
        return best_by_enumeration(cost.T)
    return min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))


def align(sums: DataFrame) -> DataFrame:
    """(table_id, q_row, q_col, col_idx): query cells to columns.  One small matrix
    per table and query row, many of them to an Arrow batch."""
    m = sums.groupBy("table_id", "q_row").agg(F.collect_list(F.struct("q_col", "col_idx", F.round("score", 9).alias("score"))).alias("m"))

    @F.pandas_udf("array<int>")
    def run(q: pd.Series, c: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for qs, cs, ss in zip(q, c, s):
            score = np.zeros((max(qs) + 1, max(cs) + 1))
            score[qs, cs] = ss
            out.append(assign(score))
        return pd.Series(out)

    part = lambda name: F.transform("m", lambda x: x[name])
    return m.select("table_id", "q_row", F.posexplode(run(part("q_col"), part("col_idx"), part("score"))).alias("q_col", "col_idx"))


def covered_rows(query: DataFrame, mention: DataFrame, aligned: DataFrame) -> DataFrame:
    """(table_id, row_idx, q_row) where at least one aligned column is linked."""
    return mention.join(aligned.where("col_idx >= 0"), ["table_id", "col_idx"]).select("table_id", "row_idx", "q_row").distinct()


def top_k(scores: DataFrame, tables: DataFrame, k: int) -> DataFrame:
    """The best k of all tables, those without evidence at 0.0; ties by table_id.
    Other columns of scores stay."""
    rest = [c for c in scores.columns if c not in ("table_id", "score")]
    all_scores = tables.select("table_id").join(scores, "table_id", "left").select("table_id", F.coalesce("score", F.lit(0.0)).alias("score"), *rest)
    return all_scores.orderBy(F.desc("score"), "table_id").limit(k)


def rounded(c: Column) -> Column:
    return F.round(c, 6)
