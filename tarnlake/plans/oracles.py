"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from .lake import CTE

_QUERY = """,
q AS (
  SELECT 0 AS q_row, 0 AS q_col, 'kg:' || replace(arg_min(p_name, p_partkey), ' ', '_') AS uri FROM part
  UNION ALL SELECT 0, 1, 'kg:' || replace(arg_min(p_brand, p_partkey), ' ', '_') FROM part
  UNION ALL SELECT 1, 0, 'kg:' || replace(arg_min(s_name, s_suppkey), ' ', '_') FROM supplier
  UNION ALL SELECT 1, 1, 'kg:' || replace(arg_min(n_name, s_suppkey), ' ', '_') FROM supplier JOIN nation ON s_nationkey = n_nationkey{more})"""
_NAMES = """,
asked AS (SELECT uri FROM q UNION SELECT 'kg:ext_' || substr(uri, 4) FROM q WHERE q_row = 1 AND q_col = 1)"""
_PLAIN, _RAGGED = _QUERY.format(more=""), _QUERY.format(more=" UNION ALL SELECT 2, 0, 'kg:nobody'")


def _set_sim(table: str, column: str) -> str:
    return f""",
qs AS (SELECT DISTINCT q.uri AS q_uri, coalesce({column}, []) AS a FROM q LEFT JOIN {table} t ON t.uri = q.uri),
us AS (SELECT u.uri, coalesce({column}, []) AS b FROM lake_uri u LEFT JOIN {table} t ON t.uri = u.uri),
sim AS (SELECT q_uri, uri, least(0.95, coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0)) AS sim FROM qs, us)"""


_WEIGHTED = """,
qs AS (SELECT DISTINCT q.uri AS q_uri, coalesce(types, []) AS a FROM q LEFT JOIN ent_types t ON t.uri = q.uri),
pu AS (SELECT q_uri, u.uri, unnest(list_distinct(list_concat(a, types))) AS type, a, types FROM qs, lake_uri u JOIN ent_types t ON t.uri = u.uri),
sim AS (SELECT q_uri, uri, least(0.95, coalesce(sum(CASE WHEN list_contains(a, type) AND list_contains(types, type) THEN greatest(coalesce(idf, 0), 0) ELSE 0 END)
  / nullif(sum(greatest(coalesce(idf, 0), 0)), 0), 0)) AS sim FROM pu LEFT JOIN type_idf USING (type) GROUP BY q_uri, uri)"""


def _cosine(body: str) -> str:
    return f""",
qs AS (SELECT DISTINCT q.uri AS q_uri, embedding AS a FROM q LEFT JOIN emb ON emb.uri = q.uri),
us AS (SELECT u.uri, embedding AS b FROM lake_uri u LEFT JOIN emb ON emb.uri = u.uri),
cs AS (SELECT q_uri, uri, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(-1, least(1, list_cosine_similarity(a, b))) END AS c FROM qs, us),
sim AS MATERIALIZED (SELECT q_uri, uri, coalesce({body}, 0) AS sim FROM cs)"""


_SIMS = {
    "types": _set_sim("ent_types", "types"), "predicates": _set_sim("ent_preds", "predicates"), "weighted": _WEIGHTED,
    "norm": _cosine("(c + 1) / 2"), "abs": _cosine("abs(c)"), "ang": _cosine("1 - acos(c) / pi()"),
}
_SCORED = """,
scored AS (SELECT table_id, row_idx, col_idx, q_row, q_col, sim FROM mention JOIN sim USING (uri) JOIN q ON q.uri = q_uri)"""
# Two cells of a query row: of all pairs of different columns the best one, ties to the lowest.
_ALIGNED = """,
sums AS MATERIALIZED (SELECT table_id, q_row, q_col, col_idx, round(sum(sim), 9) AS score, greatest(max(sim), 0) AS best FROM scored GROUP BY ALL),
width AS (SELECT table_id, max(col_idx) AS last FROM mention GROUP BY table_id),
spots AS (SELECT table_id, q_row, CAST(c AS INT) AS c FROM width, range(0, 16) r(c), (SELECT DISTINCT q_row FROM q) WHERE c <= last),
s0 AS (SELECT p.table_id, p.q_row, c, coalesce(score, 0) AS score FROM spots p LEFT JOIN sums s ON s.table_id = p.table_id AND s.q_row = p.q_row AND q_col = 0 AND col_idx = c),
s1 AS (SELECT p.table_id, p.q_row, c, coalesce(score, 0) AS score FROM spots p LEFT JOIN sums s ON s.table_id = p.table_id AND s.q_row = p.q_row AND q_col = 1 AND col_idx = c),
chosen AS MATERIALIZED (SELECT s0.table_id, s0.q_row, s0.c AS c0, s1.c AS c1 FROM s0 JOIN s1 ON s0.table_id = s1.table_id AND s0.q_row = s1.q_row AND s0.c <> s1.c
  QUALIFY row_number() OVER (PARTITION BY s0.table_id, s0.q_row ORDER BY s0.score + s1.score DESC, s0.c, s1.c) = 1),
aligned AS (SELECT table_id, q_row, 0 AS q_col, c0 AS c FROM chosen UNION ALL SELECT table_id, q_row, 1, c1 FROM chosen)"""
_ALIGNED_MAX = _ALIGNED + ", vec AS (SELECT aligned.table_id, aligned.q_row, aligned.q_col, coalesce(best, 0) AS x FROM aligned LEFT JOIN sums s ON s.table_id = aligned.table_id AND s.q_row = aligned.q_row AND s.q_col = aligned.q_col AND s.col_idx = c)"
_ROWS = ", counts AS (SELECT table_id, q_row, count(DISTINCT row_idx) AS k FROM mention, (SELECT DISTINCT q_row FROM q) GROUP BY ALL)"
_COVERED = ", counts AS (SELECT m.table_id, aligned.q_row, count(DISTINCT m.row_idx) AS k FROM mention m JOIN aligned ON aligned.table_id = m.table_id AND aligned.c = m.col_idx GROUP BY ALL)"
_ALIGNED_MEAN = ", vec AS (SELECT aligned.table_id, aligned.q_row, aligned.q_col, coalesce(score, 0) / k AS x FROM aligned JOIN counts n ON n.table_id = aligned.table_id AND n.q_row = aligned.q_row LEFT JOIN sums s ON s.table_id = aligned.table_id AND s.q_row = aligned.q_row AND s.q_col = aligned.q_col AND s.col_idx = c)"
_MAX = ", vec AS (SELECT table_id, q_row, q_col, greatest(max(sim), 0) AS x FROM scored GROUP BY ALL)"
_MEAN = ", vr AS (SELECT table_id, q_row, q_col, row_idx, greatest(max(sim), 0) AS x FROM scored GROUP BY ALL), vec AS (SELECT table_id, q_row, q_col, avg(x) AS x FROM vr GROUP BY ALL)"
_SHARED = ", v0 AS (SELECT table_id, q_row, greatest(max(sim), 0) AS x FROM scored GROUP BY ALL), vec AS (SELECT table_id, q_row, q_col, x FROM v0 JOIN q USING (q_row))"
_WEIGHTS = """,
w0 AS (SELECT q_row, q_col, coalesce(idf, 1.0) AS w FROM q LEFT JOIN ent_idf USING (uri)),
w AS (SELECT q_row, q_col, w / sum(w) OVER (PARTITION BY q_row) AS w FROM w0),
rel AS (SELECT table_id, q_row, {row} AS r FROM vec JOIN w USING (q_row, q_col) GROUP BY ALL),
score AS (SELECT table_id, round(sum(r) / (SELECT count(DISTINCT q_row) FROM q), 6) AS score FROM rel GROUP BY table_id)
SELECT table_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT table_id FROM cells) LEFT JOIN score USING (table_id)
ORDER BY score DESC, table_id LIMIT 10"""
_EUCLID = _WEIGHTS.format(row="1 / (1 + sqrt(sum(w * (x - 1) * (x - 1))))")
_COSINE = _WEIGHTS.format(row="coalesce(sum(x) / nullif(sqrt(sum(x * x)) * sqrt(count(*)), 0), 0)")


def _search(kind: str, vec: str = _MAX, end: str = _EUCLID, query: str = _PLAIN) -> str:
    return CTE + query + _SIMS[kind] + _SCORED + vec + end


def _pairs(kind: str) -> str:
    return CTE + _PLAIN + _SIMS[kind] + " SELECT q_uri, uri, round(sim, 6) AS sim FROM sim"


_NEAR = """,
near AS (SELECT q.uri AS q_uri, e.uri, row_number() OVER (PARTITION BY q.uri ORDER BY round(greatest(-1, least(1, list_cosine_similarity(a.embedding, e.embedding))), 9) DESC, e.uri) AS rank
  FROM (SELECT DISTINCT uri FROM q) q JOIN emb a ON a.uri = q.uri CROSS JOIN (SELECT emb.* FROM emb JOIN lake_uri USING (uri)) e QUALIFY rank <= 20),
near_tables AS (SELECT DISTINCT table_id FROM mention WHERE uri IN (SELECT uri FROM near))"""


def _bm25(docs: str, words: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words.split())
    return f"""
d AS ({docs}),
tok AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM d),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
tf AS (SELECT id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, (SELECT unnest([{listed}]) AS term) WHERE list_contains(t, term)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
FROM tf JOIN df USING (term), st GROUP BY id ORDER BY score DESC, id LIMIT 10"""


_SUMS = CTE + _PLAIN + _SIMS["types"] + _SCORED + ", sums AS (SELECT table_id, q_row, q_col, col_idx, sum(sim) AS score FROM scored GROUP BY ALL)"

ORACLES: dict[str, str] = {
    "cell_scan": CTE + "SELECT table_id, count(*) AS n_cells, max(row_idx) AS last_row FROM cells GROUP BY table_id",
    "link_cells": CTE + "SELECT table_id, col_idx, count(uri) AS linked, count(*) AS n_cells FROM cells LEFT JOIN link USING (text) GROUP BY ALL",
    "inverted_index": CTE + "SELECT uri, table_id, count(*) AS n, min(row_idx) AS first_row FROM mention GROUP BY ALL",
    "table_entities": CTE + "SELECT DISTINCT uri FROM mention WHERE table_id = 'customer_1.csv'",
    "entity_profile": CTE + "SELECT u.uri, coalesce(array_to_string(types, ','), '') AS types, coalesce(array_to_string(predicates, ','), '') AS predicates FROM lake_uri u LEFT JOIN ent_types t ON t.uri = u.uri LEFT JOIN ent_preds p ON p.uri = u.uri",
    "entity_idf": CTE + "SELECT uri, round(idf, 6) AS idf FROM ent_idf",
    "type_idf": CTE + "SELECT type, round(idf, 6) AS idf FROM type_idf",
    "jaccard_types": _pairs("types"), "jaccard_types_weighted": _pairs("weighted"), "jaccard_predicates": _pairs("predicates"),
    "cosine_norm": _pairs("norm"), "cosine_abs": _pairs("abs"), "cosine_ang": _pairs("ang"),
    "column_sim_sum": _SUMS + " SELECT table_id, q_row, q_col, col_idx, round(score, 6) AS score FROM sums",
    # Two query cells: try every pair of different columns.
    "hungarian_align": _SUMS + ", s0 AS (SELECT * FROM sums WHERE q_col = 0), s1 AS (SELECT * FROM sums WHERE q_col = 1)"
    " SELECT s0.table_id, s0.q_row, round(max(s0.score + s1.score), 4) AS total FROM s0 JOIN s1 ON s0.table_id = s1.table_id AND s0.q_row = s1.q_row AND s0.col_idx <> s1.col_idx GROUP BY ALL",
    "search_types_max_euclid": _search("types"), "search_types_mean_euclid": _search("types", vec=_MEAN), "search_types_cosine": _search("types", end=_COSINE),
    "search_types_weighted": _search("weighted"), "search_predicates": _search("predicates"), "search_embeddings_norm": _search("norm"),
    "search_ragged_unknown": _search("types", query=_RAGGED), "search_compat_shared": _search("types", vec=_SHARED),
    "knn_prefilter": CTE + _PLAIN + _NEAR + " SELECT table_id FROM near_tables",
    "split_vote_prefilter": CTE + ", q AS (SELECT CAST(s_suppkey - min(s_suppkey) OVER () AS INT) AS q_row, 0 AS q_col, 'kg:' || replace(s_name, ' ', '_') AS uri FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 9))"
    + _NEAR + ", sp AS (SELECT DISTINCT CASE WHEN (SELECT max(q_row) + 1 FROM q) >= 8 THEN q_row // 3 ELSE 0 END AS split, near.uri FROM q JOIN near ON near.q_uri = q.uri),"
    " c AS (SELECT DISTINCT split, table_id FROM sp JOIN mention USING (uri)) SELECT table_id FROM c GROUP BY table_id HAVING count(*) >= 2",
    "prefiltered_search": (CTE + _PLAIN + _NEAR + _SIMS["types"] + _SCORED + _MAX + _EUCLID).replace(
        "(SELECT DISTINCT table_id FROM cells) LEFT", "near_tables LEFT").replace("coalesce(score, 0.0) AS score FROM",
        "coalesce(score, 0.0) AS score, round(1 - (SELECT count(*) FROM near_tables) / (SELECT count(DISTINCT table_id)::DOUBLE FROM cells), 6) AS reduction FROM"),
    "element_popularity_table": CTE + "SELECT type AS element, count(DISTINCT table_id) AS tables, round(count(DISTINCT table_id) / (SELECT count(DISTINCT table_id)::DOUBLE FROM mention), 6) AS share FROM mention JOIN lake_types USING (uri) GROUP BY type",
    "column_centroid": CTE + "SELECT table_id, col_idx, CAST(i - 1 AS INT) AS pos, round(avg(embedding[i]), 6) AS mean FROM mention JOIN emb USING (uri), range(1, 65) r(i) GROUP BY ALL",
    "bm25_entities": CTE + "," + _bm25("SELECT s AS id, o AS text FROM kg WHERE p = 'rdfs:label'", "brand supplier"),
    "bm25_documents": "WITH" + _bm25("SELECT doc_id AS id, text FROM documents", "the password worthless"),
    "lake_stats": CTE + "SELECT (SELECT count(*) FROM lake_uri) AS entities, (SELECT count(DISTINCT type) FROM lake_types) AS types, (SELECT count(DISTINCT p) FROM (SELECT unnest(predicates) AS p FROM ent_preds JOIN lake_uri USING (uri))) AS predicates,"
    " (SELECT count(*) FROM emb) AS embeddings, (SELECT count(*) FROM mention) AS linked_cells, (SELECT count(DISTINCT table_id) FROM cells) AS tables",
    "table_stats": CTE + "SELECT table_id, count(*) AS entities, CAST(sum(len(types)) AS BIGINT) AS types, CAST(sum(len(predicates)) AS BIGINT) AS predicates, count(emb.uri) AS embeddings FROM (SELECT DISTINCT table_id, uri FROM mention) m"
    " JOIN ent_types USING (uri) JOIN ent_preds USING (uri) LEFT JOIN emb ON emb.uri = m.uri GROUP BY table_id",
    "entity_count": CTE + "SELECT uri, count(DISTINCT table_id) AS tables FROM mention GROUP BY uri",
    "table_profile": CTE + ", pc AS (SELECT table_id, string_agg(col_idx || ':' || k, ',' ORDER BY col_idx) AS per_column FROM (SELECT table_id, col_idx, count(*) AS k FROM mention GROUP BY ALL) GROUP BY table_id)"
    " SELECT c.table_id, count(DISTINCT c.row_idx) AS n_rows, count(DISTINCT c.col_idx) AS n_cols, count(*) AS n_cells, count(DISTINCT m.uri) AS entities, count(m.uri) AS mapped_cells,"
    " count(DISTINCT m.row_idx) AS mapped_rows, coalesce(max(per_column), '') AS per_column FROM cells c LEFT JOIN mention m ON m.table_id = c.table_id AND m.row_idx = c.row_idx AND m.col_idx = c.col_idx LEFT JOIN pc ON pc.table_id = c.table_id GROUP BY c.table_id",
    "usage_by_week": "SELECT CAST(year(ts) AS INT) AS year, CAST(weekofyear(ts) AS INT) AS week, event_type AS endpoint, count(*) AS uses FROM events GROUP BY ALL",
    "kg_size": CTE + "SELECT (SELECT count(*) FROM (SELECT s FROM kg WHERE o_kind = 'iri' UNION SELECT o FROM kg WHERE o_kind = 'iri')) AS nodes, (SELECT count(*) FROM kg WHERE o_kind = 'iri') AS edges",
    "kg_degree": CTE + "SELECT node, count(*) AS degree FROM (SELECT s AS node FROM kg WHERE o_kind = 'iri' UNION ALL SELECT o FROM kg WHERE o_kind = 'iri') GROUP BY node",
    "kg_sameas_exists": CTE + _RAGGED + _NAMES + " SELECT a.uri, CASE WHEN a.uri IN (SELECT s FROM kg WHERE o_kind = 'iri') THEN a.uri ELSE min(k.s) END AS entity FROM asked a LEFT JOIN kg k ON k.o = a.uri AND k.p LIKE '%sameAs%' GROUP BY a.uri",
    "kg_subgraph": CTE + _RAGGED + _NAMES + " SELECT u.uri, max(l.o) AS label, count(DISTINCT e.o) AS neighbours FROM asked u LEFT JOIN kg l ON l.s = u.uri AND l.p = 'rdfs:label' LEFT JOIN kg e ON e.s = u.uri AND e.o_kind = 'iri' GROUP BY u.uri",
    "rdf_mentions": CTE + "SELECT '<lake:' || table_id || '> <https://schema.org/mentions> <' || uri || '> .' AS line FROM mention UNION SELECT '<lake:' || table_id || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <https://schema.org/Table> .' FROM mention",
    "query_roundtrip": "SELECT * FROM (VALUES (0, 0, 'a'), (0, 1, 'b'), (1, 0, ''), (2, 0, 'c'), (2, 1, 'd')) t(q_row, q_col, uri)",
    "pagerank_ppr": CTE + _PLAIN + """,
e AS (SELECT s AS a, o AS b, 0.85 / count(*) OVER (PARTITION BY s) AS share FROM kg WHERE o_kind = 'iri' AND p <> 'rdf:type'),
m0 AS (SELECT uri AS node, 0.25 AS mass FROM q),
m1 AS (SELECT b AS node, sum(mass * share) AS mass FROM m0 JOIN e ON a = node GROUP BY b),
m2 AS (SELECT b AS node, sum(mass * share) AS mass FROM m1 JOIN e ON a = node GROUP BY b)
SELECT node, round(sum(mass)::DOUBLE, 6) AS mass FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2) GROUP BY node""",
    "progressive_index": CTE + "SELECT table_id, count(*) AS mentions FROM mention GROUP BY table_id",
    "hamming": CTE + "SELECT uri, CAST(len(list_filter(range(1, length(uri) + 1), lambda i: uri[i] <> reverse(uri)[i])) AS INT) AS distance FROM lake_uri",
    "remove_table": CTE + "SELECT uri, count(*) AS n FROM mention WHERE table_id <> 'customer_1.csv' GROUP BY uri",
}


# --- MinHash and hyperplane buckets ------------------------------------------------

_MIN = "min(((h * 7919 + 104729) * element_id + h * 15485863 + 1) % 2147483647)"


def _buckets(name: str, key: str, sets: str) -> str:
    """name: (key, band, bucket) of the MinHash signatures of sets (key, element_id)."""
    return f""",
{name}_h AS (SELECT {key}, h, {_MIN} AS m FROM ({sets}), range(0, 8) r(h) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {key}, h // 2 AS band, string_agg(m, '-' ORDER BY h) AS bucket FROM {name}_h GROUP BY ALL)"""


def _ids(column: str, table: str) -> str:
    """have: (uri, element) of the lake; asked_for: (uri, q_col, element_id) of the query; ids."""
    return f""",
every AS (SELECT uri, unnest({column}) AS element FROM {table}),
have AS MATERIALIZED (SELECT uri, element FROM every JOIN lake_uri USING (uri)),
ids AS MATERIALIZED (SELECT element, row_number() OVER (ORDER BY element) AS element_id FROM (SELECT DISTINCT element FROM have)),
asked_for AS MATERIALIZED (SELECT q.uri, q_col, element_id FROM q JOIN every USING (uri) JOIN ids USING (element)),
own AS MATERIALIZED (SELECT uri, element_id FROM have JOIN ids USING (element)),
held AS MATERIALIZED (SELECT DISTINCT uri, table_id FROM mention)"""


_OWN = _buckets("bk", "uri", "SELECT * FROM own") + ", tb AS MATERIALIZED (SELECT DISTINCT table_id, band, bucket FROM held JOIN bk USING (uri))"
_COLUMNS = (
    _buckets("ck", "table_id, col_idx", "SELECT DISTINCT table_id, col_idx, element_id FROM mention JOIN own USING (uri)")
    + ", tb AS MATERIALIZED (SELECT DISTINCT table_id, band, bucket FROM ck)"
)
_ENTITY_PROBES = _buckets("pk", "uri", "SELECT DISTINCT uri, element_id FROM asked_for")
_COLUMN_PROBES = _buckets("pk", "q_col", "SELECT DISTINCT q_col, element_id FROM asked_for")


def _votes(least: int) -> str:
    return f" SELECT table_id, count(DISTINCT band) AS votes FROM tb JOIN (SELECT DISTINCT band, bucket FROM pk) USING (band, bucket) GROUP BY table_id HAVING count(DISTINCT band) >= {least}"


def _column_votes(least: int) -> str:
    own = f"SELECT q_col, table_id, count(DISTINCT band) AS votes FROM tb JOIN pk USING (band, bucket) GROUP BY ALL HAVING count(DISTINCT band) >= {least}"
    return f" SELECT table_id, max(votes) AS votes FROM ({own}) GROUP BY table_id"


_PLANES = """,
planes AS MATERIALIZED (SELECT i, j, (((i * 7919 + j * 104729 + 12345) * 48271 % 2147483647) / 2147483647::DOUBLE) * 2 - 1 AS w FROM range(0, 16) a(i), range(0, 64) b(j))"""


def _signs(name: str, key: str, vectors: str) -> str:
    """name: (key, band, bucket) of vectors (key, j, x): signs of four planes a band."""
    return f""",
{name}_d AS (SELECT {key}, i, CASE WHEN sum(x * w) > 0 THEN '1' ELSE '0' END AS b FROM ({vectors}) JOIN planes USING (j) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {key}, i // 4 AS band, string_agg(b, '' ORDER BY i) AS bucket FROM {name}_d GROUP BY ALL)"""


_COMPONENTS = ", parts AS MATERIALIZED (SELECT uri, i - 1 AS j, embedding[i] AS x FROM emb, range(1, 65) r(i))"
_CENTRE = "SELECT {key}, j, avg(x) AS x FROM {rows} JOIN parts USING (uri) GROUP BY ALL"

_KINDS = "CASE split_part(table_id, '_', 1) WHEN 'customer' THEN 'customer,nation,region,segment' WHEN 'part' THEN 'part,brand,type,size' ELSE 'supplier,part,brand,nation' END"
_PERCENTILE = (
    ", found AS (SELECT type AS element, count(DISTINCT uri) AS entities FROM lake_types GROUP BY type),"
    " ranked AS (SELECT *, row_number() OVER (ORDER BY entities, element) - 1 AS place, count(*) OVER () AS n FROM found)"
)
_POSTFIX = "replace(string_split(s, '/')[-1], '_', ' ') AS text FROM kg"
_STRICT = _EUCLID.replace("sum(r) /", "sum(CASE WHEN q_row IN (SELECT q_row FROM q WHERE uri NOT IN (SELECT uri FROM lake_uri)) THEN 0 ELSE r END) /")
_TOP_LSH = CTE + _PLAIN + _ids("types", "ent_types") + _OWN + _COLUMN_PROBES + f", near_tables AS MATERIALIZED (SELECT table_id FROM ({_column_votes(4)}))"
_TOP_FIVE = _search("types").replace("LIMIT 10", "LIMIT 5")
_ALL_TABLES, _SCORED_TABLES = "(SELECT DISTINCT table_id FROM cells) LEFT", "SELECT table_id, coalesce(score, 0.0) AS score FROM"
_BM25_SUM = "round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6)"

ORACLES |= {
    "table_shape": CTE + "SELECT table_id, count(DISTINCT row_idx) FILTER (row_idx > 0) AS n_rows, count(*) FILTER (row_idx = 0) AS n_cols FROM cells GROUP BY table_id",
    "table_order": CTE + "SELECT table_id, count(DISTINCT row_idx) FILTER (row_idx > 0) AS n_rows FROM cells GROUP BY table_id ORDER BY n_rows DESC, table_id",
    "table_column": CTE + "SELECT table_id, row_idx, text FROM cells JOIN (SELECT table_id, min(col_idx) AS col_idx FROM cells"
    " WHERE row_idx = 0 AND text = 'brand' GROUP BY table_id) USING (table_id, col_idx) WHERE row_idx > 0",
    "table_labels": CTE + "SELECT table_id, col_idx, text AS label FROM cells WHERE row_idx = 0",
    "table_without_row": CTE + "SELECT table_id, CAST(CASE WHEN row_idx > 1 THEN row_idx - 1 ELSE row_idx END AS INT) AS row_idx, string_agg(text, ' | ' ORDER BY col_idx) AS line"
    " FROM cells WHERE row_idx <> 1 AND row_idx <= 3 GROUP BY table_id, row_idx",
    "table_equality": CTE + ", t AS (SELECT table_id, string_agg(text, '|' ORDER BY row_idx, col_idx) AS c FROM cells WHERE row_idx > 0 GROUP BY table_id),"
    " b AS (SELECT * FROM t UNION ALL SELECT 'copy_' || table_id, c FROM t) SELECT table_id, min(table_id) OVER (PARTITION BY c) AS same_as FROM b",
    "column_aggregate": CTE + "SELECT table_id, col_idx, round(avg(length(text)), 6) AS mean FROM cells WHERE row_idx > 0 AND text <> '' GROUP BY ALL",
    "decimal_cells": CTE + "SELECT table_id, col_idx, count(TRY_CAST(text AS DOUBLE)) AS decimals FROM cells WHERE row_idx > 0 GROUP BY ALL",
    "entity_locations": CTE + "SELECT uri, table_id, CAST(count(*) AS INT) AS n, min(row_idx) AS row_idx, arg_min(col_idx, row_idx * 100 + col_idx) AS col_idx FROM mention GROUP BY ALL",
    "linked_rows": CTE + "SELECT table_id, row_idx, string_agg(uri, ' ' ORDER BY col_idx) AS uris FROM mention GROUP BY ALL",
    "uri_prefix": CTE + "SELECT substr(uri, 4) AS name, 'lake/' || uri AS named FROM lake_uri",
    "lake_types": CTE + "SELECT DISTINCT type AS element FROM lake_types",
    "uri_functions": CTE + "SELECT replace(o, 'http:', 'https:') AS url, replace(string_split(o, '/')[-1], '_', ' ') AS text, replace(string_split(o, '/')[-1], '_', ' ') || '.old' AS name,"
    " true AS is_url, o AS plain FROM kg WHERE p = 'foaf:isPrimaryTopicOf'",
    "vector_functions": CTE + ", v AS (SELECT *, list_sum(list_transform(embedding, lambda x: abs(x))) AS total FROM emb)"
    " SELECT uri, round(sqrt(list_sum(list_transform(embedding, lambda x: 0.5::DOUBLE * (x - x * x) * (x - x * x)))), 6) AS euclid,"
    " round(list_sum(list_transform(embedding, lambda x: abs(x) / total)), 6) AS l1, round(embedding[6] * embedding[6], 6) AS square, round(log2(len(embedding)), 6) AS bits FROM v",
    "embedding_lookup": CTE + _RAGGED + _NAMES + ", f AS (SELECT uri, embedding, CASE WHEN uri LIKE 'kg:Brand%' THEN 2 ELSE 1 END AS f FROM emb JOIN asked USING (uri))"
    " SELECT uri, CAST(len(embedding) AS INT) AS dimension, round(embedding[1] * f, 6) AS first, round(embedding[64] * f, 6) AS last FROM f",
    "search_embeddings_strict": _search("norm", end=_STRICT, query=_RAGGED),
    "search_embeddings_aligned": _search("norm", vec=_ALIGNED + _COVERED + _ALIGNED_MEAN),
    "search_aligned": _search("types", vec=_ALIGNED_MAX),
    "search_aligned_mean": _search("types", vec=_ALIGNED + _ROWS + _ALIGNED_MEAN),
    "search_stats": _search("types").split("score AS (SELECT")[0].rstrip().rstrip(",") + """,
linked AS (SELECT table_id, count(DISTINCT row_idx) AS k FROM mention GROUP BY table_id),
size AS (SELECT table_id, count(DISTINCT row_idx) AS n FROM cells GROUP BY table_id),
r AS (SELECT table_id, max(r) FILTER (q_row = 0) AS r0, max(r) FILTER (q_row = 1) AS r1 FROM rel GROUP BY table_id),
v AS (SELECT table_id, max(x) FILTER (q_col = 0) AS v0, max(x) FILTER (q_col = 1) AS v1 FROM vec WHERE q_row = 1 GROUP BY table_id)
SELECT table_id, coalesce(k, 0) AS entity_mapped_rows, round(coalesce(k, 0) / n::DOUBLE, 6) AS mapped_fraction, round(coalesce(r0, 0), 6) AS score_0, round(coalesce(r1, 0), 6) AS score_1,
  round(coalesce(v0, 0), 6) AS vector_10, round(coalesce(v1, 0), 6) AS vector_11
FROM size LEFT JOIN linked USING (table_id) LEFT JOIN r USING (table_id) LEFT JOIN v USING (table_id)""",
    "comparison_counters": CTE + _RAGGED + """,
n AS (SELECT (SELECT count(*) FROM lake_uri) AS entities, (SELECT count(*) FROM lake_uri JOIN emb USING (uri)) AS embedded,
  (SELECT count(DISTINCT uri) FROM q) AS asked, (SELECT count(DISTINCT uri) FROM q JOIN emb USING (uri)) AS have)
SELECT embedded * have AS compared, entities * asked - embedded * have AS not_comparable, asked - have AS query_without_embedding,
  (SELECT count(*) FROM (SELECT DISTINCT table_id, row_idx FROM mention)) AS linked_rows FROM n""",
    "embedding_coverage": CTE + _PLAIN + _SIMS["norm"] + _SCORED + _ALIGNED + _COVERED + " SELECT table_id, q_row, k AS rows FROM counts",
    "prefiltered_lsh_search": (_TOP_LSH + _SIMS["types"] + _SCORED + _MAX + _EUCLID).replace(_ALL_TABLES, "near_tables LEFT").replace(
        "coalesce(score, 0.0) AS score FROM",
        "coalesce(score, 0.0) AS score, round(1 - (SELECT count(*) FROM near_tables) / (SELECT count(DISTINCT table_id)::DOUBLE FROM cells), 6) AS reduction FROM"),
    "minhash_candidates": CTE + _PLAIN + _ids("types", "ent_types") + _OWN + _ENTITY_PROBES + _votes(2),
    "minhash_predicates": CTE + _PLAIN + _ids("predicates", "ent_preds") + _OWN + _ENTITY_PROBES + _votes(3),
    "minhash_aggregated": CTE + _PLAIN + _ids("types", "ent_types") + _OWN + _COLUMN_PROBES + _column_votes(2),
    "minhash_columns": CTE + _PLAIN + _ids("types", "ent_types") + _COLUMNS + _ENTITY_PROBES + _votes(1),
    "projection_candidates": CTE + _PLAIN + _PLANES + _COMPONENTS + _signs("bk", "uri", "SELECT parts.* FROM parts JOIN lake_uri USING (uri)")
    + ", tb AS (SELECT DISTINCT table_id, band, bucket FROM mention JOIN bk USING (uri))"
    + _signs("pk", "uri", "SELECT parts.* FROM parts JOIN (SELECT DISTINCT uri FROM q) USING (uri)") + _votes(2),
    "projection_aggregated": CTE + _PLAIN + _PLANES + _COMPONENTS + _signs("bk", "table_id, col_idx", _CENTRE.format(key="table_id, col_idx", rows="mention"))
    + ", tb AS (SELECT DISTINCT table_id, band, bucket FROM bk)" + _signs("pk", "q_col", _CENTRE.format(key="q_col", rows="q")) + _column_votes(1),
    "element_popularity_percentile": CTE + _PERCENTILE + " SELECT element, entities FROM ranked WHERE place >= floor(0.75 * n)",
    "element_shingles": CTE + "SELECT a.type || '|' || b.type AS element, count(*) AS entities FROM lake_types a JOIN lake_types b ON a.uri = b.uri AND a.type < b.type GROUP BY ALL",
    "rare_elements": CTE + _PERCENTILE + " SELECT uri, string_agg(type, ',' ORDER BY type) AS elements FROM lake_types"
    " WHERE type NOT IN (SELECT element FROM ranked WHERE place >= floor(0.9 * n)) GROUP BY uri",
    "bm25_postfix": CTE + "," + _bm25(f"SELECT DISTINCT s AS id, {_POSTFIX}", "brand 23 china"),
    "bm25_per_triple": CTE + "," + _bm25(f"SELECT row_number() OVER () AS id, {_POSTFIX}", "brand 23 china").split("SELECT id, round(")[0]
    + f"SELECT score, count(*) AS n FROM (SELECT id, {_BM25_SUM} AS score FROM tf JOIN df USING (term), st GROUP BY id) GROUP BY score",
    "link_mentions": CTE + """,
d AS (SELECT s AS id, o AS text FROM kg WHERE p = 'rdfs:label'),
tok AS MATERIALIZED (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM d),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
tf AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS MATERIALIZED (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS part FROM tf JOIN df USING (term), st),
texts AS (SELECT DISTINCT text FROM cells),
words AS (SELECT DISTINCT text, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM texts),
hit AS (SELECT text, id, round(sum(part), 6) AS score FROM words JOIN part USING (term) GROUP BY ALL),
best AS (SELECT text, id AS uri FROM hit QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, id) = 1)
SELECT text, coalesce(uri, 'None') AS uri FROM texts LEFT JOIN best USING (text)""",
    "entities_per_row": CTE + "SELECT c.table_id, c.row_idx, count(m.uri) AS entities FROM cells c"
    " LEFT JOIN mention m ON m.table_id = c.table_id AND m.row_idx = c.row_idx AND m.col_idx = c.col_idx GROUP BY ALL",
    "kg_wiki_links": CTE + "SELECT replace(o, 'http:', 'https:') AS link, s AS uri FROM kg WHERE p = 'foaf:isPrimaryTopicOf'",
    "kg_neighbourhood": CTE + _RAGGED + _NAMES + " SELECT e.s AS uri, e.p, e.o, l.o AS label FROM kg e JOIN asked ON e.s = asked.uri"
    " LEFT JOIN kg l ON l.s = e.o AND l.p = 'rdfs:label' WHERE e.o_kind = 'iri'",
    "kg_export": CTE + "SELECT 'MERGE (a:Resource {uri: ''' || s || '''}) ' || CASE WHEN o_kind = 'iri' THEN 'MERGE (b:Resource {uri: ''' || o || '''}) MERGE (a)-[:`' || p || '`]->(b);'"
    " ELSE 'SET a.`' || p || '` = ''' || o || ''';' END AS line FROM kg",
    "pagerank_top": CTE + _PLAIN + """,
e AS (SELECT s AS a, o AS b, 0.85 / count(*) OVER (PARTITION BY s) AS share FROM kg WHERE o_kind = 'iri' AND p <> 'rdf:type'),
m0 AS (SELECT uri AS node, 250.0::DOUBLE AS mass FROM q),
m1 AS (SELECT b AS node, sum(mass * share) AS mass FROM m0 JOIN e ON a = node GROUP BY b),
m2 AS (SELECT b AS node, sum(mass * share) AS mass FROM m1 JOIN e ON a = node WHERE mass >= 5 GROUP BY b)
SELECT node, round(sum(mass)::DOUBLE, 6) AS mass FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2)
WHERE node IN (SELECT s FROM kg WHERE p = 'rdf:type' AND o = 'Part') GROUP BY node ORDER BY round(sum(mass)::DOUBLE, 9) DESC, node LIMIT 5""",
    "result_json": _TOP_FIVE.replace(
        _SCORED_TABLES, f"""SELECT CAST(row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, table_id) - 1 AS INT) AS rank, table_id,
coalesce(score, 0.0) AS score, {_KINDS} AS headers, CAST(n AS INT) AS n_rows FROM""").replace(
        _ALL_TABLES, "(SELECT table_id, count(DISTINCT row_idx) AS n FROM cells GROUP BY table_id) LEFT"),
    "result_within_bytes": "SELECT table_id, score FROM (SELECT *, sum(bytes) OVER (ORDER BY score DESC, table_id) AS until FROM ("
    + _search("types").replace(_SCORED_TABLES, "SELECT table_id, coalesce(score, 0.0) AS score, bytes FROM").replace(
        _ALL_TABLES, "(SELECT table_id, sum(strlen(text)) AS bytes FROM cells GROUP BY table_id) LEFT") + ")) WHERE until <= 60000",
}
