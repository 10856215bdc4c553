"""Units with hand-computed values, and every query against its SQL."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import similarity as sim
from tarnlake.engine import Config, Engine, parse_query
from tarnlake.operators import graph, keyword, linking, prefilter, search, stats, tables
from tarnlake.plans.registry import ORACLES, QUERIES
from tarnlake.sources import readers
from tarnlake.sources.store import EmbeddingStore, LakeStore, UsageLog
from tarnlake.streaming.progressive import Event, PriorityScheduler, ProgressiveIndex, index_stream

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*x):
    return F.array(*[F.lit(v) for v in x])


@pytest.mark.parametrize("a,b,want", [((1, 2, 3), (3, 2, 1), 0.7142857), ((1, 2, 3), (3, 3, 3), 0.9258201), ((0, 0, 0), (1, 2, 3), 0.0)])
def test_cosine(spark, a, b, want):
    assert value(spark, sim.cosine(array(*a), array(*b))) == pytest.approx(want)


def test_vectors_of_other_dimension_are_an_error(spark):
    with pytest.raises(Exception, match="dimension"):
        value(spark, sim.cosine(array(1, 2), array(1, 2, 3)))


def test_set_similarities(spark):
    assert value(spark, sim.jaccard(array("P", "Q"), array("P"))) == 0.5
    assert value(spark, sim.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert value(spark, sim.capped(sim.jaccard(array("P"), array("P")))) == 0.95
    w = F.create_map(F.lit("P"), F.lit(3.0), F.lit("Q"), F.lit(1.0))
    assert value(spark, sim.weighted_jaccard(array("P", "Q", "R"), array("P", "R"), w)) == 0.75


def test_small_functions(spark):
    assert value(spark, sim.hamming(array(1, 2, 3), array(1, 0, 3))) == 1
    assert value(spark, sim.weighted_euclid(array(1.0, 2.0), array(0.0, 0.0), array(0.5, 0.5))) == pytest.approx(math.sqrt(2.5))
    assert value(spark, sim.l1_normalise(array(1, 3))) == [0.25, 0.75]
    assert value(spark, sim.uri_text(F.lit("http://x/a_b"))) == "a b"
    assert value(spark, sim.without_extension(F.lit("a.b.csv"))) == "a.b"
    assert value(spark, sim.is_decimal(F.lit("1.5e3"))) and not value(spark, sim.is_decimal(F.lit("x")))


def test_hungarian_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.random((n, m))
        cols = search.hungarian(cost)
        used = [c for c in cols if c >= 0]
        assert len(set(used)) == len(used) == min(n, m)
        assert sum(cost[i, c] for i, c in enumerate(cols) if c >= 0) == pytest.approx(search.best_by_enumeration(cost))


def test_first_mapping_wins(spark):
    pairs = spark.createDataFrame([(0, "a", "u"), (1, "a", "v"), (2, "b", "u"), (3, "b", "w")], "seq int, text string, uri string")
    by_text, by_uri = linking.first_mappings(pairs)
    assert {r.text: r.uri for r in by_text.collect()} == {"a": "u", "b": "u"}
    assert {r.uri: r.text for r in by_uri.collect()} == {"u": "a", "v": "a", "w": "b"}


def test_csv_lake_is_ragged_and_keeps_the_header(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "t3.csv").write_text('x,y\nAnn\nBob,"A,jax",extra\n')
    (tmp_path / "no.txt").write_text("a")
    rows = sorted((r.row_idx, r.col_idx, r.text) for r in readers.read_csv_lake(spark, str(tmp_path)).collect())
    assert rows == [(0, 0, "x"), (0, 1, "y"), (1, 0, "Ann"), (2, 0, "Bob"), (2, 1, "A,jax"), (2, 2, "extra")]


def test_embeddings_and_triples(spark, tmp_path):
    (tmp_path / "e.txt").write_text("http://a 1 2.5\nodd x://b 3 -4\nno uri\n")
    got = {r.uri: r.embedding for r in readers.read_embeddings(spark, str(tmp_path / "e.txt")).collect()}
    assert got == {"http://a": [1.0, 2.5], "odd x://b": [3.0, -4.0]}
    (tmp_path / "t.nt").write_text('<s> <p> <o> .\n<s> <p> "two words"@en .\n<s> <p> <o> .\nbroken\n')
    got = sorted((r.o, r.o_kind) for r in readers.read_triples(spark, str(tmp_path / "t.nt")).collect())
    assert got == [("o", "iri"), ("two words", "literal")]


def test_store(spark, tmp_path):
    store = LakeStore(spark, str(tmp_path / "lake"))
    a, b = readers.matrix_cells(spark, "a.csv", [["x"], ["y", "z"]]), readers.matrix_cells(spark, "b.csv", [["x"]])
    assert store.count() == 0 and store.cells().count() == 0 and not store.remove("a.csv")
    assert store.insert(a) == [] and store.insert(b) == []
    assert store.cells().count() == 4 and store.count() == 2
    assert store.insert(a.unionByName(readers.matrix_cells(spark, "c.csv", [["q"]]))) == ["a.csv"]  # refused, the other one is stored
    assert store.cells().count() == 5
    assert store.remove("a.csv") and not store.remove("a.csv")
    assert sorted(r.table_id for r in store.names().collect()) == ["b.csv", "c.csv"]
    assert store.insert(a) == [] and store.table("a.csv").count() == 3  # a removed name may come again
    assert [r.table_id for r in store.names(F.col("table_id").startswith("b")).collect()] == ["b.csv"]
    store.clear()
    assert store.count() == 0 and store.insert(a) == []


def test_embedding_store(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "e"))
    assert store.get("u://a") is None and store.dimension() == 0
    (tmp_path / "e.txt").write_text("u://a 1 2\nu://b 3 4\n")
    store.load(str(tmp_path / "e.txt"))
    store.insert(spark.createDataFrame([("u://a", [5.0, 6.0])], "uri string, embedding array<double>"))
    assert store.get("u://a") == [5.0, 6.0] and store.get("u://b") == [3.0, 4.0] and store.dimension() == 2
    many = store.get_many(spark.createDataFrame([("u://a",), ("u://a",), ("u://z",)], "uri string"))
    assert [(r.uri, r.embedding) for r in many.collect()] == [("u://a", [5.0, 6.0])]
    store.clear()
    assert store.all().count() == 0
    (tmp_path / "bad.txt").write_text("u://a 1 two\n")
    with pytest.raises(Exception, match="neither an entity nor a decimal"):
        readers.read_embeddings(spark, str(tmp_path / "bad.txt")).collect()


def test_usage_log(spark, tmp_path):
    log = UsageLog(spark, str(tmp_path / "u"))
    log.record("search")
    log.record("search")
    log.record("insert")
    assert sorted((r.endpoint, r.uses) for r in stats.usage(log.read()).collect()) == [("insert", 1), ("search", 2)]


def test_tables(spark):
    t = readers.matrix_cells(spark, "t", [["H1", "H2"], ["a", "b", "c"], ["d"], ["e", "f"]])
    assert [r.text for r in tables.row(t, 1).orderBy("col_idx").collect()] == ["a", "b", "c"]
    assert [r.text for r in tables.column(t, 1).orderBy("row_idx").collect()] == ["H2", "b", "f"]  # ragged rows are skipped
    assert [r.text for r in tables.column_named(t, "H1").orderBy("row_idx").collect()] == ["a", "d", "e"]
    assert tuple(tables.shape(t).first())[1:] == (3, 2)
    assert [r.line for r in tables.as_lines(tables.without_row(t, 2)).orderBy("row_idx").collect()] == ["H1 | H2", "a | b | c", "e | f"]
    u = readers.matrix_cells(spark, "u", [["other", "labels"], ["a", "b", "c"], ["d"], ["e", "f"]])
    v = readers.matrix_cells(spark, "v", [["H1", "H2"], ["a", "b", "c"], ["d"], ["e", "g"]])
    assert tables.same_table(t, u) and not tables.same_table(t, v)
    same = {r.table_id: r.same_as for r in tables.equal_tables(t.unionByName(u).unionByName(v)).collect()}
    assert same == {"t": "t", "u": "t", "v": "v"}
    length = tables.aggregate_column(t, F.when(F.col("text") != "d", F.char_length("text")), F.sum)
    assert sorted((r.col_idx, r.value) for r in length.collect()) == [(0, 2), (1, 2), (2, 1)]


def test_prefixes(spark):
    strip = lambda x: value(spark, tables.strip_prefix(F.lit(x), "kg:"))
    assert strip("kg:a") == "a" and value(spark, tables.add_prefix(F.lit("a"), "kg:")) == "kg:a"
    with pytest.raises(Exception, match="no prefix kg:"):
        strip("a")


def test_result_document_round_trip(spark):
    cells = readers.matrix_cells(spark, "a", [["h", "i"], ["x", "y"], ["z"]]).unionByName(readers.matrix_cells(spark, "b", [["k"], ["w"]]))
    scores = spark.createDataFrame([("b", 0.25), ("a", 0.5)], "table_id string, score double")
    document = readers.result_json(scores, cells, runtime=7, reduction=0.5, message="part")
    raw = document.first()["json"]
    assert '"runtime":7' in raw and '"message":"part"' in raw
    got = [(r["rank"], r.table_id, r.score, r.headers, r.n_rows) for r in readers.from_result_json(document).collect()]
    assert got == [(0, "a", 0.5, ["h", "i"], 3), (1, "b", 0.25, ["k"], 2)]
    assert sorted(map(tuple, readers.result_cells(document).collect())) == sorted(map(tuple, cells.collect()))
    assert "message" not in readers.result_json(scores, cells).first()["json"]
    sizes = readers.table_bytes(cells)
    assert [r.table_id for r in readers.within_bytes(scores, sizes, 5).collect()] == ["a"]


def test_queries_as_text_and_json(spark, tmp_path):
    assert parse_query("a<>b#c") == (("a", "b"), ("c",)) and parse_query([["a", ""], []]) == (("a",),) and parse_query("##") == ()
    (tmp_path / "q.json").write_text('{"queries": [["a", "b"], ["c"]]}')
    assert sorted(map(tuple, readers.read_query_json(spark, str(tmp_path / "q.json")).collect())) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    assert value(spark, readers.format_query(F.array(array("a", "b"), array("c")))) == "a<>b#c"


def test_import_and_export_of_graphs(spark, tmp_path):
    (tmp_path / "in.nt").write_text('<http://a> <p> <http://b> .\n<http://a> <p> "tëxt" .\n<http://xn--b1aew.x> <p> <http://b> .\n<local> <p> <http://c> .\n')
    assert sorted(tuple(r) for r in readers.read_screened_triples(spark, str(tmp_path / "in.nt")).select("s", "o").collect()) == [("http://a", "http://b"), ("http://a", "txt")]
    kg = readers.read_triples(spark, str(tmp_path / "in.nt"))
    readers.write_triples(kg, str(tmp_path / "out"))
    assert sorted(map(tuple, readers.read_triples(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, kg.collect()))
    lines = sorted(r.line for r in readers.cypher_lines(kg).collect())
    assert lines[0] == "MERGE (a:Resource {uri: 'http://a'}) MERGE (b:Resource {uri: 'http://b'}) MERGE (a)-[:`p`]->(b);"


def test_exists_falls_back_to_same_as(spark):
    kg = spark.createDataFrame([("a", "p", "b", "iri"), ("c", "owl:sameAs", "z", "iri")], "s string, p string, o string, o_kind string")
    uris = spark.createDataFrame([("a",), ("z",), ("q",)], "uri string")
    assert {r.uri: r.entity for r in graph.exists(uris, kg).collect()} == {"a": "a", "z": "c", "q": None}


def test_scheduler():
    s = PriorityScheduler()
    s.add("a", 2, 1.0)
    s.add("b", 4, 2.0)
    s.add("c", 1)
    assert s.max_priority() == 2.0
    order = []
    while (t := s.pop_row()) is not None:
        order.append(t)
    assert order[0] == "b" and sorted(order) == ["a", "a", "b", "b", "b", "b", "c"]


def test_scheduler_boost_and_new_tables():
    s = PriorityScheduler()
    for t in "abc":
        s.add(t, 3)
    s.boost({"c": 0.5, "unknown": 1.0})
    assert s.max_priority() == 1.5 and s.pop(2) == ("c", 0, 2)
    s.update("b", 9.0)
    s.add("d", 5)  # comes at the maximum
    assert s.items["d"].priority == 9.0 and s.pop() == ("b", 0, 1)
    left = []
    while (x := s.pop(2)) is not None:
        left.append(x)
    assert sorted(left) == [("a", 0, 2), ("a", 2, 3), ("b", 1, 3), ("c", 2, 3), ("d", 0, 2), ("d", 2, 4), ("d", 4, 5)]


def mentions_of(df):
    return sorted(map(tuple, df.select("uri", "table_id", "row_idx", "col_idx").collect()))


def test_progressive_index_follows_the_scheduler(spark, tmp_path):
    link = spark.createDataFrame([("x", "u:x"), ("y", "u:y")], "text string, uri string")
    cells = readers.matrix_cells(spark, "a", [["x"]] * 4).unionByName(readers.matrix_cells(spark, "b", [["y"]] * 6))
    told = []
    index = ProgressiveIndex(spark, link, str(tmp_path / "out"), listener=lambda e, what: told.append(e))
    assert index.mentions().count() == 0
    index.add_tables(cells)
    index.step(1)
    assert mentions_of(index.mentions()) == [("u:x", "a", 0, 0)]
    index.boost({"b": 1.0})
    index.step(2)
    assert mentions_of(index.mentions()) == [("u:x", "a", 0, 0), ("u:y", "b", 0, 0), ("u:y", "b", 1, 0)] or not index.done
    again = ProgressiveIndex(spark, link, str(tmp_path / "out"))  # a new driver goes on
    again.add_tables(cells)
    assert sum(i.remaining for i in again.scheduler.items.values()) == 7
    again.run_for(0.0, 1)
    assert mentions_of(again.finish(3)) == mentions_of(linking.mentions(cells, link)) and again.done
    assert {Event.INSERTION, Event.INDEX, Event.SEARCH} <= set(told)


def test_streamed_index_equals_batch_index(spark, tmp_path):
    cells = readers.matrix_cells(spark, "a.csv", [["x", "y"], ["y", "n"]]).unionByName(readers.matrix_cells(spark, "b.csv", [["x"]] * 3))
    for t in ("a.csv", "b.csv"):
        cells.where(F.col("table_id") == t).write.mode("append").parquet(str(tmp_path / "in"))
    link = spark.createDataFrame([("x", "u:x"), ("y", "u:y")], "text string, uri string")
    index = ProgressiveIndex(spark, link, str(tmp_path / "out"))
    seen = []
    after = lambda batch: (seen.append(index.mentions().count()), index.boost({"b.csv": 1.0}))
    index_stream(spark, str(tmp_path / "in"), cells.schema, index, str(tmp_path / "cp"), pops=1, after=after).awaitTermination()
    assert seen and seen[0] < cells.count()
    assert mentions_of(index.finish(2)) == mentions_of(linking.mentions(cells, link))


def test_split_votes(spark):
    c = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "split int, table_id string")
    assert [r.table_id for r in prefilter.voted(c, 3).collect()] == ["a"]
    one = c.where("split = 2")
    assert prefilter.voted(one, 3).count() == 0  # split, and found by one part only
    assert prefilter.voted(one, 1).count() == 1
    rows = tuple((str(i),) for i in range(8))
    assert [len(p) for p in prefilter.split_rows(rows)] == [3, 3, 2] and prefilter.split_rows(rows[:7]) == [rows[:7]]


def test_assignment_prefers_low_columns():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 7))
        score = rng.integers(0, 4, (n, m)).astype(float)
        got = search.assign(score)
        assert sum(score[i, c] for i, c in enumerate(got) if c >= 0) == -search.best_by_enumeration(-score)
        assert len({c for c in got if c >= 0}) == min(n, m)
    assert search.assign(np.zeros((3, 4))) == [0, 1, 2]


def test_shingles_and_percentiles(spark):
    e = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "c"), ("v", "a"), ("w", "a"), ("w", "b")], "uri string, element string")
    assert sorted(r.element for r in prefilter.shingles(e.where("uri = 'u'"), ["uri"], 2).collect()) == ["a|b", "a|c", "b|c"]
    assert sorted(r.element for r in prefilter.shingles(e.where("uri = 'u'"), ["uri"], 3).collect()) == ["a|b|c"]
    assert {r.element: r.entities for r in prefilter.popular_by_percentile(e, 0.5).collect()} == {"a": 3, "b": 2}
    assert prefilter.popular_by_percentile(e, 0.0).count() == 3 and prefilter.popular_by_percentile(e, 1.0).count() == 0
    left = prefilter.without(e, prefilter.popular_by_percentile(e, 0.9))
    assert sorted(map(tuple, left.collect())) == [("u", "b"), ("u", "c"), ("w", "b")]
    with pytest.raises(ValueError):
        prefilter.popular_by_percentile(e, 1.5)


def test_bm25_prefers_the_rarer_word(spark):
    d = spark.createDataFrame([(1, "red apple"), (2, "red car"), (3, "red")], "id int, text string")
    assert keyword.top_hits(keyword.bm25(d, "red apple"), 1).first()["id"] == 1
    assert keyword.bm25(d, "nothing here").count() == 0


def test_linking_by_the_rarest_word_first_is_exact(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    pick = lambda n: " ".join(words[int(x)] for x in np.minimum(rng.geometric(0.12, n) - 1, 29))
    entities = spark.createDataFrame([(f"e{i:03d}", pick(int(rng.integers(1, 6)))) for i in range(150)], "id string, text string")
    texts = spark.createDataFrame([(pick(int(rng.integers(1, 6))),) for _ in range(200)] + [("unknown words",), ("",)], "text string")
    got = {r.text: r.uri for r in keyword.link_mentions(texts, entities).collect()}
    asked = texts.select("text").distinct().select(F.col("text").alias("q"), F.explode(F.array_distinct(keyword.tokens(F.col("text")))).alias("term"))
    want = {}
    for r in keyword.bm25_join(entities, asked).collect():
        want[r.q] = min(want.get(r.q, (9, "")), (-r.score, r.id))
    assert got == {t: want[t][1] if t in want else "None" for t in got} and len(got) > 100


def test_engine_from_files(spark, tmp_path):
    (tmp_path / "csv" / "deep").mkdir(parents=True)
    (tmp_path / "csv" / "cities.csv").write_text("city,country\nParis,France\nRome,Italy\n")
    (tmp_path / "csv" / "deep" / "people.csv").write_text("name,home\nAnn,Paris\nBob,Oslo\nEve\n")
    (tmp_path / "csv" / "empty.csv").write_text("nothing,here\n1,2\n")
    rdf, label = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#label"
    kinds = {"Paris": "City", "Rome": "City", "Oslo": "City", "France": "Country", "Italy": "Country", "Ann": "Person", "Bob": "Person"}
    lines = [f"<http://x/{n}> <{rdf}> <http://t/{k}> ." for n, k in kinds.items()] + [f'<http://x/{n}> <{label}> "{n}" .' for n in kinds]
    (tmp_path / "kg.nt").write_text("\n".join(lines + ["<http://x/Paris> <http://p/in> <http://x/France> ."]))
    (tmp_path / "vec.txt").write_text("\n".join(f"http://x/{n} {i} {i * i} 1" for i, n in enumerate(kinds)))
    lake = Engine(spark, f"file://{tmp_path}/lake", Config(neighbours=2))
    with pytest.raises(ValueError, match="embeddings before"):
        lake.ingest(str(tmp_path / "csv"))
    lake.load_graph(str(tmp_path / "kg.nt"))
    lake.load_graph(str(tmp_path / "kg.nt"))  # a graph takes nothing twice
    assert lake.kg.triples.count() == 15
    lake.load_embeddings(str(tmp_path / "vec.txt"))
    with pytest.raises(ValueError, match="nothing is indexed"):
        lake.search("http://x/Paris")
    assert lake.ingest(str(tmp_path / "csv")) == []
    assert lake.count("http://x/Paris") == 2 and lake.count("http://x/none") == 0
    q = "http://x/Oslo<>http://x/France"
    found = lake.search(q, with_stats=True).tables.collect()
    assert found[0].table_id == "cities.csv" and found[-1].table_id == "empty.csv" and found[-1].score == 0.0
    assert found[0].entity_mapped_rows == 2 and len(found[0].row_vectors[0]) == 2
    # By hand: Oslo and France have a type each, shared by a column each: 0.95 in both cells.
    assert found[0].score == pytest.approx(1 / (1 + 0.05), abs=1e-6)
    for similarity in ("TYPES", "PREDICATES", "EMBEDDINGS", "EMBEDDINGS_ABS", "COSINE_ANG", "JACCARD_TYPES"):
        for more in ({}, {"aligned": False, "maximum": False}, {"measure": "COSINE", "prefilter": "HNSW"}, {"weighted": True, "same_alignment": True}):
            rows = lake.search(q, 2, similarity, **more).tables.collect()
            assert all(0 <= r.score <= 1 for r in rows) and rows == sorted(rows, key=lambda r: (-r.score, r.table_id))
    for method in ("LSH_TYPES", "LSH_PREDICATES", "LSH_EMBEDDINGS", "HNSW"):
        result = lake.search(q, prefilter=method)
        assert 0 <= result.reduction <= 1 and result.tables.count() <= 3
    raw = lake.search(q, 1).json(lake.store.cells()).first()["json"]
    assert '"table ID":"cities.csv"' in raw and '"headers":["city","country"]' in raw
    for bad in ({"similarity": "NONE"}, {"k": 0}, {"prefilter": "X"}, {"measure": "X"}, {"cosine": "X"}):
        with pytest.raises(ValueError):
            lake.search(q, **bad)
    with pytest.raises(ValueError):
        lake.search("##")
    assert lake.keyword_search("oslo").first()["id"] == "http://x/Oslo"
    assert lake.stats().first().asDict()["tables"] == 3 and lake.table_stats("people.csv").first()["entities"] == 4
    assert {r.text: r.uri for r in lake.link_table("people.csv").collect()}["Bob"] == "http://x/Bob"
    assert lake.ingest(str(tmp_path / "csv")) == ["cities.csv", "empty.csv", "people.csv"]
    assert lake.remove_table("people.csv") and not lake.remove_table("people.csv")
    assert lake.count("http://x/Paris") == 1 and lake.search(q).tables.count() == 2
    overlap = lambda e, p: p.groupBy("table_id").agg(F.count_distinct("uri").cast("double").alias("score"))
    assert lake.rank(overlap, 1).first()["table_id"] == "cities.csv"
    assert lake.similar_entities(sim.jaccard, "http://x/Rome").where("sim = 1.0").count() == 2
    lake.clear()
    assert lake.store.count() == 0
    lake.clear_embeddings()
    assert lake.embeddings.dimension() == 0


def test_engine_prefixes(spark, tmp_path):
    lake = Engine(spark, f"file://{tmp_path}/lake")
    kg = [(f"kg:{n}", "rdfs:label", n, "literal") for n in "ab"] + [("other:a", "rdfs:label", "a", "literal"), ("kg:a", "rdf:type", "T", "iri")]
    lake.add_triples(spark.createDataFrame(kg, "s string, p string, o string, o_kind string"))
    lake.embeddings.insert(spark.createDataFrame([("kg:a", [1.0])], "uri string, embedding array<double>"))
    cells = readers.matrix_cells(spark, "t", [["h"], ["wiki/a"], ["a"], ["wiki/b"]])
    lake.ingest_cells(cells, "wiki/", "kg:")
    assert sorted(map(tuple, lake.snapshot.link.collect())) == [("wiki/a", "kg:a"), ("wiki/b", "kg:b")]
    wrong = spark.createDataFrame([("a", "kg:a")], "text string, uri string")
    with pytest.raises(Exception, match="no prefix wiki/"):
        lake.ingest_cells(readers.matrix_cells(spark, "u", [["a"]]), "wiki/", "kg:", link=wrong)


def test_command_line(spark, tmp_path):
    import json

    from tarnlake.__main__ import main

    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "t.csv").write_text("h\nAnn\nBob\n")
    (tmp_path / "kg.nt").write_text("".join(f"<x://{n}> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <t> .\n" for n in ("Ann", "Bob")))
    (tmp_path / "v.txt").write_text("x://Ann,1,2\n")
    run = lambda *a: json.loads(main(["--root", f"file://{tmp_path}/lake", *a], spark))
    assert run("embeddings", str(tmp_path / "v.txt"), "--delimiter", ",") == {} and run("graph", str(tmp_path / "kg.nt")) == {}
    assert run("insert", str(tmp_path / "csv")) == {"refused": []}
    assert run("search", "x://Ann", "-k", "1")["scores"][0]["table ID"] == "t.csv"
    assert run("count", "x://Bob") == {"tables": 1} and run("keyword", "bob")[0]["id"] == "x://Bob"
    assert run("stats")[0]["linked_cells"] == 2 and run("table-stats", "t.csv")[0]["entities"] == 2
    assert run("remove-table", "t.csv") == {"removed": True} and run("clear-embeddings") == {} and run("clear") == {}


def test_profiles_and_sketches(spark, tmp_path):
    cells = readers.matrix_cells(spark, "a", [["h"], ["x"], ["y"], ["x"]])
    mention = linking.mentions(cells, spark.createDataFrame([("x", "u:x")], "text string, uri string"))
    stats.write_profiles(stats.table_profile(cells, mention), str(tmp_path / "p"))
    got = spark.read.json(str(tmp_path / "p")).first()
    assert (got.n_rows, got.entities, got.mapped_cells, got.per_column) == (4, 1, 2, "0:2")
    assert {r.row_idx: r.entities for r in stats.entities_per_row(cells, mention).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    many = spark.range(20_000).select(F.concat(F.lit("u"), F.col("id") % 5000).alias("uri"))
    assert abs(stats.approximate_entities(many).first().entities - 5000) < 250


def test_engine_progressive(spark, tmp_path):
    lake = Engine(spark, f"file://{tmp_path}/lake")
    kg = [("u:a", "rdf:type", "T", "iri"), ("u:b", "rdf:type", "T", "iri"), ("u:a", "rdfs:label", "a", "literal"), ("u:b", "rdfs:label", "b", "literal")]
    lake.add_triples(spark.createDataFrame(kg, "s string, p string, o string, o_kind string"))
    lake.embeddings.insert(spark.createDataFrame([("u:a", [1.0])], "uri string, embedding array<double>"))
    cells = readers.matrix_cells(spark, "t1", [["a"]] * 3).unionByName(readers.matrix_cells(spark, "t2", [["b"]] * 3))
    lake.ingest_cells(cells, progressive=True)
    assert lake.search([["u:a"]], 1).tables.first().score == 0.0  # nothing indexed yet
    lake.progressive.step(2)
    assert lake.search([["u:a"]], 1, query_time=0.01).tables.first().score > 0.5
    assert max(i.priority for i in lake.progressive.scheduler.items.values()) > 1 if lake.progressive.scheduler.items else True
    snapshot = lake.finish()
    assert mentions_of(snapshot.mention) == mentions_of(linking.mentions(cells, spark.createDataFrame([("a", "u:a"), ("b", "u:b")], "text string, uri string")))


def run_sql(sql):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c.execute(sql).df()


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v != v else v for v in r) for r in df.astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = run_sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
