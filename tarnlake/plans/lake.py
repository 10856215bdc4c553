"""The lake of cells, the graph and the embeddings derived from the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

THING = "http://www.w3.org/2002/07/owl#Thing"
TYPE, LABEL = "rdf:type", "rdfs:label"
WIKI = "http://en.wikipedia.org/wiki/"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def uri(col: Column | str) -> Column:
    return F.concat(F.lit("kg:"), F.replace(col, F.lit(" "), F.lit("_")))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """(table_id, row_idx, cells): data rows from 1 in table order, headers at 0."""
    t = lambda n: table(spark, sf, n)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    number = lambda *by: F.row_number().over(Window.partitionBy("table_id").orderBy(*by))
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("table_id", F.format_string("customer_%d.csv", "n_nationkey"))
    customer = customer.select("table_id", number("c_custkey").alias("row_idx"), F.array("c_name", "n_name", "r_name", "c_mktsegment").alias("cells"))
    part = t("part").withColumn("table_id", F.concat(F.lit("part_"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".csv")))
    part = part.select("table_id", number("p_partkey").alias("row_idx"), F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("cells"))
    supply = (
        t("lineitem").select("l_suppkey", "l_partkey").distinct()
        .join(t("part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.format_string("supply_%d.csv", "s_suppkey").alias("table_id"), "s_name", "p_name", "p_brand", "n_name").distinct()
    )
    supply = supply.select("table_id", number("p_name", "p_brand").alias("row_idx"), F.array("s_name", "p_name", "p_brand", "n_name").alias("cells"))
    data = customer.unionByName(part).unionByName(supply)
    kind = F.split("table_id", "_")[0]
    words = {"customer": "customer,nation,region,segment", "part": "part,brand,type,size", "supply": "supplier,part,brand,nation"}
    head = F.create_map(*[F.lit(x) for k, v in words.items() for x in (k, v)])
    heads = data.select("table_id").distinct().select("table_id", F.lit(0).alias("row_idx"), F.split(head[kind], ",").alias("cells"))
    return data.unionByName(heads)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """lake_cell (table_id, row_idx, col_idx, text)."""
    return rows(spark, sf).select("table_id", "row_idx", F.posexplode("cells").alias("col_idx", "text"))


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """kg_triple (s, p, o, o_kind)."""
    t = lambda n: table(spark, sf, n)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = t("part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplies = t("lineitem").select("l_suppkey", "l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    typed = [
        (customer.select(F.col("c_name").alias("x"), F.array(F.lit("Agent"), F.lit("Customer"), F.concat(F.lit("Segment_"), "c_mktsegment")).alias("y"))),
        (t("supplier").select(F.col("s_name").alias("x"), F.array(F.lit("Agent"), F.lit("Supplier")).alias("y"))),
        (nation.select(F.col("n_name").alias("x"), F.array(F.lit("Place"), F.lit("Nation")).alias("y"))),
        (t("region").select(F.col("r_name").alias("x"), F.array(F.lit("Place"), F.lit("Region")).alias("y"))),
        (part.select(F.col("p_name").alias("x"), F.array(F.lit("Product"), F.lit("Part"), F.concat(F.lit("PType_"), "p_type")).alias("y"))),
        (part.select(F.col("p_brand").alias("x"), F.array(F.lit("Brand")).alias("y"))),
        (part.select(F.col("p_type").alias("x"), F.array(F.lit("Category")).alias("y"))),
        (customer.select(F.col("c_mktsegment").alias("x"), F.array(F.lit("Category")).alias("y"))),
    ]
    types = typed[0]
    for more in typed[1:]:
        types = types.unionByName(more)
    types = types.distinct().select("x", F.explode(F.concat(F.array(F.lit(THING)), "y")).alias("y")).select("x", F.lit(TYPE).alias("p"), "y")
    edge = lambda df, a, p, b: df.select(F.col(a).alias("x"), F.lit(p).alias("p"), F.col(b).alias("y"))
    edges = edge(customer, "c_name", "locatedIn", "n_name")
    for more in (
        edge(customer, "c_name", "inSegment", "c_mktsegment"), edge(supplier, "s_name", "locatedIn", "n_name"), edge(supplies, "s_name", "supplies", "p_name"),
        edge(nation, "n_name", "inRegion", "r_name"), edge(nation.withColumn("ext", F.concat(F.lit("ext "), "n_name")), "n_name", "owl:sameAs", "ext"), edge(part, "p_name", "hasBrand", "p_brand"), edge(part, "p_name", "hasType", "p_type"),
    ):
        edges = edges.unionByName(more)
    names = types.select("x").distinct()
    iri = types.select(uri("x").alias("s"), "p", F.col("y").alias("o")).unionByName(edges.select(uri("x").alias("s"), "p", uri("y").alias("o")))
    wiki = nation.select(uri("n_name").alias("s"), F.lit("foaf:isPrimaryTopicOf").alias("p"), F.concat(F.lit(WIKI), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("o"))
    iri = iri.unionByName(wiki)
    labels = names.select(uri("x").alias("s"), F.lit(LABEL).alias("p"), F.col("x").alias("o"), F.lit("literal").alias("o_kind"))
    return iri.withColumn("o_kind", F.lit("iri")).unionByName(labels).distinct()


def links(kg: DataFrame) -> DataFrame:
    """link (text, uri): one entity per mention text."""
    return kg.where(F.col("p") == LABEL).groupBy(F.col("o").alias("text")).agg(F.min("s").alias("uri"))


def numbered(df: DataFrame, col: str, path: str) -> DataFrame:
    """df with n, the place of each row in the order of a distinct column, from 0.
    Ranges of the order are numbered each by a task of its own; they are written at
    path first, as their bounds are sampled."""
    ranges = stored(df.repartitionByRange(col).withColumn("part", F.spark_partition_id()), path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ahead"))  # a row per range
    own = ranges.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(col)) - 1)
    return own.join(ahead, "part").withColumn("n", F.col("own") + F.col("ahead")).drop("own", "ahead", "part")


def embeddings(spark: SparkSession, sf: str, kg: DataFrame, path: str) -> DataFrame:
    """(uri, embedding): four of five entities have one, by number in order of uri."""
    n = numbered(kg.where(F.col("p") == LABEL).select(F.col("s").alias("uri")).distinct(), "uri", path)
    e = table(spark, sf, "embeddings")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    keyed = n.where("n % 5 <> 0").join(total).withColumn("vec_id", (F.col("n") % F.col("total")).cast("long"))
    return keyed.join(e, "vec_id").select("uri", F.col("embedding").cast("array<double>").alias("embedding"))


#: The same tables for DuckDB.
CTE = """
WITH nr AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
raw_rows AS (
  SELECT 'customer_' || n_nationkey || '.csv' AS table_id, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS row_idx, [c_name, n_name, r_name, c_mktsegment] AS cells
  FROM customer JOIN nr ON c_nationkey = n_nationkey
  UNION ALL SELECT 'part_' || replace(p_brand, '#', '_') || '.csv', row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey), [p_name, p_brand, p_type, CAST(p_size AS VARCHAR)] FROM part
  UNION ALL SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY p_name, p_brand), [s_name, p_name, p_brand, n_name]
  FROM (SELECT DISTINCT 'supply_' || s_suppkey || '.csv' AS table_id, s_name, p_name, p_brand, n_name
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)),
all_rows AS (
  SELECT * FROM raw_rows UNION ALL
  SELECT DISTINCT table_id, 0, CASE split_part(table_id, '_', 1) WHEN 'customer' THEN ['customer', 'nation', 'region', 'segment']
    WHEN 'part' THEN ['part', 'brand', 'type', 'size'] ELSE ['supplier', 'part', 'brand', 'nation'] END FROM raw_rows),
cells AS MATERIALIZED (SELECT table_id, CAST(row_idx AS INT) AS row_idx, CAST(i - 1 AS INT) AS col_idx, cells[i] AS text FROM all_rows, range(1, 5) r(i)),
typed AS (
  SELECT c_name AS x, ['Agent', 'Customer', 'Segment_' || c_mktsegment] AS y FROM customer
  UNION ALL SELECT s_name, ['Agent', 'Supplier'] FROM supplier UNION ALL SELECT n_name, ['Place', 'Nation'] FROM nation
  UNION ALL SELECT r_name, ['Place', 'Region'] FROM region UNION ALL SELECT p_name, ['Product', 'Part', 'PType_' || p_type] FROM part
  UNION ALL SELECT p_brand, ['Brand'] FROM part UNION ALL SELECT p_type, ['Category'] FROM part UNION ALL SELECT c_mktsegment, ['Category'] FROM customer),
types0 AS (SELECT x, 'rdf:type' AS p, unnest(list_concat(['http://www.w3.org/2002/07/owl#Thing'], y)) AS y FROM typed),
edges AS (
  SELECT c_name AS x, 'locatedIn' AS p, n_name AS y FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'inSegment', c_mktsegment FROM customer
  UNION ALL SELECT s_name, 'locatedIn', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT s_name, 'supplies', p_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT n_name, 'inRegion', r_name FROM nr UNION ALL SELECT n_name, 'owl:sameAs', 'ext ' || n_name FROM nation UNION ALL SELECT p_name, 'hasBrand', p_brand FROM part UNION ALL SELECT p_name, 'hasType', p_type FROM part),
kg AS MATERIALIZED (
  SELECT 'kg:' || replace(n_name, ' ', '_') AS s, 'foaf:isPrimaryTopicOf' AS p, 'http://en.wikipedia.org/wiki/' || replace(n_name, ' ', '_') AS o, 'iri' AS o_kind FROM nation
  UNION SELECT DISTINCT 'kg:' || replace(x, ' ', '_') AS s, p, y AS o, 'iri' AS o_kind FROM types0
  UNION SELECT 'kg:' || replace(x, ' ', '_'), p, 'kg:' || replace(y, ' ', '_'), 'iri' FROM edges
  UNION SELECT 'kg:' || replace(x, ' ', '_'), 'rdfs:label', x, 'literal' FROM types0),
link AS (SELECT o AS text, min(s) AS uri FROM kg WHERE p = 'rdfs:label' GROUP BY o),
mention AS MATERIALIZED (SELECT uri, table_id, row_idx, col_idx FROM cells JOIN link USING (text)),
lake_uri AS (SELECT DISTINCT uri FROM mention),
ent_types AS (SELECT s AS uri, list_sort(list(DISTINCT o)) AS types FROM kg WHERE p = 'rdf:type' AND o NOT LIKE '%owl#Thing' AND o NOT LIKE '%/Q5' GROUP BY s),
ent_preds AS (SELECT s AS uri, list_sort(list(DISTINCT p)) AS predicates FROM kg WHERE o_kind = 'iri' GROUP BY s),
ent_nums AS (SELECT uri, row_number() OVER (ORDER BY uri) - 1 AS n FROM (SELECT DISTINCT s AS uri FROM kg WHERE p = 'rdfs:label')),
emb_ids AS (SELECT uri, n % total AS vec_id FROM ent_nums, (SELECT count(*) AS total FROM embeddings) WHERE n % 5 <> 0),
emb AS MATERIALIZED (SELECT uri, CAST(embedding AS DOUBLE[]) AS embedding FROM emb_ids JOIN embeddings USING (vec_id)),
ent_idf AS (SELECT uri, log10((SELECT count(DISTINCT table_id) FROM cells)::DOUBLE / count(DISTINCT table_id)) + 1 AS idf FROM mention GROUP BY uri),
lake_types AS (SELECT uri, unnest(types) AS type FROM ent_types JOIN lake_uri USING (uri)),
type_idf AS (SELECT type, log2((SELECT count(*) FROM lake_uri)::DOUBLE / count(*)) AS idf FROM lake_types GROUP BY type)
"""
