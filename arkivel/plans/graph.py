"""Queries of the knowledge graph over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import closures as G
from ..operators import ingest as I
from ..operators import listing as L
from ..sources import triples as T
from . import sparql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _view(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The tables' data triples with the hierarchy; rows of a table are distinct, so no set union is needed."""
    return T.projected(spark, sf_dir, tables).unionByName(T.ontology(spark)).drop("g")


def _records(spark: SparkSession, view: DataFrame) -> DataFrame:
    return L.typed(view, V.RICO + "RecordResource", G.subclass_closure(spark, T.ontology(spark)))


@query("SELECT c_name AS value, count(DISTINCT o_orderkey) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def records_by_creator(spark, sf_dir):
    view = _view(spark, sf_dir, "orders", "customer")
    return L.by_creator(view, _records(spark, view))


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def records_by_type(spark, sf_dir):
    view = _view(spark, sf_dir, "orders", "documents")
    return L.by_property(view, _records(spark, view), V.DC + "type")


@query("SELECT lang AS value, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def records_by_language(spark, sf_dir):
    view = _view(spark, sf_dir, "documents")
    return L.by_property(view, _records(spark, view), V.DC + "language")


@query("SELECT strftime(o_orderdate, '%Y') AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY 1 LIMIT 100")
def records_by_year(spark, sf_dir):
    view = _view(spark, sf_dir, "orders")
    return L.by_year(view, _records(spark, view))


@query(f"""
SELECT '{V.NAME}' AS p, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS uses, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS subjects
UNION ALL SELECT '{V.DC}type', count(*), count(*) FROM customer
UNION ALL SELECT '{V.EX}inNation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)""")
def property_usage(spark, sf_dir):
    return L.property_usage(T.projected(spark, sf_dir, ("customer", "supplier")))


@query(f"""SELECT '{V.EX}Customer' AS type, count(*) AS count FROM customer UNION ALL SELECT '{V.EX}Supplier', count(*) FROM supplier
UNION ALL SELECT '{V.RICO}Record', count(*) FROM orders UNION ALL SELECT '{V.EX}Part', count(*) FROM part
UNION ALL SELECT '{V.EX}Place', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)""")
def types_in_use(spark, sf_dir):
    return L.types_in_use(T.projected(spark, sf_dir, ("customer", "supplier", "orders", "part", "nation", "region")))


@query("SELECT (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS agents, (SELECT count(*) FROM customer) * 4 + (SELECT count(*) FROM supplier) * 3 + (SELECT count(*) FROM orders) * 6 AS triples")
def dashboard_counts(spark, sf_dir):
    return L.dashboard(T.projected(spark, sf_dir, ("orders", "customer", "supplier")), {"records": [V.RICO + "Record"], "agents": [V.EX + "Customer", V.EX + "Supplier"]})


@query(f"SELECT '{V.EX}document-' || doc_id AS s FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def catalogue_search(spark, sf_dir):
    view = _view(spark, sf_dir, "documents")
    return L.search(view, _records(spark, view).select("s"), "license")


@query(f"""SELECT '{V.EX}order-' || o_orderkey AS s FROM orders JOIN customer ON o_custkey = c_custkey
WHERE lower(o_orderpriority) = '1-urgent' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1997-06-30' AND contains(lower(c_name), '7')""")
def advanced_search(spark, sf_dir):
    view = _view(spark, sf_dir, "orders", "customer")
    facets = L.Facets(equals=((V.DC + "type", "1-URGENT"),), linked=((V.RICO + "hasCreator", "7"),), date_from="1996-01-01", date_to="1997-06-30")
    return L.advanced(view, _records(spark, view).select("s"), facets)


@query(f"SELECT '{V.EX}order-' || o_orderkey AS s, '{V.RICO}Record' AS type, 'Order ' || o_orderkey AS title FROM orders ORDER BY lower('Order ' || o_orderkey), s LIMIT 50 OFFSET 100")
def listing_page(spark, sf_dir):
    view = _view(spark, sf_dir, "orders")
    return L.sorted_page(L.titled(_records(spark, view), view), 3, 50)


@query("SELECT count(DISTINCT o_orderkey) AS total FROM orders")
def listing_total(spark, sf_dir):
    return L.total(_records(spark, _view(spark, sf_dir, "orders")))


@query(f"SELECT '{V.EX}customer-' || c_custkey AS s, lower(c_name) AS sort_key FROM customer ORDER BY 2, 1 LIMIT 50 OFFSET 50")
def entities_page(spark, sf_dir):
    return L.page(L.entities(T.projected(spark, sf_dir, ("customer",)), V.EX + "Customer"), [F.col("sort_key"), F.col("s")], 2, 50)


@query(f"""SELECT '{V.RICO}hasCreator' AS p, '{V.EX}customer-' || o_custkey AS target, c_name AS title FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)""")
def outgoing_links(spark, sf_dir):
    key = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min("o_orderkey")).first()[0]
    return L.outgoing(_view(spark, sf_dir, "orders", "customer"), f"{V.EX}order-{key}")


@query(f"SELECT '{V.EX}partOf' AS p, '{V.EX}nation-' || n_nationkey AS source, n_name AS title FROM nation WHERE n_regionkey = 1")
def incoming_links(spark, sf_dir):
    return L.incoming(_view(spark, sf_dir, "nation", "region"), V.EX + "region-1")


@query(f"SELECT '{V.EX}document-' || doc_id AS s, substr(text, 1, 40) AS title FROM documents UNION ALL SELECT '{V.EX}part-' || p_partkey, p_name FROM part")
def display_labels(spark, sf_dir):
    return L.display(T.projected(spark, sf_dir, ("documents", "part")))


@query(f"SELECT '{V.EX}customer-' || c_custkey AS s FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_records(spark, sf_dir):
    view = _view(spark, sf_dir, "orders", "customer")
    used = L.of(view, V.RICO + "hasCreator").select(F.col("o").alias("s"))
    return L.typed(view, V.EX + "Customer").select("s").join(used, "s", "left_anti")


_EDGES = ", ".join(f"('{T.full(a)}', '{T.full(b)}')" for a, b in T.HIERARCHY)


@query(f"WITH RECURSIVE e(a, b) AS (VALUES {_EDGES}), c(a, b) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
def subclass_closure(spark, sf_dir):
    return G.subclass_closure(spark, T.ontology(spark))


_NEAR = f"""WITH RECURSIVE e AS (
  SELECT '{V.EX}nation-' || n_nationkey AS a, '{V.EX}region-' || n_regionkey AS b FROM nation
  UNION ALL SELECT '{V.EX}supplier-' || s_suppkey, '{V.EX}nation-' || s_nationkey FROM supplier),
x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, depth) AS (SELECT '{V.EX}region-1', 0 UNION SELECT x.b, r.depth + 1 FROM r JOIN x ON r.node = x.a WHERE r.depth < 2)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node ORDER BY 2, 1 LIMIT 300"""


@query(_NEAR)
def bounded_subgraph(spark, sf_dir):
    seeds = spark.createDataFrame([(V.EX + "region-1",)], "node string")
    return G.neighbourhood(T.projected(spark, sf_dir, ("nation", "region", "supplier")), seeds, 2)[0]


@query(f"""WITH RECURSIVE e AS (
  SELECT '{V.EX}nation-' || n_nationkey AS a, '{V.EX}region-' || n_regionkey AS b FROM nation
  UNION ALL SELECT '{V.EX}customer-' || c_custkey, '{V.EX}nation-' || c_nationkey FROM customer),
r(root, node, depth) AS (SELECT '{V.EX}customer-' || c_custkey, '{V.EX}customer-' || c_custkey, 0 FROM customer UNION SELECT r.root, e.b, r.depth + 1 FROM r JOIN e ON r.node = e.a)
SELECT root, node, min(depth)::INT AS depth FROM r GROUP BY ALL""")
def package_closure(spark, sf_dir):
    data = T.projected(spark, sf_dir, ("customer", "nation", "region"))
    seeds = L.typed(data, V.EX + "Customer").select(F.col("s").alias("node"))
    return G.package_closure(data, seeds, V.EX, [V.EX + "derivedFrom"])


@query(f"""SELECT replace('{V.EX}', 'http://example.org/', 'urn:x:') || 'nation-' || n_nationkey AS s, '{V.NAME}' AS p, n_name AS o FROM nation
UNION ALL SELECT 'urn:x:archive/nation-' || n_nationkey, 'urn:x:archive/partOf', 'urn:x:archive/region-' || n_regionkey FROM nation
UNION ALL SELECT 'urn:x:archive/nation-' || n_nationkey, '{V.TYPE}', 'urn:x:archive/Place' FROM nation""")
def namespace_rename(spark, sf_dir):
    return G.renamed(T.projected(spark, sf_dir, ("nation",)), "http://example.org/", "urn:x:").select("s", "p", "o")


@query("""SELECT count(*) * 6 AS triples, count(*) AS subjects FROM orders WHERE NOT contains('order-' || o_orderkey, 'order-1') AND NOT contains('customer-' || o_custkey, 'order-1')""")
def cascade_delete(spark, sf_dir):
    left = I.cascade_delete(T.projected(spark, sf_dir, ("orders",)), "order-1")
    return left.agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"))


@query(f"SELECT '{V.EX}agent-' || regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g') AS s, c_name || ' ' || c_mktsegment AS name FROM customer WHERE c_name || ' ' || c_mktsegment NOT IN (SELECT s_name FROM supplier)")
def lookup_or_insert_agents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("creator"))
    return I.new_agents(rows, T.projected(spark, sf_dir, ("supplier",)))


@query(f"""SELECT s, p, o FROM (
  SELECT '{V.EX}record-b1-doc-' || doc_id AS s, '{V.DC}subject' AS p, unnest([source, lang]) AS o FROM documents
  UNION ALL SELECT '{V.EX}record-b1-doc-' || doc_id, '{V.TITLE}', 'Doc ' || doc_id FROM documents
  UNION ALL SELECT '{V.EX}record-b1-doc-' || doc_id, '{V.EX}recordNumber', 'DOC ' || doc_id FROM documents
  UNION ALL SELECT '{V.EX}record-b1-doc-' || doc_id, '{V.TYPE}', '{V.RICO}Record' FROM documents
  UNION ALL SELECT '{V.EX}record-b1-doc-' || doc_id, '{V.EX}hasCounterpart', '{V.EX}aip-b1-doc-' || doc_id FROM documents
  UNION ALL SELECT '{V.EX}aip-b1-doc-' || doc_id, '{V.TYPE}', '{V.EX}InformationPackage' FROM documents
  UNION ALL SELECT '{V.EX}aip-b1-doc-' || doc_id, '{V.EX}describes', '{V.EX}record-b1-doc-' || doc_id FROM documents)""")
def catalogue_import(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.concat(F.lit("DOC "), "doc_id").alias("Record No"), F.concat(F.lit("Doc "), "doc_id").alias("Title"), F.concat(F.lit(" ; null; "), "source", F.lit(" ;"), "lang").alias("Subject"))
    good, _ = I.catalogue_rows(rows)
    return I.records(good, "b1").select("s", "p", "o")


@query(f"SELECT '{V.EX}customer-' || c_custkey AS s, trim(replace(replace(replace(to_base64(('{V.EX}customer-' || c_custkey)::BLOB), '+', '-'), '/', '_'), '=', '')) AS id FROM customer")
def encoded_ids(spark, sf_dir):
    return L.typed(T.projected(spark, sf_dir, ("customer",)), V.EX + "Customer").select("s", V.encode_id("s").alias("id"))


@query(f"SELECT '{V.EX}region-' || n_regionkey AS node, min_by('{V.EX}nation-' || n_nationkey, n_name) AS parent FROM nation GROUP BY 1")
def first_parents(spark, sf_dir):
    return L.parents(T.projected(spark, sf_dir, ("nation",)), V.EX + "partOf")


@query("SELECT c_mktsegment AS segment, count(*)::VARCHAR AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1 HAVING count(*) > 1 ORDER BY 1")
def sparql_select(spark, sf_dir):
    return sparql.run(_view(spark, sf_dir, "customer", "nation", "region"), """
      SELECT ?segment (COUNT(DISTINCT ?c) AS ?n) WHERE {
        ?c a ex:Customer ; dc:type ?segment ; ex:inNation/ex:partOf ex:region-1 .
      } GROUP BY ?segment HAVING (COUNT(?c) > 1) ORDER BY ?segment""")


@query(f"""SELECT '{V.EX}nation-' || n_nationkey AS n, CASE WHEN s_name LIKE '%7' THEN s_name END AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_name LIKE '%7'
WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def sparql_optional_minus(spark, sf_dir):
    return sparql.run(_view(spark, sf_dir, "nation", "region", "supplier"), """
      SELECT ?n ?supplier WHERE {
        ?n ex:partOf ?r .
        OPTIONAL { ?x ex:inNation ?n ; rico:name ?supplier . FILTER(STRENDS(?supplier, "7")) }
        MINUS { ?n ex:partOf ex:region-0 }
      }""")


@query(f"""WITH RECURSIVE e AS (SELECT '{V.EX}nation-' || n_nationkey AS a, '{V.EX}region-' || n_regionkey AS b FROM nation UNION ALL SELECT '{V.EX}supplier-' || s_suppkey, '{V.EX}nation-' || s_nationkey FROM supplier),
r(root, node) AS (SELECT '{V.EX}supplier-' || s_suppkey, '{V.EX}supplier-' || s_suppkey FROM supplier UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a)
SELECT root AS s, node AS place FROM r WHERE node <> root""")
def sparql_path(spark, sf_dir):
    return sparql.run(_view(spark, sf_dir, "nation", "region", "supplier"), "SELECT DISTINCT ?s ?place WHERE { ?s a ex:Supplier . ?s (ex:inNation|ex:partOf)+ ?place }")


@query(f"""SELECT n, max(CASE WHEN s THEN v END) AS v, max(CASE WHEN s THEN lang END) AS lang, max(dt) AS dt FROM (
SELECT '{V.EX}nation-' || n_nationkey AS n, n_nationkey % 2 = 0 AS s, n_name AS v, 'en' AS lang, '{V.RDF}langString' AS dt FROM nation WHERE n_nationkey % 2 = 0) GROUP BY n""")
def sparql_language(spark, sf_dir):
    """LANG, DATATYPE and LANGMATCHES of labels, of which every second is tagged."""
    view = _view(spark, sf_dir, "nation")
    tagged = view.withColumn("o_lang", F.when((F.col("p") == V.NAME) & (F.regexp_extract("s", r"(\d+)$", 1).try_cast("int") % 2 == 0), F.lit("en")).otherwise(F.lit("")))
    return sparql.run(tagged, 'SELECT ?n ?v (LANG(?v) AS ?lang) (DATATYPE(?v) AS ?dt) WHERE { ?n rico:name ?v FILTER(LANGMATCHES(LANG(?v), "EN")) }')


@query(f"""SELECT '{V.EX}supplier-' || a.s_suppkey AS a FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_name > a.s_name)""")
def sparql_not_exists(spark, sf_dir):
    """A filter within NOT EXISTS that names a variable outside it: the last supplier of each nation."""
    return sparql.run(_view(spark, sf_dir, "supplier"), """
      SELECT ?a WHERE { ?a ex:inNation ?n ; rico:name ?x .
        FILTER NOT EXISTS { ?b ex:inNation ?n ; rico:name ?y . FILTER(STR(?y) > STR(?x)) } }""")


@query(f"""SELECT '{V.EX}nation-' || n_nationkey AS n, coalesce(min(CASE WHEN s_name LIKE '%1' THEN s_name END), min(c_name)) AS v
FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_name LIKE '%1' GROUP BY 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, min(c_name) AS c_name FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1""")
def sparql_unbound(spark, sf_dir):
    """A variable that a first OPTIONAL leaves unbound is bound by the second one."""
    rows = sparql.run(_view(spark, sf_dir, "nation", "supplier", "customer", "region"), """
      SELECT ?n ?v WHERE { ?n ex:partOf ?r .
        OPTIONAL { SELECT ?n (MIN(?a) AS ?v) WHERE { ?s a ex:Supplier ; ex:inNation ?n ; rico:name ?a . FILTER(STRENDS(?a, "1")) } GROUP BY ?n }
        OPTIONAL { SELECT ?n (MIN(?b) AS ?v) WHERE { ?c a ex:Customer ; ex:inNation ?n ; rico:name ?b } GROUP BY ?n } }""")
    return rows


@query("""SELECT n_regionkey::VARCHAR AS r, sum(n_nationkey)::BIGINT::VARCHAR AS total, count(*)::VARCHAR AS n FROM nation GROUP BY 1 ORDER BY sum(n_nationkey) DESC, 1 LIMIT 3""")
def sparql_sums(spark, sf_dir):
    """SUM as a whole number, COUNT(DISTINCT *), and an order by the number."""
    rows = sparql.run(_view(spark, sf_dir, "nation", "region"), """
      SELECT ?r (SUM(?k) AS ?total) (COUNT(DISTINCT *) AS ?n) WHERE { ?x ex:partOf ?y .
        BIND(STRAFTER(STR(?x), "nation-") AS ?k) BIND(STRAFTER(STR(?y), "region-") AS ?r) } GROUP BY ?r ORDER BY DESC(?total) ?r LIMIT 3""")
    return rows


@query("SELECT s_name AS name FROM supplier ORDER BY s_name LIMIT 7 OFFSET 2")
def sparql_text_order(spark, sf_dir):
    """Plain text is ordered as text."""
    return sparql.run(_view(spark, sf_dir, "supplier"), "SELECT ?name WHERE { ?s a ex:Supplier ; rico:name ?name } ORDER BY ?name LIMIT 7 OFFSET 2")


@query(f"SELECT '{V.EX}supplier-' || s_suppkey AS s FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2 UNION ALL SELECT '{V.EX}nation-' || n_nationkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT '{V.EX}region-2'")
def sparql_path_to(spark, sf_dir):
    """A path of any length to a known end, walked from that end."""
    return sparql.run(_view(spark, sf_dir, "nation", "region", "supplier"), "SELECT ?s WHERE { ?s (ex:inNation|ex:partOf)* ex:region-2 }")


@query("""SELECT c_mktsegment AS segment, r_name AS region, count(*)::VARCHAR AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2""")
def sparql_values_union(spark, sf_dir):
    """Patterns in an order that would need a cross join as written; VALUES; UNION."""
    return sparql.run(_view(spark, sf_dir, "customer", "nation", "region"), """
      SELECT ?segment ?region (COUNT(?c) AS ?n) WHERE {
        ?c dc:type ?segment . ?y rico:name ?region . ?x ex:partOf ?y . ?c ex:inNation ?x .
        { VALUES ?region { "ASIA" } } UNION { VALUES ?region { "EUROPE" } } } GROUP BY ?segment ?region""")
