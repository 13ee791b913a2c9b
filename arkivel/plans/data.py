"""Queries of described data, views, checks and transformations over the test tables, with their SQL."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import description as D
from ..functions import values as N
from ..operators import decode, packages, tables, transform, views
from .graph import query

READ = lambda spark, sf_dir, t: spark.read.parquet(f"{sf_dir}/{t}.parquet")

#: A fixed layout: order key, line number, quantity in hundredths, flag.
FIXED = D.Description(D.Record("line", (D.Field("l_orderkey", "INT64"), D.Field("l_linenumber", "UINT8"), D.Field("hundredths", "UINT32"), D.Field("l_returnflag", "STRING", "1"))))
#: A variable one: count, then as many of a key and a name whose length goes before; a choice by kind.
NAMED = D.Record("entry", (D.Field("kind", "UINT8"), D.Choice("body", "kind", (("1", D.Field("number", "INT64", big=False)), ("2", D.Record("text", (D.Field("n", "UINT8"), D.Field("value", "STRING", "n"))))))), D.Times("repeated", "count"))
VARIABLE = D.Description(D.Record("file", (D.Field("count", "UINT16"), NAMED)))


@query("SELECT l_orderkey, l_linenumber::SMALLINT AS l_linenumber, round(l_quantity * 100)::BIGINT AS hundredths, l_returnflag FROM lineitem")
def decode_fixed_layout(spark, sf_dir):
    rows = READ(spark, sf_dir, "lineitem")
    hexed = lambda c, n: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    raw = F.concat(hexed(F.col("l_orderkey"), 8), hexed(F.col("l_linenumber").cast("bigint"), 1), hexed(F.round(F.col("l_quantity") * 100).cast("bigint"), 4), F.encode("l_returnflag", "US-ASCII"))
    return rows.select(raw.alias("content")).select(*decode.fixed_columns(F.col("content"), FIXED))


def _pack_customers(batches):
    """Files of one customer each, as described by VARIABLE."""
    for batch in batches:
        out = []
        for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = name.encode("latin-1")
            out.append(struct.pack(">HB", 2, 1) + struct.pack("<q", key) + struct.pack(">BB", 2, len(raw)) + raw)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])


def _customer_files(spark, sf_dir):
    return READ(spark, sf_dir, "customer").select("c_custkey", "c_name").mapInArrow(_pack_customers, "path string, content binary")


@query("SELECT c_custkey::VARCHAR AS doc_id, c_custkey::VARCHAR AS number, c_name AS value FROM customer")
def decode_variable_layout(spark, sf_dir):
    nodes = decode.nodes(_customer_files(spark, sf_dir), VARIABLE)
    return nodes.groupBy("doc_id").agg(F.max(F.when(F.col("name") == "number", F.col("value"))).alias("number"), F.max(F.when(F.col("name") == "value", F.col("value"))).alias("value"))


@query("SELECT c_custkey::VARCHAR AS doc_id, 0::BIGINT AS differing, -1::BIGINT AS first FROM customer")
def round_trip(spark, sf_dir):
    return decode.round_trips(_customer_files(spark, sf_dir), VARIABLE)


@query("SELECT event_id, date_trunc('millisecond', ts) AS event_start FROM events")
def timeseries_view(spark, sf_dir):
    rows = READ(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))
    return views.time_series(rows, "millis", columns=("event_id",)).select("event_id", F.col("event_start").cast("timestamp_ntz").alias("event_start"))


@query("SELECT vec_id, 2 AS dimension, embedding[1]::DOUBLE AS x, embedding[4]::DOUBLE AS y FROM embeddings")
def vector_view(spark, sf_dir):
    rows = READ(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(4)])
    made = views.vector(rows, "line", [["v0", "v1"], ["v2", "v3"]], ("vec_id",))
    return made.select("vec_id", F.col("geometry.dimension").alias("dimension"), F.col("geometry.coordinates")[0][0].alias("x"), F.col("geometry.coordinates")[1][1].alias("y"))


@query("SELECT min(x)::DOUBLE AS low, max(x)::DOUBLE AS high, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (x <> floor(x)) AS fractions, count(*) AS pixels FROM (SELECT unnest(embedding)::FLOAT AS x FROM embeddings)")
def image_view_stats(spark, sf_dir):
    cells = READ(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "raw")).select("vec_id", F.col("raw").cast("double").alias("value"))
    return views.pixel_summary(cells)


@query("SELECT p_partkey, (p_size::DECIMAL(20,0) * 0.001000::DECIMAL(12,6) + 1.500000::DECIMAL(18,6))::DOUBLE AS physical, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS meaning, p_size = 7 AS is_fill FROM part")
def semantics_physical(spark, sf_dir):
    rows = READ(spark, sf_dir, "part")
    return rows.select("p_partkey", N.physical(F.col("p_size"), 0.001, 1.5).cast("double").alias("physical"), N.meaning(F.col("p_size"), {"1": "one", "2.0": "two"}).alias("meaning"), N.fill_number(F.col("p_size"), "7.0").alias("is_fill"))


@query("""SELECT count(*) FILTER (trim(o_orderstatus) = '') AS blank, count(*) FILTER (o_orderstatus = 'P') AS fill, count(*) FILTER (o_orderstatus NOT IN ('P', 'F')) AS unknown_code, 0::BIGINT AS not_number, 0::BIGINT AS out_of_range FROM orders""")
def column_test(spark, sf_dir):
    return tables.column_quality(READ(spark, sf_dir, "orders"), "o_orderstatus", fill="P", codes=["F"])


@query("""WITH a AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)
SELECT a.s_name AS supplier_name, b.n_name AS nation_name FROM a JOIN b USING (i)""")
def table_zip_join(spark, sf_dir):
    out = tables.zipped(READ(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], "a", READ(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "b")
    return out.select(F.col("`a.s_name`").alias("supplier_name"), F.col("`b.n_name`").alias("nation_name"))


@query("SELECT 'customers' AS source, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_name FROM supplier")
def table_tagged_union(spark, sf_dir):
    a = READ(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return tables.tagged_union(a, "customers", READ(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "suppliers")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders")
def cell_edits(spark, sf_dir):
    rows = READ(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return tables.edited(rows, "o_orderkey", rows.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit(None).cast("string").alias("value")), "o_orderstatus")


@query("""WITH v AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem)
SELECT max(v) FILTER (r = floor(0.05 * (n - 1))) AS low, max(v) FILTER (r = ceil(0.95 * (n - 1))) AS high FROM v""")
def display_limits(spark, sf_dir):
    return tables.display_limits(READ(spark, sf_dir, "lineitem"), "l_extendedprice", 90.0)


MAPPING = """
# part sizes in other units
for part in parts
  key = p_partkey
  name = p_name
  millimetres = p_size * 25.4
  kind = "part"
end
"""


@query("SELECT p_partkey AS key, p_name AS name, (p_size * 25.4)::DOUBLE AS millimetres, 'part' AS kind FROM part")
def mapping_transform(spark, sf_dir):
    rule = transform.parse_mapping(MAPPING)[0]
    return transform.mapped(READ(spark, sf_dir, "part"), rule, {"key": "bigint", "millimetres": "double"})


@query("SELECT true AS same_count, count(*) AS compared, 0.0::DOUBLE AS max_difference, NULL::BIGINT AS first_difference, true AS preserved FROM part")
def property_check(spark, sf_dir):
    rows = READ(spark, sf_dir, "part")
    return transform.property_check(rows, rows, "p_partkey", "p_retailprice", "p_retailprice", *transform.tolerance("double"))


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 1 THEN 'mismatched' WHEN doc_id % 10 = 2 THEN 'unlisted' WHEN doc_id % 10 = 3 THEN 'missing' ELSE 'matched' END AS status FROM documents""")
def bag_verify(spark, sf_dir):
    docs = READ(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    manifest = docs.where("doc_id % 10 <> 2").select("path", F.when(F.expr("doc_id % 10 = 1"), F.lit("0")).otherwise(F.upper("sha256")).alias("sha256"))
    return packages.bag_check(manifest, docs.where("doc_id % 10 <> 3").select("path", "sha256"))


@query("SELECT coalesce(sum(strlen(text)), 0)::BIGINT AS octets, count(*) AS streams FROM documents")
def payload_oxum(spark, sf_dir):
    return packages.oxum(READ(spark, sf_dir, "documents").select(F.octet_length("text").cast("bigint").alias("size")))


@query("""SELECT o_custkey AS package, p AS component, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 1 THEN 'MISSING' WHEN n > 2 THEN 'TOO_MANY' ELSE 'PRESENT' END AS status
FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES ('1-URGENT'), ('5-LOW')) c(p) LEFT JOIN (SELECT o_custkey AS k, o_orderpriority AS q, count(*) AS n FROM orders GROUP BY ALL) ON k = o_custkey AND q = p""")
def completeness(spark, sf_dir):
    parts = READ(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderpriority").alias("component"))
    rules = spark.createDataFrame([("1-URGENT", 1, 2), ("5-LOW", 1, 2)], "component string, least int, most int")
    return packages.completeness(parts, rules)


@query("""SELECT doc_id AS package, 'PDI Provenance' AS component, lang <> '' AS found FROM documents
UNION ALL SELECT doc_id, 'PDI Reference', true FROM documents UNION ALL SELECT doc_id, 'Package Description', false FROM documents""")
def package_findings(spark, sf_dir):
    rows = READ(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("Record No"), F.col("lang").alias("dc.creator"), F.lit("Title:").alias("title"))
    rows = rows.withColumn("Record No", F.concat(F.lit("R"), F.col("`Record No`")))
    return packages.findings(rows, "doc_id").where(F.col("component").isin("PDI Provenance", "PDI Reference", "Package Description")).select("package", "component", "found")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 1000 AND o_orderstatus = 'F' OR NOT o_orderkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS v FROM orders")
def expression_columns(spark, sf_dir):
    from ..functions.expressions import column, parse

    known = {"price": (F.floor("o_totalprice").cast("bigint"), True), "status": (F.col("o_orderstatus"), False), "key": (F.col("o_orderkey"), True)}
    rows = READ(spark, sf_dir, "orders").where("o_totalprice is not null")
    return rows.select("o_orderkey", column(parse("price >= 1000 and price * 1 > 999 and status = 'F' or not key % 2 = 0"), lambda r: known[r[0]]).alias("v"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_titles(spark, sf_dir):
    """Titles of pages that are well-formed enough for a pattern."""
    return READ(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query("SELECT o_orderkey::VARCHAR || ',' || o_orderpriority AS value FROM orders")
def csv_sink(spark, sf_dir):
    from ..sources.sinks import csv_lines

    return csv_lines(READ(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))


@query("SELECT p_partkey, p_size::DOUBLE AS ibm, (p_size::DOUBLE * 2)::DOUBLE AS mil, -p_size::BIGINT AS ones, -p_size::BIGINT AS magnitude FROM part")
def physical_numbers(spark, sf_dir):
    """Sizes written as IBM and MIL-STD-1750A reals and as negative integers of two conventions, and read again."""
    from ..functions import east

    word = lambda c, n: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    size = F.col("p_size").cast("bigint")
    rows = READ(spark, sf_dir, "part").select("p_partkey", F.concat(F.unhex(F.lit("46")), word(size, 3)).alias("ibm"), F.concat(word(size, 3), F.unhex(F.lit("18"))).alias("mil"), word(F.lit(0xFFFF) - size, 2).alias("ones"), word(F.lit(0x8000) + size, 2).alias("magnitude"))
    return rows.select("p_partkey", east.real_column(F.col("ibm"), east.IBM32).alias("ibm"), east.real_column(F.col("mil"), east.MIL32).alias("mil"), east.integer_column(F.col("ones"), ((0, 15),), "ones_complement").alias("ones"), east.integer_column(F.col("magnitude"), ((0, 7), (8, 15)), "sign_and_magnitude").alias("magnitude"))


@query("SELECT component, CASE WHEN component = 'hasFixityInformation' THEN CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END WHEN component = 'hasAccessRightsInformation' THEN 0 ELSE 1 END::BIGINT AS n, count(*) AS packages FROM documents, (VALUES ('hasContentInformation'), ('hasPreservationDescriptiveInformation'), ('hasFixityInformation'), ('hasReferenceInformation'), ('hasProvenanceInformation'), ('hasContextInformation'), ('hasAccessRightsInformation'), ('describedBy')) c(component) GROUP BY ALL")
def package_build(spark, sf_dir):
    from ..operators import aip
    from ..sources.triples import iri

    docs = READ(spark, sf_dir, "documents")
    objects = docs.select(iri("document", "doc_id").alias("iri"), F.concat(F.lit("doc "), "doc_id").alias("name"), F.when(F.expr("doc_id % 2 = 0"), F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"), F.octet_length("text").alias("size"), F.lit("file:///x").alias("location"), F.lit("c").alias("context"), F.lit(None).cast("string").alias("rights"), F.lit("me").alias("recorded_by"), F.lit("2020-01-01").alias("recorded_at"))
    return aip.checked(aip.build(objects)).groupBy("component", F.col("n").cast("bigint").alias("n")).agg(F.count("*").alias("packages"))
