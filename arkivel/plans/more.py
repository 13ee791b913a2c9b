"""Queries of names, values, edits, closures, paths, package metadata and description texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import readers
from ..functions import values as N
from ..functions import vocab as V
from ..operators import closures as G
from ..operators import decode, packages, paths, tables, transform, views
from ..operators import ingest as I
from ..operators import listing as L
from ..sources import sinks
from ..sources import triples as T
from .data import READ, VARIABLE, _customer_files
from .graph import query

E = V.EX


@query(f"""SELECT '{E}nation-' || n_nationkey AS iri, 'nation-' || n_nationkey AS local, 'ex:nation-' || n_nationkey AS short, '{E}nation-' || n_nationkey AS expanded, 'local' AS tag, '{E}nation-' || n_nationkey AS decoded, 'in-nation' AS hyphened FROM nation""")
def names(spark, sf_dir):
    rows = READ(spark, sf_dir, "nation").select(T.iri("nation", "n_nationkey").alias("iri"))
    return rows.select("iri", V.local_name("iri").alias("local"), V.prefixed("iri").alias("short"), V.expanded(V.prefixed("iri")).alias("expanded"), V.source_tag("iri").alias("tag"), V.decode_id(V.encode_id("iri")).alias("decoded"), V.hyphened(F.lit("inNation")).alias("hyphened"))


@query("""SELECT doc_id, 'pdf' AS extension, 'Report_R' || doc_id || '__v_.PDF' AS safe, 'R' || doc_id AS number, 'https://drive.google.com/uc?export=download&id=' || doc_id AS url FROM documents""")
def file_names(spark, sf_dir):
    name = F.concat(F.lit("some/dir/Report r"), F.col("doc_id").cast("string"), F.lit(" (v).PDF"))
    rows = READ(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(name, "Report r", "Report R").alias("name"), name.alias("low"))
    return rows.select("doc_id", V.file_extension("name").alias("extension"), V.safe_file_name("name").alias("safe"), V.record_number("low").alias("number"), V.direct_link(F.concat(F.lit("https://drive.google.com/file/d/"), "doc_id", F.lit("/view"))).alias("url"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 800 < 26 THEN chr((65 + p_partkey % 800)::INT) WHEN p_partkey % 800 < 702 THEN chr((64 + (p_partkey % 800) // 26)::INT) || chr((65 + (p_partkey % 800) % 26)::INT) ELSE 'A' || chr((65 + (p_partkey % 800 - 702) // 26)::INT) || chr((65 + (p_partkey % 800 - 702) % 26)::INT) END AS letters FROM part")
def sheet_columns(spark, sf_dir):
    return READ(spark, sf_dir, "part").select("p_partkey", V.column_letters(F.expr("p_partkey % 800")).alias("letters"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS typed, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_custkey END AS raw,
(o_orderkey * 100)::DOUBLE AS ascii, (o_orderkey * 1000 + 0.5)::DOUBLE AS grouped, o_custkey = 7 AS fill, o_custkey::VARCHAR AS shown FROM orders""")
def text_values(spark, sf_dir):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    typed, raw = N.coerced(F.when(F.expr("o_orderkey % 3 = 0"), F.concat(F.lit("x"), cust)).otherwise(F.concat(F.lit(" "), cust)), "bigint")
    return READ(spark, sf_dir, "orders").select("o_orderkey", typed.alias("typed"), raw.alias("raw"), N.ascii_number(F.concat(F.lit("+"), key, F.lit(".0D2"))).alias("ascii"), N.grouped_number(F.concat(key, F.lit(".000,5")), ",", ".").cast("double").alias("grouped"), N.fill_text(F.concat(F.lit("0"), cust, F.lit(".0")), "7").alias("fill"), N.canonical(F.concat(F.lit("+0"), cust, F.lit(".00")), "number").alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / 50, 6) AS linear, round(sqrt(l_quantity / 50), 6) AS root, round(log10(1 + 999 * l_quantity / 50) / 3, 6) AS log, round(asinh(l_quantity / 5) / asinh(10), 6) AS asinh FROM lineitem""")
def image_stretch(spark, sf_dir):
    made = [F.round(N.stretched(F.col("l_quantity"), F.lit(0.0), F.lit(50.0), k), 6).alias(n) for k, n in (("linear", "linear"), ("sqrt", "root"), ("log", "log"), ("asinh", "asinh"))]
    return READ(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *made)


@query("""SELECT p_partkey, round(sin(p_size), 9) AS sin, round(ln(p_size), 9) AS ln, round(atan(p_size), 9) AS atan, p_size % 2 <> 0 AS odd, ((-p_size::BIGINT) // 7)::BIGINT AS quotient, (((-p_size::BIGINT) % 7) + 7) % 7 AS modulo FROM part""")
def record_functions(spark, sf_dir):
    size = F.col("p_size").cast("bigint")
    return READ(spark, sf_dir, "part").select("p_partkey", *[F.round(N.function(k, size), 9).alias(k) for k in ("sin", "ln", "atan")], N.function("is_odd", size).alias("odd"), N.quotient(-size, F.lit(7)).alias("quotient"), N.modulo(-size, F.lit(7)).alias("modulo"))


@query("SELECT p_partkey, s AS ieee, s AS vax, s AS nos_ve, -s AS nos_be, s AS ibm, 2 * s AS mil FROM (SELECT p_partkey, p_size::DOUBLE AS s FROM part)")
def real_conventions(spark, sf_dir):
    """Sizes written in the six conventions of real numbers, and read again."""
    from ..functions import east

    word = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("bigint")), 2 * n, "0"))
    size = F.col("p_size").cast("bigint")
    power = F.floor(F.log2(size) + F.lit(1e-9)).cast("int")
    fraction = (size * F.pow(F.lit(2.0), 23 - power)).cast("bigint") - (1 << 23)
    ieee = (power + 127).cast("bigint") * (1 << 23) + fraction
    vax = F.shiftleft(fraction.bitwiseAND(0xFFFF), 16) + (power + 129).cast("bigint") * 128 + F.shiftright(fraction, 16)
    nos_be = F.shiftleft(F.lit((1 << 60) - 1) - (F.lit(1 << 58) + size), 4)
    rows = READ(spark, sf_dir, "part").select("p_partkey", word(ieee, 4).alias("a"), word(vax, 4).alias("b"), word(size + (0x4030 << 48), 8).alias("c"), word(nos_be, 8).alias("d"), word(size + (0x46 << 24), 4).alias("e"), word(size * 256 + 0x18, 4).alias("f"))
    layouts = {"ieee": ("a", east.IEEE32), "vax": ("b", east.VAX_F), "nos_ve": ("c", east.NOS_VE), "nos_be": ("d", east.NOS_BE), "ibm": ("e", east.IBM32), "mil": ("f", east.MIL32)}
    return rows.select("p_partkey", *[east.real_column(F.col(c), layout).alias(n) for n, (c, layout) in layouts.items()])


KSY = """
meta:
  id: file
  endian: be
seq:
  - id: count
    type: u2
  - id: entry
    type: entry_type
    repeat: expr
    repeat-expr: count
types:
  entry_type:
    seq:
      - id: kind   # 1: a number, 2: a text
        type: u1
      - id: body
        type:
          switch-on: kind
          cases:
            1: number_type
            2: text_type
  number_type:
    seq:
      - id: number
        type: s8le
  text_type:
    seq:
      - id: n
        type: u1
      - id: value
        size: n
        type: str
        encoding: ASCII
"""

SCHEMA = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:dfdl="http://www.ogf.org/dfdl/dfdl-1.0/">
<xs:annotation><xs:appinfo><dfdl:format byteOrder="bigEndian"/></xs:appinfo></xs:annotation>
<xs:element name="file"><xs:complexType><xs:sequence>
  <xs:element name="count" type="xs:unsignedShort"/>
  <xs:element name="entry" maxOccurs="unbounded" dfdl:occursCountKind="expression" dfdl:occursCount="{ ../count }"><xs:complexType><xs:sequence>
    <xs:element name="kind" type="xs:unsignedByte"/>
    <xs:element name="body"><xs:complexType><xs:choice dfdl:choiceDispatchKey="{ xs:string(../kind) }">
      <xs:element dfdl:choiceBranchKey="1" name="number" type="xs:long" dfdl:byteOrder="littleEndian"/>
      <xs:element dfdl:choiceBranchKey="2" ref="text"/>
    </xs:choice></xs:complexType></xs:element>
  </xs:sequence></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:element>
<xs:element name="text"><xs:complexType><xs:sequence>
  <xs:element name="n" type="xs:unsignedByte"/>
  <xs:element name="value" type="xs:string" dfdl:lengthKind="explicit" dfdl:length="{ ../n }"/>
</xs:sequence></xs:complexType></xs:element></xs:schema>"""

_CUSTOMERS = "SELECT c_custkey::VARCHAR AS doc_id, c_custkey::VARCHAR AS number, c_name AS value FROM customer"


def _named_values(nodes):
    return nodes.groupBy("doc_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("number", "value")])


@query(_CUSTOMERS)
def decode_kaitai_text(spark, sf_dir):
    return _named_values(decode.nodes(_customer_files(spark, sf_dir), readers.kaitai(KSY)))


@query(_CUSTOMERS)
def decode_dfdl_text(spark, sf_dir):
    return _named_values(decode.nodes(_customer_files(spark, sf_dir), readers.dfdl(SCHEMA)))


@query("SELECT c_custkey::VARCHAR AS doc_id, count(*)::BIGINT AS lines, count(o_orderkey)::BIGINT AS filled FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def decode_text_lines(spark, sf_dir):
    """Files of one line for each order of a customer, at least one, read as described text with quoted cells."""
    from ..functions import description as D

    line = D.Record("line", (D.Field("key", "INT64", nil="-"), D.Field("note", "STRING")), D.UNTIL_END, separator=",", terminator="\n", quote='"')
    orders = READ(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat("o_orderkey", F.lit(',"a, ""b""\n"\n')).alias("line"))
    files = READ(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").groupBy("c_custkey").agg(F.encode(F.concat_ws("", F.collect_list(F.coalesce("line", F.lit("-,none\n")))), "UTF-8").alias("content"))
    nodes = decode.nodes(files.select(F.col("c_custkey").cast("string").alias("path"), "content"), D.Description(D.Record("file", (line,))))
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("name") == "line").alias("lines"), F.count_if((F.col("name") == "key") & (F.col("kind") == "LEAF")).alias("filled"))


@query("SELECT c_custkey::VARCHAR AS doc_id, true AS same FROM customer")
def rebuild_from_rows(spark, sf_dir):
    files = _customer_files(spark, sf_dir)
    made = decode.rewritten(decode.nodes(files, VARIABLE), VARIABLE)
    return files.select(F.col("path").alias("doc_id"), F.col("content").alias("was")).join(made, "doc_id").select("doc_id", (F.col("content") == F.col("was")).alias("same"))


@query("SELECT c_custkey::VARCHAR AS doc_id, '/file/entry[2]/body/text/value' AS path, c_name AS value FROM customer")
def element_path(spark, sf_dir):
    found = paths.strict(paths.with_paths(decode.nodes(_customer_files(spark, sf_dir), VARIABLE)), "/file[1]/entry[2]/body/text/value")
    return found.select("doc_id", "path", "value")


@query("SELECT c_custkey::VARCHAR AS doc_id, c_custkey::VARCHAR AS value FROM customer")
def dotted_path(spark, sf_dir):
    return paths.dotted(paths.with_paths(decode.nodes(_customer_files(spark, sf_dir), VARIABLE)), "Entry.body.NUM_BER").select("doc_id", "value")


@query("SELECT * FROM (VALUES ('/file/count', 'how many'), ('/file/entry/body/text/value', 'a name')) t(path, meaning)")
def path_meanings(spark, sf_dir):
    """An exact path, a path by two of its steps, and one that fits two meanings and so has none."""
    meanings = spark.createDataFrame([("file/count", "how many"), ("entry/value", "a name"), ("body/number", "x"), ("entry/number", "y")], "path string, meaning string")
    return paths.described(paths.with_paths(decode.nodes(_customer_files(spark, sf_dir), VARIABLE)), meanings)


@query("""SELECT * FROM (VALUES ('o_orderkey', 'integer', 0), ('o_orderdate', 'date', 0), ('o_orderpriority', 'text', 0), ('rushed', 'boolean', 0)) t("column", "type", blanks)
UNION ALL SELECT 'sometimes', 'decimal', count(*) FILTER (o_orderkey % 2 = 0) FROM orders""")
def column_proposal(spark, sf_dir):
    rows = READ(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority", F.lower((F.col("o_orderpriority") == "1-URGENT").cast("string")).alias("rushed"), F.when(F.expr("o_orderkey % 2 = 0"), " ").otherwise(F.concat("o_orderkey", F.lit(".25"))).alias("sometimes"))
    return tables.proposed(rows).select("column", "type", "blanks")


@query("""SELECT doc_id::VARCHAR AS path, 'dc' AS scheme, 'title' AS term, 'Doc ' || doc_id || ' & more' AS value FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'premis', 'messageDigest', md5(text) FROM documents UNION ALL SELECT doc_id::VARCHAR, 'mets', 'file@SIZE', n_chars::VARCHAR FROM documents""")
def package_metadata(spark, sf_dir):
    """Dublin Core, PREMIS and METS elements of one XML file for each document."""
    head = '<mets:mets xmlns:mets="http://www.loc.gov/METS/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:premis="http://www.loc.gov/premis/v3"><mets:dmdSec><dc:title>Doc '
    xml = F.concat(F.lit(head), "doc_id", F.lit(" &amp; more</dc:title></mets:dmdSec><premis:fixity><premis:messageDigest>"), F.md5("text"), F.lit('</premis:messageDigest></premis:fixity><mets:file SIZE="'), "n_chars", F.lit('"/></mets:mets>'))
    files = READ(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content"))
    return packages.metadata(files).select("path", "scheme", "term", "value")


NESTED = """
for orders in orders
  customer = custkey
  parts = count(lines)
  for items in lines
    number = linenumber
    cents = price * 100
    unit = "EUR"
  end
end
"""


@query("""SELECT l_orderkey AS customer, count(*)::INT AS parts, sum(round(l_extendedprice::DECIMAL(18,2) * 100))::BIGINT AS cents, sum(l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY 1""")
def nested_mapping(spark, sf_dir):
    """A for within a for: the lines of an order become an array of structs of the target."""
    rows = READ(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("custkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("linenumber"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))).alias("lines"))
    made = transform.mapped(rows, transform.parse_mapping(NESTED)[0], {"customer": "bigint", "parts": "int", "items.number": "bigint", "items.cents": "bigint"})
    total = lambda n: F.aggregate(F.transform("items", lambda i: i[n]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.select("customer", "parts", total("cents").alias("cents"), total("number").alias("numbers"))


@query("""SELECT 'name' AS target, true AS preserved, count(*)::BIGINT AS compared, NULL::DOUBLE AS max_difference FROM part
UNION ALL SELECT 'size', false, min(p_partkey) FILTER (p_partkey % 5 = 0), 3.0 FROM part""")
def external_transformation(spark, sf_dir):
    """What another tool made of the parts: names are kept, every fifth size is off by three."""
    rule = transform.parse_mapping("for part in parts\n  key = p_partkey\n  name = p_name\n  size = p_size\nend")[0]
    rows = READ(spark, sf_dir, "part")
    other = rows.select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit("  ")).alias("name"), F.when(F.expr("p_partkey % 5 = 0"), F.col("p_size") + 3).otherwise(F.col("p_size")).alias("size"))
    return transform.transformation_check(rows, other, "key", rule, {"key": "bigint", "size": "bigint"})


@query("SELECT c_custkey::VARCHAR AS path, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS differing, CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE -1 END::BIGINT AS first FROM customer")
def byte_differences(spark, sf_dir):
    """Files against copies of which every third has another fourth byte."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            got = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                other = raw[:3] + bytes([raw[3] ^ 255]) + raw[4:] if int(path) % 3 == 0 else raw
                got.append(decode.compared(raw, other))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*got, strict=True))], ["path", "differing", "first"])

    return _customer_files(spark, sf_dir).mapInArrow(run, "path string, differing long, first long")


@query("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def spectrum_view(spark, sf_dir):
    return views.spectrum(READ(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("string").alias("q"), "l_extendedprice"), "q", "l_extendedprice")


@query("SELECT event_id, date_trunc('millisecond', ts) AS event_start FROM events")
def series_by_view_text(spark, sf_dir):
    rows = READ(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))
    made = views.apply_spec(rows, '<view><series start="millis"/><columns><column name="event_id"/></columns></view>')
    return made.select("event_id", F.col("event_start").cast("timestamp_ntz").alias("event_start"))


def _regions(spark, sf_dir, *more):
    return T.projected(spark, sf_dir, ("nation", "region", *more))


@query(f"SELECT s, p, o FROM (SELECT '{E}nation-' || n_nationkey AS s, '{V.NAME}' AS p, n_name AS o FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT '{E}nation-' || n_nationkey, '{E}partOf', '{E}region-' || n_regionkey FROM nation WHERE n_nationkey <> 3 AND n_regionkey <> 1 UNION ALL SELECT '{E}region-' || r_regionkey, '{V.NAME}', r_name FROM region WHERE r_regionkey <> 1 UNION ALL SELECT '{E}place-new', '{V.TITLE}', 'New' UNION ALL SELECT '{E}nation-4', '{E}note', 'seen') WHERE true")
def resource_edits(spark, sf_dir):
    """Deleted resources, one created, one that is there already, a literal added, another added and removed."""
    graph = I.delete_resource(I.delete_resource(_regions(spark, sf_dir), E + "nation-3"), E + "region-1")
    graph = I.create_if_absent(I.create_if_absent(graph, E + "place-new", E + "Place", "New"), E + "nation-5", E + "Place", "not again")
    graph = I.add_literal(I.add_literal(I.add_literal(graph, E + "nation-4", E + "note", "seen"), E + "nation-4", E + "note", "seen"), E + "nation-6", E + "note", "gone")
    return I.remove_literal(graph, E + "nation-6", E + "note", "gone").where(F.col("p") != V.TYPE).select("s", "p", "o")


@query(f"""SELECT '{E}nation-' || n_nationkey AS s, '{E}group' AS p, '{E}nation-' || n_nationkey || '-group' AS o FROM nation UNION ALL SELECT '{E}nation-' || n_nationkey || '-group', '{E}member', '{E}region-' || n_regionkey FROM nation""")
def group_migration(spark, sf_dir):
    return I.group_migrated(T.projected(spark, sf_dir, ("nation",)), E + "partOf", E + "group", E + "member").where(F.col("p").isin(E + "group", E + "member")).select("s", "p", "o")


@query(f"""SELECT '{E}accession-b' AS s, '{E}quantityReceived' AS p, count(*)::VARCHAR AS o FROM documents UNION ALL SELECT '{E}accession-b', '{E}depositor', 'me' UNION ALL SELECT '{E}accession-b', '{V.DC}date', '2020-02-02'
UNION ALL SELECT DISTINCT '{E}accession-b', '{E}hasRecord', '{E}record-b-r' || doc_id FROM documents UNION ALL SELECT '{E}accession-b', '{V.TYPE}', '{E}Accession'""")
def accession_summary(spark, sf_dir):
    rows = READ(spark, sf_dir, "documents").select(F.concat(F.lit("R"), "doc_id").alias("recordno"), F.lit("t").alias("title"))
    return I.accession(rows, "b", "me", "2020-02-02").select("s", "p", "o")


@query(f"SELECT '{E}nation-' || n_nationkey AS s, 'https://x.example/r' || n_nationkey || '.pdf' AS url FROM nation WHERE n_nationkey % 2 = 0")
def storage_links(spark, sf_dir):
    rows = READ(spark, sf_dir, "nation")
    numbered = rows.select(*T.literal("data", T.iri("nation", "n_nationkey"), E + "recordNumber", F.concat(F.lit("r"), "n_nationkey")))
    files = rows.where("n_nationkey % 2 = 0").select(F.concat(F.lit("https://x.example/r"), "n_nationkey", F.lit(".pdf")).alias("url"), F.concat(F.lit("scan R"), "n_nationkey", F.lit(".pdf")).alias("name"))
    return I.attached(numbered, files).where(F.col("p") == E + "hasStorageLocation").select("s", F.col("o").alias("url"))


@query(f"SELECT '{E}region-' || n_regionkey AS head, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS position, n_name AS member FROM nation")
def list_walk(spark, sf_dir):
    """Nations of a region as an RDF list that begins at the region."""
    from pyspark.sql import Window as W

    order = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    node = F.when(F.row_number().over(order) == 1, F.concat(F.lit(E + "region-"), "n_regionkey")).otherwise(F.concat(F.lit("_:cell"), "n_nationkey"))
    rows = READ(spark, sf_dir, "nation").select("n_name", "n_regionkey", "n_nationkey", node.alias("node")).withColumn("next", F.lead("node").over(order))
    cells = rows.select(*T.literal("data", F.col("node"), V.RDF + "first", F.col("n_name"))).unionByName(rows.where("next is not null").select(*T.link("data", F.col("node"), V.RDF + "rest", F.col("next"))))
    return G.list_members(cells).where(F.col("head").startswith(E)).select("head", F.col("position").cast("int").alias("position"), "member")


@query(f"SELECT '{E}nation-' || n_nationkey AS s, '{E}partOf' AS p, '{E}region-' || n_regionkey AS o, false AS cross FROM nation WHERE n_regionkey < 2")
def graph_edges(spark, sf_dir):
    data = _regions(spark, sf_dir)
    nodes = READ(spark, sf_dir, "nation").where("n_regionkey < 2").select(T.iri("nation", "n_nationkey").alias("node")).unionByName(READ(spark, sf_dir, "region").select(T.iri("region", "r_regionkey").alias("node")))
    about, edges = G.graph_payload(data, nodes)
    return G.highlighted(about, edges, [E + "Place"], ["partOf"]).select("s", "p", "o", "cross")


@query(f"SELECT '{E}supplier-' || s_suppkey AS a, '{E}nation-' || s_nationkey AS b FROM supplier UNION ALL SELECT '{E}nation-' || n_nationkey, '{E}region-' || n_regionkey FROM nation")
def alternative_path(spark, sf_dir):
    return G.path(_regions(spark, sf_dir, "supplier"), [E + "inNation", E + "partOf"])


@query(f"SELECT '{V.NAME}' AS p, n_name AS o FROM nation WHERE n_nationkey = 4 UNION ALL SELECT '{E}partOf', '{E}region-' || n_regionkey FROM nation WHERE n_nationkey = 4 UNION ALL SELECT '{V.TYPE}', '{E}Place'")
def stored_properties(spark, sf_dir):
    return L.literals(_regions(spark, sf_dir), E + "nation-4", ()).select("p", "o").unionByName(_regions(spark, sf_dir).where((F.col("s") == E + "nation-4") & (F.col("o_kind") == "iri")).select("p", "o"))


@query(f"SELECT '{E}customer-' || c_custkey AS s, CASE WHEN c_custkey % 3 = 0 THEN 'de ' WHEN c_custkey % 3 = 1 THEN 'en ' ELSE '' END || c_name AS label FROM customer")
def preferred_labels(spark, sf_dir):
    """The asked language, else English, else untagged."""
    rows = READ(spark, sf_dir, "customer")
    label = lambda prefix, lang: rows.select(T.iri("customer", "c_custkey").alias("s"), F.concat(F.lit(prefix), "c_name").alias("o"), F.lit(lang).alias("o_lang"), "c_custkey")
    labels = label("", "").unionByName(label("en ", "en").where("c_custkey % 3 < 2")).unionByName(label("de ", "de").where("c_custkey % 3 = 0")).unionByName(label("fr ", "fr"))
    return V.picked_label(labels, "de")


@query(f"SELECT s FROM (SELECT '{E}supplier-' || s_suppkey AS s FROM supplier) WHERE contains(s, 'supplier-1') ORDER BY s LIMIT 5")
def mentioned(spark, sf_dir):
    return L.mentions(T.projected(spark, sf_dir, ("supplier",)), "SUPPLIER-1")


@query("SELECT least(1500, count(*) * 3)::BIGINT AS n, count(*) * 3 > 1500 AS more FROM customer")
def truncation_probe(spark, sf_dir):
    some, more = L.truncated(T.projected(spark, sf_dir, ("customer",)).where(F.col("p") != V.NAME))
    return some.agg(F.count("*").alias("n")).withColumn("more", F.lit(more))


@query("SELECT o_orderkey, r FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) AS r, count(*) OVER () AS n FROM orders) WHERE r >= ((n - 1) // 100) * 100")
def last_rows_page(spark, sf_dir):
    """A page far beyond the end is the last one."""
    rows = READ(spark, sf_dir, "orders").select("o_orderkey")
    numbered = tables.numbered(rows, ["o_orderkey"], "r")
    low = numbered.agg(F.min("r")).first()[0]
    return tables.rows_page(numbered.withColumn("r", F.col("r") - low), "r", 1_000_000, 100, rows.count()).select("o_orderkey", F.col("r").cast("bigint").alias("r"))


@query(f"SELECT DISTINCT '{E}nation-' || n_nationkey AS s, n_name AS title FROM nation")
def union_of_graphs(spark, sf_dir):
    """The same triples in two graphs are one; a merged and a subtracted graph."""
    data = T.projected(spark, sf_dir, ("nation",))
    view = T.union_view(T.ontology(spark), data, data.withColumn("g", F.lit("other")))
    return L.of(view, V.NAME).select("s", F.col("o").alias("title"))


@query("SELECT count(*) AS customers, count(DISTINCT c_nationkey) AS nations FROM customer")
def turtle_round_trip(spark, sf_dir):
    """Triples written as Turtle text and read again."""
    data = T.projected(spark, sf_dir, ("customer",)).where(F.regexp_extract("s", r"(\d+)$", 1).try_cast("bigint") >= 0)
    again = T.read_turtle_lines(T.to_turtle(data))
    return again.agg(F.count_if(F.col("p") == V.TYPE).alias("customers"), F.countDistinct(F.when(F.col("p") == E + "inNation", F.col("o"))).alias("nations"))


@query("SELECT '{\"orderkey\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS value FROM orders")
def json_rows(spark, sf_dir):
    return READ(spark, sf_dir, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"))).alias("value"))


@query(f"SELECT '{E}customer-' || c_custkey AS s FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_without_urgent(spark, sf_dir):
    view = T.projected(spark, sf_dir, ("orders", "customer"))
    urgent = L.of(view, V.DC + "type", "kind").where("kind = '1-URGENT'").select("s")
    used = L.of(view, V.RICO + "hasCreator").join(urgent, "s", "left_semi").select(F.col("o").alias("s"))
    return L.typed(view, E + "Customer").select("s").join(used, "s", "left_anti")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def csv_round_trip(spark, sf_dir):
    """Rows as CSV lines, read again by header."""
    lines = sinks.csv_lines(READ(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), quote_all=True)
    return lines.select(F.from_csv("value", "o_orderkey bigint, o_orderpriority string").alias("r")).select("r.*")
