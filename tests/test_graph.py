import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from arkivel.functions import vocab as V
from arkivel.operators import closures as G
from arkivel.operators import ingest as I
from arkivel.operators import listing as L
from arkivel.operators import packages
from arkivel.plans import sparql
from arkivel.sources import sinks
from arkivel.sources import triples as T

TURTLE = """
@prefix ex: <http://example.org/archive/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix rico: <https://www.ica.org/standards/RiC/ontology#> .
ex:a a rico:Record ; rico:title "First \\"one\\""@en, "Premier"@fr ; ex:next ex:b ; rdfs:seeAlso <http://x.org/y> .
ex:b ex:next ex:c ; ex:size 12 ; ex:parts ( ex:p ex:q ) . # a list
ex:c ex:next ex:a .
"""


@pytest.fixture(scope="module")
def graph(spark):
    return T.read_turtle(spark, TURTLE).cache()


def test_turtle(graph):
    rows = {(r.s, r.p, r.o, r.o_kind, r.o_lang) for r in graph.collect()}
    ex = V.EX
    assert (ex + "a", V.TITLE, 'First "one"', "literal", "en") in rows
    assert (ex + "a", V.TYPE, V.RICO + "Record", "iri", "") in rows
    with pytest.raises(ValueError):
        T.Turtle("ex:a ex:b .").parse()
    members = G.list_members(graph).where(~F.col("head").isin([])).orderBy("head", "position").collect()
    assert ["p", "q"] in [[m.member[-1] for m in members if m.head == h] for h in {m.head for m in members}]


def test_turtle_round_trip(spark, graph):
    text = "\n".join(r.value for r in T.to_turtle(graph.where("s_kind = 'iri' and o_kind <> 'bnode'")).collect())
    again = T.read_turtle(spark, text)
    assert T.without(graph.where("s_kind = 'iri' and o_kind <> 'bnode'"), again).isEmpty()


def test_turtle_lines_stay_on_executors(spark, graph, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from arkivel.plans import more

    some = graph.where("s_kind = 'iri' and o_kind <> 'bnode'")
    again = T.read_turtle_lines(T.to_turtle(some))
    assert T.without(some, again).isEmpty() and T.without(again, some).isEmpty()
    for line in ("<x:a> <x:b> [] .", "@prefix x: <x:> .", "<x:a> <x:b> <x:c>", "<x:a> x:b <x:c> ."):
        with pytest.raises(Exception, match="Turtle"):
            T.read_turtle_lines(spark.createDataFrame([(line,)], "value string")).collect()
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("the triples are collected"))
        counted = more.turtle_round_trip(spark, "/root/testdata/sf0.001")
    assert counted.first().customers > 0


def test_closure_on_a_circle(spark, graph):
    edges = G.path(graph, [V.EX + "next"])
    found = G.closure(edges, spark.createDataFrame([(V.EX + "a",)], "node string")).orderBy("depth").collect()
    assert [(r.node[-1], r.depth) for r in found] == [("a", 0), ("b", 1), ("c", 2)]


def test_external_links_are_no_edges(spark, graph):
    near, cut = G.neighbourhood(graph, spark.createDataFrame([(V.EX + "a",)], "node string"), 1)
    assert {r.node[-1] for r in near.collect()} == {"a", "b", "c"} and not cut
    nodes, edges = G.graph_payload(graph, near)
    assert {r.s[-1]: r.links for r in nodes.collect()}["a"] == ["http://x.org/y"]
    assert {r.relation for r in edges.collect()} == {"next"}


def test_tree_walk_meets_a_node_once(graph):
    assert [(d, n[-1]) for d, _, n in G.tree_rows(graph, V.EX + "a", 3, V.EX)] [:4] == [(0, "a"), (1, "b"), (2, "c"), (3, "a")]


def test_labels_by_language(graph):
    titles = graph.where(F.col("p") == V.TITLE)
    assert V.picked_label(titles, "fr").first().label == "Premier"
    assert V.picked_label(titles, "de").first().label == 'First "one"'


def test_edits(graph):
    more = I.add_literal(graph, V.EX + "a", V.TITLE, "Plain")
    assert more.count() == graph.count() + 1 and I.add_literal(more, V.EX + "a", V.TITLE, "Plain").count() == more.count()
    assert I.remove_literal(more, V.EX + "a", V.TITLE, "Premier").count() == more.count()  # it has a language
    assert I.remove_literal(more, V.EX + "a", V.TITLE, "Plain").count() == graph.count()
    assert I.delete_resource(graph, V.EX + "c").where(F.col("o") == V.EX + "c").isEmpty()
    assert I.create_if_absent(graph, V.EX + "a", V.RICO + "Record", "x").count() == graph.count()


def test_snapshots(spark, graph, tmp_path):
    at = T.save_snapshot(graph, f"file://{tmp_path}", 1)
    assert T.load_snapshot(spark, at).count() == graph.count()


def test_sparql(graph):
    view = graph.drop("g")
    ask = lambda q: sorted(tuple(r) for r in sparql.run(view, q).collect())
    assert ask("SELECT ?o WHERE { ex:a ex:next+ ?o }") == [(V.EX + "a",), (V.EX + "b",), (V.EX + "c",)]
    assert ask("SELECT ?s ?n WHERE { ?s ex:next ?x OPTIONAL { ?s ex:size ?n } FILTER(?s != ex:c) }") == [(V.EX + "a", None), (V.EX + "b", "12")]
    assert ask("SELECT ?s WHERE { ?s ex:next ?x FILTER NOT EXISTS { ?s ex:size ?n } }") == [(V.EX + "a",), (V.EX + "c",)]
    assert ask('SELECT (UCASE(?t) AS ?u) WHERE { ?s rico:title ?t FILTER(STRSTARTS(?t, "P")) }') == [("PREMIER",)]
    assert ask("SELECT ?s WHERE { VALUES ?s { ex:a ex:zz } ?s ex:next ?x }") == [(V.EX + "a",)]
    assert ask("SELECT ?s WHERE { { ?s ex:size ?n } UNION { ?s a rico:Record } }") == [(V.EX + "a",), (V.EX + "b",)]
    assert ask("SELECT (COUNT(*) AS ?n) WHERE { ?s ex:next ?o }") == [("3",)]
    assert ask("SELECT ?s WHERE { ?s ^ex:next ?o } ORDER BY DESC(?s) LIMIT 1") == [(V.EX + "c",)]
    with pytest.raises(ValueError):
        sparql.run(view, "DELETE WHERE { ?s ?p ?o }")


def test_page_arithmetic():
    page = L.Page(3, 50, 120)
    assert (page.pages, page.first, page.last) == (3, 101, 120)
    assert L.Page(1, 50, 0).pages == 1


def test_catalogue(spark):
    rows = spark.createDataFrame([("R1", "One", "a; b ;null; ", "Ann"), ("r 1", "Again", "c", "Ann"), (None, " ", "x", None)], "`Record No` string, Title string, Subject string, Creator string")
    good, warnings = I.catalogue_rows(rows)
    assert good.count() == 2 and warnings.count() == 1
    made = I.records(good, "b")
    assert sorted(r.o for r in made.where(F.col("p") == V.DC + "subject").collect()) == ["a", "b", "c"]
    assert I.accession(good, "b", "me", "2020").where(F.col("p") == V.EX + "quantityReceived").first().o == "2"
    assert [r.name for r in I.new_agents(good, made).collect()] == ["Ann"]


def test_storage_links_and_groups(spark, graph):
    numbered = I.add_literal(graph, V.EX + "a", V.EX + "recordNumber", "R7")
    files = spark.createDataFrame([("https://www.dropbox.com/s/x/r7.pdf?dl=0", "scan r7.pdf")], "url string, name string")
    assert I.attached(numbered, files).where(F.col("p") == V.EX + "hasStorageLocation").first().o == "https://dl.dropboxusercontent.com/s/x/r7.pdf"
    moved = I.group_migrated(graph, V.EX + "next", V.EX + "hasGroup", V.EX + "hasMember")
    assert moved.where(F.col("p") == V.EX + "next").isEmpty() and moved.where(F.col("p") == V.EX + "hasMember").count() == 3


def test_bag(spark):
    raw = packages.bag({"a.txt": b"hello", "b.txt": b"x"}, {"Source": "me"})
    files = sinks.package_listing(spark.createDataFrame([("p.zip", bytearray(raw))], "path string, content binary")).toPandas().set_index("path")
    assert files.loc["data/a.txt"].sha256 == hashlib.sha256(b"hello").hexdigest()
    assert "Payload-Oxum: 6.2" in files.loc["bag-info.txt"].text
    lines = [x.split("  ") for x in files.loc["manifest-sha256.txt"].text.splitlines()]
    manifest = spark.createDataFrame([(p, h) for h, p in lines], "path string, sha256 string")
    have = spark.createDataFrame([(p, r.sha256) for p, r in files.iterrows() if p.startswith("data/")], "path string, sha256 string")
    told = packages.bag_summary(packages.bag_check(manifest, have)).first()
    assert (told.matched, told.valid, told.verified) == (2, True, True)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(V.local_name(F.lit("http://a/b#c"))) == "c" and one(V.local_name(F.lit("http://a/b/"))) == "http://a/b/"
    assert one(V.decode_id(V.encode_id(F.lit("http://a/" + "b" * 100)))) == "http://a/" + "b" * 100
    assert one(V.prefixed(F.lit(V.RICO + "title"))) == "rico:title" and one(V.expanded(F.lit("rico:title"))) == V.TITLE
    assert one(V.slug(F.lit(" Ab c--d! "))) == "ab-c-d" and one(V.hyphened(F.lit("camelCaseName"))) == "camel-case-name"
    assert [one(V.column_letters(F.lit(i))) for i in (0, 25, 26, 701, 702, 18277)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert one(V.record_number(F.lit("see r12.pdf"))) == "R12" and one(V.file_extension(F.lit("a/b.TAR"))) == "tar"


def test_votable_and_csv(spark):
    df = spark.createDataFrame([(1, 'a "b", <c>')], "k int, t string")
    assert [r.value for r in sinks.csv_lines(df).collect()] == ['1,"a ""b"", <c>"']
    text = "".join(r.value for r in sinks.votable(df, "t").orderBy("part").collect())
    assert "&lt;c&gt;" in text and text.endswith("</VOTABLE>")
    assert sinks.rows_by_header("a,a,b\n1,2,3\n") == [{"a": "1; 2", "b": "3"}]
