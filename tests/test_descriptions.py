import math
import struct
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from arkivel.functions import east, generators
from arkivel.functions import vocab as V
from arkivel.operators import decode as X
from arkivel.operators import views
from arkivel.sources import manifest, sinks

from .test_decode import PACKET

EX = V.EX
MANIFEST = f"""@prefix ex: <{EX}> . @prefix rdfs: <{V.RDFS}> .
ex:readings rdfs:label "Readings" ; ex:hasStorageLocation <http://x.org/r.bin> ; ex:interpretedUsing ex:g .
ex:g ex:hasGroupMember ex:k, ex:d, ex:v, ex:m .
ex:k ex:specificationLanguage "Kaitai" ; ex:hasStorageLocation <http://x.org/r.ksy> .
ex:d ex:specificationLanguage "DFDL" ; ex:hasStorageLocation <http://x.org/r.xsd> .
ex:v a ex:ViewSpecification ; ex:viewKind "image" ; ex:hasStorageLocation <http://x.org/v.xml> .
ex:m ex:structuralPath "row.t" ; rdfs:label "temperature" ; ex:hasUnit "K" ."""


def test_manifest():
    one = manifest.select(manifest.read(MANIFEST))
    assert one.name == "Readings" and one.structure()[1] == "Kaitai" and one.views[0][1] == "image" and one.meanings == {"row.t": ("temperature", "K")}
    again = manifest.select(manifest.read(manifest.write(one)), "Readings")
    assert (again.structures, again.views, again.meanings) == (one.structures, one.views, one.meanings)
    with pytest.raises(ValueError):
        manifest.select([one], "other")


def test_rdf_xml():
    rows = manifest.read_rdf_xml(f"""<rdf:RDF xmlns:rdf="{V.RDF}" xmlns:e="{EX}"><e:Record rdf:about="{EX}a"><e:t xml:lang="fr">x</e:t><e:to rdf:resource="{EX}b"/>
      <e:l rdf:parseType="Collection"><rdf:Description rdf:about="{EX}p"/></e:l></e:Record></rdf:RDF>""")
    assert (EX + "a", "iri", V.TYPE, EX + "Record", "iri", "", "") in rows
    assert (EX + "a", "iri", EX + "t", "x", "literal", "", "fr") in rows
    assert any(r[2] == V.RDF + "first" and r[3] == EX + "p" for r in rows)


def test_schema_outline():
    made = manifest.schema_outline(generators.dfdl(PACKET))
    assert ("/packet/version", "unsignedByte", "1", "1") in made
    assert ("/packet/item", "", "1", "unbounded") in made


def test_generated_texts():
    assert "repeat-expr: n" in generators.kaitai(PACKET) and "switch-on: kind" in generators.kaitai(PACKET)
    assert ElementTree.fromstring(generators.dfdl(PACKET)).tag.endswith("schema")
    view = views.read_view(generators.table_view(PACKET))
    assert view.rows == "item" and [c.name for c in view.columns] == ["kind", "flags", "extra"]


def test_fits_description_reads_its_pixels():
    raw = sinks.fits_image(np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), 16)
    root = X.decoded(raw, generators.from_fits(sinks.fits_headers(raw)))
    assert [[p.value for p in r.children] for r in root.children if r.name == "row"] == [[1, 2, 3], [4, 5, 6]]


def read_words(spark, words, column):
    return [r[0] for r in spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(words)], "i int, w binary").coalesce(1).select("i", column(F.col("w")).alias("v")).orderBy("i").select("v").collect()]


def test_ieee(spark):
    values = [0.0, -0.0, 1.0, -2.5, 3.14159, 1e-30, -1e20, 5e-324, 1e-40, float("inf"), float("-inf"), 1.7976931348623157e308]
    assert read_words(spark, [struct.pack(">d", v) for v in values], lambda w: east.real_column(w, east.IEEE64)) == values
    small = [struct.pack(">f", v) for v in values[:10]]
    assert read_words(spark, small, lambda w: east.real_column(w, east.IEEE32)) == [struct.unpack(">f", w)[0] for w in small]
    assert math.isnan(read_words(spark, [bytes.fromhex("7fc00000")], lambda w: east.real_column(w, east.IEEE32))[0])


@pytest.mark.parametrize(("layout", "words"), [
    (east.IBM32, {"42640000": 100.0, "c1100000": -1.0, "00000000": 0.0, "41a00000": 10.0}),
    (east.IBM64, {"4264000000000000": 100.0}),
    (east.MIL32, {"40000001": 1.0, "80000000": -1.0, "600000ff": 0.375, "9ffffffc": -0.75 / 16 - 2**-27}),
    (east.VAX_F, {"00004080": 1.0, "0000c080": -1.0, "00000000": 0.0, "00008000": math.nan, "00004100": 2.0}),
    (east.NOS_VE, {"4001800000000000": 1.0, "7000000000000000": math.nan, "5000000000000001": math.inf, "c001800000000000": -1.0, "1000800000000000": 0.0}),
    (east.NOS_BE, {f"{(1024 << 48 | 1) << 4:016x}": 1.0, f"{((1024 << 48 | 1) ^ ((1 << 60) - 1)) << 4:016x}": -1.0, f"{(1022 << 48 | 6) << 4:016x}": 3.0}),
])
def test_other_reals(spark, layout, words):
    got = read_words(spark, [bytes.fromhex(w) for w in words], lambda w: east.real_column(w, layout))
    assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got, words.values(), strict=True)), (got, words)


def test_integers(spark):
    read = lambda word, *rest, **more: read_words(spark, [bytes.fromhex(word)], lambda w: east.integer_column(w, *rest, **more))[0]
    signs = ("unsigned", "twos_complement", "ones_complement", "sign_and_magnitude")
    assert [read("90", ((0, 3),), c) for c in signs] == [9, -7, -6, -1]
    assert read("a5", ((4, 7), (0, 3)), "unsigned") == 0x5A and read("a5", ((0, 7),), "", low_first=True) == 0xA5
    assert read("01", ((0, 7),), "", low_first=True) == 0x80 and read("8000000000000000", ((0, 63),), "twos_complement") == -(1 << 63)
    with pytest.raises(ValueError):
        east.joined(F.lit(""), ((4, 8),), 8)
    with pytest.raises(ValueError):
        east.signed(F.lit("1"), 1, "other")


def test_views(spark):
    rows = spark.createDataFrame([("7", "x", [(1, "a"), (2, "b")])], "n string, bad string, items array<struct<k:int,t:string>>")
    flat = views.table(rows, views.View("self", (views.ViewColumn("n", "n", "int"), views.ViewColumn("bad", "bad", "int")))).first()
    assert (flat.n, flat.n__raw, flat.bad, flat.bad__raw) == (7, None, None, "x")
    many = views.table(rows, views.View("items", (views.ViewColumn("key", "k", "long"),))).collect()
    assert [r.key for r in many] == [1, 2]
    with pytest.raises(ValueError):
        views.read_view("<view><columns/></view>")
    with pytest.raises(ValueError):
        views.geometry("line", [["a"], ["a", "b"]])
